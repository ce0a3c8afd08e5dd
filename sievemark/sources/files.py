"""Files of a tree, as rows."""

from __future__ import annotations

import os
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import extension

SCHEMA = "path string, size long, modified timestamp, content binary"


def list_files(root: str, extensions: Iterable[str]) -> list[tuple[str, int, datetime]]:
    """``(path, size, modified)`` below ``root``, or of ``root`` itself; extensions count whatever their case."""
    wanted = {e.lower().lstrip(".") for e in extensions}
    paths = [root] if os.path.isfile(root) else [os.path.join(d, n) for d, _, names in os.walk(root) for n in names]
    out = []
    for p in sorted(paths):
        if extension(p) in wanted and os.path.isfile(p):
            s = os.stat(p)
            out.append((p, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC)))
    return out


def read_files(spark: SparkSession, root: str, extensions: Iterable[str], parts: int | None = None) -> DataFrame:
    """``(path, size, modified, content)`` of a tree.

    Of a folder that is mounted, the driver lists the first level only; what
    lies below is walked by the tasks, hidden files included, and ``content``
    stays null: the contents are read where they are used.  Anything else goes
    through Spark's file source, pruned by extension before contents are read.
    ``parts`` is the number of partitions to read in, four a core if not given.
    """
    wanted = [e.lower().lstrip(".") for e in extensions]
    if os.path.exists(root):
        parts = parts or 4 * spark.sparkContext.defaultParallelism
        own = [root] if os.path.isfile(root) else [os.path.join(root, n) for n in sorted(os.listdir(root))]

        def walk(batches):
            import pyarrow as pa

            schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    found = list_files(start, wanted)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)

        level = spark.createDataFrame([(p,) for p in own], "path string").repartition(max(1, min(len(own), parts)))
        listed = level.mapInArrow(walk, "path string, size long, modified timestamp")
        return listed.repartition(parts).withColumn("content", F.lit(None).cast("binary"))
    name = F.element_at(F.split("path", "/"), -1)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .where(F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)).isin(*wanted))
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    )
