"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OCR_EXTRACTORS = ("pdf_ocr", "image_tesseract", "image_easyocr")
HTML_EXTRACTORS = ("html_regex",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at ``spark.checkpoint.dir``.

    Where it is unset, a local session (one machine, as in tests) gets a folder
    of its own; a cluster is refused, as its executors share no local folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="sievemark-checkpoint-")
    sc.setCheckpointDir(shared)


def both_tables(chunks: DataFrame, contents: DataFrame) -> DataFrame:
    """``(rec_table, rec_id, text)`` of text_chunk and extracted_content."""
    return chunks.select(F.lit("text_chunk").alias("rec_table"), F.col("chunk_id").alias("rec_id"), "text").unionByName(
        contents.select(F.lit("extracted_content").alias("rec_table"), F.col("content_id").alias("rec_id"), "text")
    )


def with_extractor(contents: DataFrame, scans: DataFrame, extractors: Sequence[str]) -> DataFrame:
    """Rows of extracted_content whose file was read by one of ``extractors``.

    The extractor of a file stands in scan_result, which may hold a file
    twice; a left-semi join keeps one row per content row.
    """
    wanted = scans.where(F.col("extractor").isin(*extractors)).select("path")
    return spread(contents.select("content_id", "path", "text").where(F.col("text").isNotNull())).join(wanted, "path", "left_semi")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a plain scan over all cores where its files give fewer partitions than there are cores, as one small file does; else as they are.

    Only plans without an exchange are looked at, so no job runs here.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan" or "Exchange" in plan.toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` of ``function(columns: dict of lists) -> dict of columns``.

    A batch whose result is empty yields nothing.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out = function({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            if out and len(out[arrow.names[0]]):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip((out[n] for n in arrow.names), arrow)],
                    schema=arrow,
                )

    return spread(df).mapInArrow(run, schema)


class Both:
    """A small table or set of one row before a large one of all rows."""

    def __init__(self, own, rest):
        self.own, self.rest = own, rest

    def get(self, key, default=None):
        value = self.own.get(key)
        return self.rest.get(key, default) if value is None else value

    def __contains__(self, key) -> bool:
        return key in self.own or key in self.rest

    def __bool__(self) -> bool:
        return bool(self.own) or bool(self.rest)


def digest(key: str) -> bytes:
    """What ``unhex(md5(key))`` is in SQL."""
    return hashlib.md5(key.encode(), usedforsecurity=False).digest()


def with_rare(rows: DataFrame, rare: DataFrame, keys: Callable[[str], Iterable[str]]) -> DataFrame:
    """``rows(content_id, text)`` with ``rare``, a list of those rows of ``rare(d, ...)`` whose digest is of one of the text's keys.

    Keys too rare to be broadcast meet the texts by a hash-partitioned join;
    ``keys`` leaves out the frequent ones, so no key is hot.
    """

    def run(cols):
        out = {"content_id": [], "d": []}
        for i, text in zip(cols["content_id"], cols["text"]):
            own = {digest(k) for k in keys(text or "")}
            out["content_id"] += [i] * len(own)
            out["d"] += own
        return out

    own = map_batches(rows.select("content_id", "text"), run, "content_id long, d binary")
    lists = own.join(rare, "d").groupBy(F.col("content_id").alias("_id")).agg(F.collect_list(F.struct(*rare.columns)).alias("rare"))
    return rows.join(lists, rows["content_id"].eqNullSafe(lists["_id"]), "left").drop("_id")
