"""A stream over a whole table, run to its end and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a local session gets one of its own and a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="sievemark-stream-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """The files of a stored table as a stream, a batch for every ``files_a_batch`` of them."""
    table = spark.read.parquet(path)
    files = table.inputFiles()
    folder, names = os.path.dirname(files[0]), {os.path.basename(f) for f in files}
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_a_batch)
    return reader.option("pathGlobFilter", next(iter(names)) if len(names) == 1 else "*.parquet").parquet(folder)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its source is read: all rows in append mode, the last state in complete mode.

    The query runs here, with its state and its result below the shared
    folder; a batch that is repeated after a failure overwrites its own part.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'part=' + str(number) if mode == 'append' else 'state'}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
