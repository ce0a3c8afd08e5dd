"""The same columns over streams of files, chunks and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..config import ScanConfig
from ..operators.document import analyze
from ..operators.finding import GROUPS, chunk_findings, level
from ..sources.extract import extract_files


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they arrive in a folder, as ``(path, size, modified, content)``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def scan_stream(files: DataFrame, config: ScanConfig, this_year: int | None = None) -> DataFrame:
    """Result columns for files of a stream; stateless, as distinct values are counted inside a file."""
    return analyze(extract_files(files, config), this_year=this_year)


def finding_stream(chunks: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Distinct findings of a stream of chunks; with an event time, state older than ``delay`` is dropped."""
    if time is None:
        return chunk_findings(chunks).dropDuplicates(["path", "category", "hash"])
    return chunk_findings(chunks.withWatermark(time, delay), time).dropDuplicatesWithinWatermark(["path", "category", "hash"])


def running_levels(distinct: DataFrame, big: int = 100) -> DataFrame:
    """Counts and level of every path so far, for update mode; a level can only become more severe."""
    n = {g: F.col(g) for g in GROUPS}
    counts = distinct.groupBy("path").agg(*[F.count_if(F.col("pd_group") == g).alias(g) for g in GROUPS], F.max(F.col("category").isin(*vocab.STRICT_IDS)).alias("strict"))
    return counts.select("path", *GROUPS, level(n, F.col("strict"), big).alias("uz_level"))


def _timed(events: DataFrame, delay: str) -> tuple[DataFrame, str]:
    """Events with a watermark where they are a stream, and the type of their time; a watermark wants a time with a zone."""
    kind = dict(events.dtypes)["ts"]
    return (events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) if events.isStreaming else events), kind


def event_windows(events: DataFrame, length: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events and their values by kind in tumbling windows; later events than ``delay`` are left out of a stream."""
    rows, kind = _timed(events, delay)
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast(kind).alias("window_start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Sessions of users: runs of events no further apart than ``gap``."""
    rows, kind = _timed(events, delay)
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").cast(kind).alias("session_start"), F.col("w.end").cast(kind).alias("session_end"), "n")
