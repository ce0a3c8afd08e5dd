"""A scan of files by the document profile: from a tree to result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..config import ScanConfig
from ..functions.normalize import result_time
from ..operators.document import analyze, as_map
from ..operators.finding import classify, finding_lists, findings
from ..operators.recognise import with_spans
from ..sources.chunks import chunks_of, read_chunks, states_of
from ..sources.extract import extract_files
from ..sources.files import read_files
from .report import report_rows

# fixed value: note of a result whose text was cut
CUT = "Извлеченный текст был усечен по лимиту символов."


def results(extracted: DataFrame, include_empty: bool = False, this_year: int | None = None, gated: bool = True) -> DataFrame:
    """Result rows of extracted texts.  A blank text is no finding; a failed file shows only with the empty ones."""
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S")
    rows = analyze(extracted, "text", gated=gated, this_year=this_year)
    categories = F.when(blank, F.create_map().cast("map<string,int>")).otherwise(as_map(F.col("categories")))
    notes = F.coalesce("warnings", F.array().cast("array<string>"))
    return rows.select(
        "path",
        "name",
        "size",
        result_time(F.col("modified")).alias("time"),
        "file_format",
        categories.alias("categories"),
        F.when(blank, vocab.LEVEL_NONE).otherwise(F.col("uz")).alias("uz"),
        F.when(blank, 0).otherwise(F.col("findings_count")).alias("findings_count"),
        F.col("method").alias("extractor"),
        F.when(blank, F.array().cast("array<string>")).otherwise(F.col("recommendations")).alias("recommendations"),
        F.when(F.col("truncated"), F.array_append(notes, F.lit(CUT))).otherwise(notes).alias("warnings"),
    ).where((F.col("findings_count") > 0) | F.lit(include_empty))


def scan_root(spark: SparkSession, config: ScanConfig) -> tuple[DataFrame, DataFrame]:
    """``(results, extracted)`` of all files below the root."""
    extracted = extract_files(read_files(spark, config.root, config.include_extensions, config.file_parts), config)
    return results(extracted, config.include_empty_results), extracted


def scan_findings(spark: SparkSession, config: ScanConfig, load=None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(report rows, distinct findings)`` of all files below the root by the finding profile.

    ``load`` may load a recogniser of names.  The chunks are read once: they
    are persisted, as both findings and states of files come from them.
    """
    read = read_chunks(read_files(spark, config.root, config.include_extensions, config.file_parts)).persist()
    chunks, persons = chunks_of(read), None
    if load is not None:
        chunks, persons = with_spans(chunks, load, limit=vocab.RECOGNISED_CHUNK_CHARS, strict=strict), "persons"
    found = findings(chunks, persons)
    return report_rows(states_of(read), classify(found), finding_lists(found)), found


def slow_files(extracted: DataFrame, threshold: float) -> DataFrame:
    """``(path, ext, seconds, status)`` of files whose reading took at least ``threshold`` seconds."""
    return extracted.where(F.col("elapsed") >= threshold).select("path", F.col("file_format").alias("ext"), F.format_string("%.3f", "elapsed").alias("seconds"), "status")
