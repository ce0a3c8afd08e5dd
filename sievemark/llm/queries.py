"""Queries of this subpackage: ``queries()`` and ``oracle_sql()`` are merged by the driver's entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charset, lookalike
from .common import both_tables, ensure_checkpoint_dir, table
from . import mainbody, pii, scans
from .common import HTML_EXTRACTORS, OCR_EXTRACTORS, with_extractor
from .names import map_rows
from .leaks import leaked_items
from .sentences import sentences
from .split import split_oversized
from .sql import ORACLE
from .tokenize import token_ids


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_tables(table(spark, sf_dir, "text_chunk"), table(spark, sf_dir, "extracted_content"))


def _sound(texts: DataFrame):
    """A function that leaves out rows garbled by a wrong character set."""

    def narrow(rows: DataFrame) -> DataFrame:
        ensure_checkpoint_dir(rows.sparkSession)
        rows = rows.checkpoint()
        return rows.join(charset.garbled(rows, corpus=texts), ["rec_table", "rec_id"], "left_anti")

    return narrow


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the look-alike classes; rows garbled by a wrong set take no part."""
    texts = _texts(spark, sf_dir)
    return lookalike.pairs(lookalike.classes(texts, _sound(texts)))


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form, by the classes of p1_found."""
    texts = _texts(spark, sf_dir)
    return lookalike.consistent(texts, _sound(texts))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_rows(table(spark, sf_dir, "text_chunk"), table(spark, sf_dir, "field_ref"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_extractor(table(spark, sf_dir, "extracted_content"), table(spark, sf_dir, "scan_result"), OCR_EXTRACTORS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_lines(_scanned(spark, sf_dir), table(spark, sf_dir, "extracted_content"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of scanned pages in continuous paragraphs."""
    return scans.repaired(_scanned(spark, sf_dir), table(spark, sf_dir, "extracted_content"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.garbled(_texts(spark, sf_dir))


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected rows with their text as far as it could be restored."""
    return charset.garbled(_texts(spark, sf_dir), with_text=True)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages, lines that were garbled by a wrong character set restored where that keeps the lines apart."""
    contents = table(spark, sf_dir, "extracted_content")
    pages = with_extractor(contents, table(spark, sf_dir, "scan_result"), HTML_EXTRACTORS)
    garbled = charset.garbled(pages.select(F.lit("extracted_content").alias("rec_table"), F.col("content_id").alias("rec_id"), "text"), with_text=True)
    feeds = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    restored = F.when(feeds(F.col("restored")) == feeds(F.col("text")), F.col("restored"))
    return pages.join(garbled.select(F.col("rec_id").alias("content_id"), "restored"), "content_id", "left").select("content_id", F.coalesce(restored, "text").alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return mainbody.keep_lines(_pages(spark, sf_dir).checkpoint())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were cut: those for which the splitter gives more than one piece."""
    pieces = split_oversized(table(spark, sf_dir, "extracted_content"))
    return pieces.where(F.col("piece_no") == 2).select("content_id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized file texts."""
    return split_oversized(table(spark, sf_dir, "extracted_content"))


def _free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without a heading, and all file texts."""
    chunks = table(spark, sf_dir, "text_chunk").where(F.col("field_name").isNull())
    return both_tables(chunks, table(spark, sf_dir, "extracted_content"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_information(_free_texts(spark, sf_dir))


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with typed placeholders."""
    return pii.redacted(_free_texts(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_texts, p2_found, p6_found, p6_restored, p7_found, p7_redacted, p3_found, p3_pieces, p4_found, p5_found, p5_repaired, p8_ids, p9_found, p10_found)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
