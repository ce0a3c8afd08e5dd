"""Named queries over the driver's tables, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..config import ScanConfig
from ..functions import masking as K
from ..functions import normalize as N
from ..functions import validators as V
from ..functions.spans import find_spans
from ..operators import classifier as C
from ..operators import document as D
from ..operators import finding as B
from ..sources.chunks import chunk_files, read_chunks, states_of
from ..sources.decode import decode_bytes, repair_texts
from ..sources.extract import extract_files, json_lines
from ..streaming.run import run_to_end, stream_of
from ..streaming.stream import event_windows, finding_stream, running_levels, user_sessions
from . import formats
from . import report as R

#: The last year of a birth date in queries, so that results do not change with the calendar.
YEAR = 2026
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a plain scan over all cores where its files give fewer partitions than there are cores; else as they are.  No job runs here."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan" or "Exchange" in plan.toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def contents(spark, d: str) -> DataFrame:
    """File texts, with the text in lower case beside."""
    return spread(table(spark, d, "extracted_content").select("content_id", F.coalesce("text", F.lit("")).alias("t"))).withColumn("low", F.lower("t"))


def entity(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        keys = D.entity_keys(F.col("t"), F.col("low"), name)
        return contents(spark, d).select("content_id", F.size(keys).alias("n"))

    run.__name__ = f"{name}_counts"
    run.__doc__ = f"Distinct values of {name} in every file text."
    return run


for _e in D.ENTITIES:
    query(entity(_e.name))


@query
def fio_counts(spark, d):
    """Distinct names in every file text."""
    return contents(spark, d).select("content_id", F.size(D.full_names(F.col("t"), F.col("low"))).alias("n"))


@query
def birth_date_counts(spark, d):
    return contents(spark, d).select("content_id", F.size(D.birth_dates(F.col("t"), F.col("low"), YEAR)).alias("n"))


@query
def birth_place_counts(spark, d):
    return contents(spark, d).select("content_id", F.size(D.birth_places(F.col("t"))).alias("n"))


@query
def address_counts(spark, d):
    return contents(spark, d).select("content_id", F.size(D.addresses(F.col("t"))).alias("n"))


@query
def classifier_keywords(spark, d):
    """Biometric and special words in every document."""
    c = C.keyword_counts(F.lower(F.coalesce("text", F.lit(""))))
    return table(spark, d, "documents").select("doc_id", c["биометрические"].alias("biometric"), c["специальные"].alias("special"))


@query
def classifier_gate(spark, d):
    """File texts that pass the gate before the model."""
    return contents(spark, d).where(C.gate(F.col("low"))).select("content_id")


@query
def policy_noise(spark, d):
    return contents(spark, d).where(C.policy_noise(F.col("low"))).select("content_id", C.any_evidence(F.col("low")).alias("evidence"))


@query
def label_counts(spark, d):
    """Labels of a model turned into counts; here every text has all four labels."""
    labels = F.create_map(*[x for k in vocab.LABEL_EVIDENCE for x in (F.lit(k), F.lit(1))])
    c = C.labels_to_counts(F.col("low"), labels)
    return contents(spark, d).select("content_id", c["биометрические"].alias("biometric"), c["специальные"].alias("special")).where("biometric + special > 0")


@query
def topk_chunks(spark, d):
    """The chunks of every file text that a model would see."""
    return contents(spark, d).select("content_id", F.posexplode(C.relevant_chunks(F.col("t"))).alias("rank", "chunk")).select("content_id", "rank", F.length("chunk").alias("chars"), K.value_hash(F.col("chunk")).alias("hash"))


def _profile(spark, d, gated: bool) -> DataFrame:
    rows = D.analyze(spread(table(spark, d, "extracted_content").select("content_id", "text")), gated=gated, this_year=YEAR)
    return rows.select("content_id", *[F.col(f"categories.`{c}`").alias(a) for c, a in zip(vocab.DOC_CATEGORIES, ("common", "state", "pay", "bio", "special"))], "uz", "findings_count", F.array_join("recommendations", " ").alias("advice"))


@query
def document_profile(spark, d):
    """Category counts, level, findings and recommendations of every file text, as a scan gives them."""
    return _profile(spark, d, True)


@query
def document_profile_ungated(spark, d):
    return _profile(spark, d, False)


@query
def uz_level(spark, d):
    """Level of every document by its mailboxes and keywords."""
    low = F.lower("t")
    docs = spread(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")))
    common = F.size(D.entity_keys(F.col("t"), low, "email"))
    words = C.keyword_counts(low)
    c = C.add(C.counts(обычные=common), words)
    return docs.select("doc_id", common.alias("emails"), D.level(c).alias("uz"))


@query
def level_of_counts(spark, d):
    """Levels and recommendations recomputed from stored category maps."""
    get = lambda k: F.coalesce(F.try_element_at("categories", F.lit(k)), F.lit(0))
    c = F.struct(*[get(k).alias(k) for k in vocab.DOC_CATEGORIES])
    rows = table(spark, d, "scan_result").select("path", "findings_count", c.alias("c"))
    return rows.select("path", D.level(F.col("c")).alias("uz"), D.total(F.col("c")).alias("findings_count"), F.array_join(D.advice(F.col("c"), D.level(F.col("c"))), " ").alias("advice"), F.array_join(D.detected(F.col("c")), ",").alias("detected"))


@query
def category_totals(spark, d):
    return R.category_totals(table(spark, d, "scan_result"))


@query
def uz_histogram(spark, d):
    return R.level_histogram(table(spark, d, "scan_result"))


@query
def uz_rollup(spark, d):
    """Files by format and level with subtotals (an extension)."""
    return table(spark, d, "scan_result").rollup("file_format", "uz").agg(F.count("*").alias("files"), F.sum("findings_count").alias("findings"))


@query
def results_found(spark, d):
    """Results that a report holds: with findings."""
    return table(spark, d, "scan_result").where("findings_count > 0").select("size", F.col("time_text").alias("time"), "name")


def _finalized(spark, d, limit: int) -> DataFrame:
    done = N.finalize(F.col("text"), limit)
    return table(spark, d, "extracted_content").select("content_id", K.value_hash(done["text"]).alias("hash"), F.length(done["text"]).alias("chars"), done["truncated"].alias("truncated"))


@query
def finalize_text(spark, d):
    """File texts in their final form, with a limit that some of them pass."""
    return _finalized(spark, d, 3000)


@query
def finalize_text_of_scan(spark, d):
    """File texts in their final form, with the limit of a scan."""
    return _finalized(spark, d, 200_000)


@query
def mixed_script_repair(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "extracted_content").select("content_id", K.value_hash(N.mixed_script(t)).alias("hash"))


@query
def mojibake_repair(spark, d):
    """Cells repaired; the gate is a column, Python sees only texts that pass it."""
    rows = table(spark, d, "text_chunk").where(F.length("text") - F.length(F.translate("text", "ÐÑ", "")) >= 3)
    return rows.select("chunk_id", K.value_hash(repair_texts("text")).alias("hash"))


@query
def cyrillic_share(spark, d):
    t = F.col("text")
    return table(spark, d, "extracted_content").select("content_id", F.round(N.cyrillic_share(t), 6).alias("share"), N.meaningful(t).alias("meaningful"))


@query
def heading_hints(spark, d):
    return table(spark, d, "text_chunk").select("chunk_id", N.heading_hint(F.col("field_name")).alias("hint")).where("hint <> ''")


@query
def binary_strings(spark, d):
    """Printable runs of texts as bytes."""
    return table(spark, d, "extracted_content").where("text IS NOT NULL").select("content_id", K.value_hash(N.binary_strings(F.encode("text", "UTF-8"))).alias("hash"))


@query
def json_leaves(spark, d):
    """Leaves of JSON values as lines, as the reader of JSON files gives them."""
    return table(spark, d, "events").select("event_id", json_lines("props").alias("lines"))


def _files(spark, d) -> DataFrame:
    return formats.files(spread(table(spark, d, "extracted_content").select("content_id", "text")), "content_id", "text")


@query
def texts_of_formats(spark, d):
    """Every file text packed in seven formats and read again by the document profile's readers."""
    rows = extract_files(_files(spark, d), ScanConfig(""))
    return rows.select("path", "file_format", "method", "status", "truncated", K.value_hash(F.col("text")).alias("hash"))


@query
def chunks_of_formats(spark, d):
    """The same files as chunks of the finding profile."""
    return chunk_files(_files(spark, d)).select("path", "chunk_seq", "source", "field_name", K.value_hash(F.col("text")).alias("hash"))


@query
def states_of_formats(spark, d):
    """How many files of each format were read, and how many have no reader of chunks."""
    return states_of(read_chunks(_files(spark, d))).groupBy("extension", "status", "via_ocr").agg(F.count("*").alias("files"))


@query
def decoded_bytes(spark, d):
    """Texts encoded in two ways and decoded by the rules for bytes of unknown encoding; the mark of a two-byte text stays."""
    rows = spread(table(spark, d, "extracted_content").where("text IS NOT NULL").select("content_id", "text"))
    h = lambda charset: K.value_hash(decode_bytes(F.encode("text", charset)))
    return rows.select("content_id", h("UTF-8").alias("one"), h("UTF-16").alias("two"))


@query
def mentions_and_names(spark, d):
    """Checks of single cells: names by their shape, addresses by their parts, dates of birth, machine-readable lines."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "text_chunk").select("chunk_id", V.full_name_like(t).alias("name"), V.address_like(t).alias("address"), V.birth_date_valid(F.regexp_extract(t, r"\d{2}[./]\d{2}[./]\d{4}", 0), YEAR).alias("birth"), V.mrz_valid(t).alias("mrz"), V.has_person_word(F.lower(t)).alias("person"))


@query
def phone_keys(spark, d):
    """Phone numbers of chunks in their normal form, a row each."""
    spans = find_spans(F.col("text"), vocab.F_PHONE)
    return table(spark, d, "text_chunk").select("chunk_id", F.explode(spans).alias("s")).select("chunk_id", F.col("s.start").alias("start"), N.phone(F.col("s.value")).alias("phone"), V.phone_valid(F.col("s.value")).alias("valid"))


@query
def span_offsets(spark, d):
    """Places of number runs in chunks: each is what the text holds there."""
    return table(spark, d, "text_chunk").select("chunk_id", F.explode(find_spans(F.col("text"), r"[0-9]{6,}")).alias("s")).select("chunk_id", "s.value", "s.start", "s.end")


def _chunks(spark, d) -> DataFrame:
    return spread(table(spark, d, "text_chunk").select("path", "chunk_seq", "text", "source", "field_name"))


@query
def finding_rows(spark, d):
    """Distinct masked findings of all chunks."""
    return B.findings(_chunks(spark, d))


@query
def finding_emails(spark, d):
    """Mailboxes found in chunks, masked and hashed, once a file."""
    return B.findings(_chunks(spark, d), only=("EMAIL",)).select("path", "hash", "masked")


@query
def finding_field_cells(spark, d):
    """Whole-cell findings by field name, once a file."""
    return B.findings(_chunks(spark, d), only=("ADDRESS", "BIRTH_PLACE")).select("path", "category", "hash", "masked")


@query
def file_levels(spark, d):
    """Counts and level of every path with findings in its chunks."""
    c = B.classify(B.findings(_chunks(spark, d)))
    return c.select("path", "total_findings", R.joined_map(F.col("findings_by_group")).alias("groups"), R.joined_map(F.col("findings_by_category")).alias("categories"), "uz_level")


def _stored(spark, d) -> DataFrame:
    f = table(spark, d, "finding").select("path", F.struct(F.lit(0).alias("chunk_seq"), F.lit(0).alias("rule"), F.col("finding_id").alias("start")).alias("place"), "category", "pd_group", "masked", "hash", "source", "field_name")
    return B.distinct_findings(f)


@query
def dedup_first_wins(spark, d):
    """Stored findings, the first of each path, category and hash."""
    return _stored(spark, d).select("path", "category", "pd_group", "hash", "source", "field_name")


@query
def stored_levels(spark, d):
    c = B.classify(_stored(spark, d))
    return c.select("path", "total_findings", R.joined_map(F.col("findings_by_group")).alias("groups"), R.joined_map(F.col("findings_by_category")).alias("categories"), "uz_level")


def _report(spark, d) -> DataFrame:
    return R.report_rows(table(spark, d, "extract_status"), B.classify(_stored(spark, d)))


@query
def report_rows(spark, d):
    """The flat report table: every extraction with its classification, if any."""
    return R.csv_table(_report(spark, d))


@query
def report_summary(spark, d):
    return R.summary(_report(spark, d))


@query
def report_group_totals(spark, d):
    return R.totals(_report(spark, d), "groups", B.GROUPS)


@query
def report_category_totals(spark, d):
    return R.totals(_report(spark, d), "categories")


@query
def report_order(spark, d):
    """The twenty most dangerous files (a top-k report)."""
    return R.ordered(_report(spark, d).dropDuplicates(["path", "status", "format"])).limit(20).select("path", "uz_level", "total_findings")


@query
def report_lines(spark, d):
    return R.text_lines(_report(spark, d))


@query
def masked_cells(spark, d):
    """Cells masked as what their heading says."""
    kind = F.when(V.field_has(F.col("field_name"), ("mail", "почт")), "EMAIL").when(V.field_has(F.col("field_name"), ("телеф", "phone")), "PHONE").when(V.field_has(F.col("field_name"), ("снилс", "snils")), "SNILS").when(
        V.field_has(F.col("field_name"), ("адрес", "address")), "ADDRESS").when(V.field_has(F.col("field_name"), ("рожд", "birth")), "BIRTH_DATE")
    rows = table(spark, d, "text_chunk").select("chunk_id", "text", kind.alias("kind")).where("kind IS NOT NULL AND text IS NOT NULL")
    return rows.select("chunk_id", "kind", K.mask(F.col("kind"), F.col("text")).alias("masked"))


@query
def checksums(spark, d):
    """Checks of numbers made from customer keys."""
    k = F.lpad(F.col("c_custkey").cast("string"), 10, "7")
    rows = table(spark, d, "customer").select("c_custkey", k.alias("k"))
    return rows.select(
        "c_custkey", V.inn_valid(F.col("k")).alias("inn10"), V.inn_valid(F.concat(F.col("k"), F.lit("07"))).alias("inn12"), V.snils_valid(F.concat(F.col("k"), F.lit("1"))).alias("snils"),
        V.luhn(F.concat(F.lit("411111"), F.col("k"))).alias("luhn"), V.phone_valid(F.col("k")).alias("phone"), V.passport_valid(F.col("k")).alias("passport"), V.card_prefix_valid(F.col("k")).alias("bin"), V.bik_valid(F.right(F.col("k"), F.lit(9))).alias("bik"),
    )


@query
def streamed_findings(spark, d):
    """Distinct findings of all chunks, as a stream of chunks gives them."""
    found = finding_stream(stream_of(spark, f"{d}/text_chunk.parquet"))
    return run_to_end(found.select("path", "category", "pd_group", "hash", "masked"))


@query
def streamed_levels(spark, d):
    """Counts of groups and level of every path, as a stream of chunks leaves them."""
    found = finding_stream(stream_of(spark, f"{d}/text_chunk.parquet"))
    return run_to_end(running_levels(found).select("path", *B.GROUPS, "uz_level"), "complete")


@query
def streamed_events(spark, d):
    """Events in windows of an hour, counted by a stream."""
    rows = event_windows(stream_of(spark, f"{d}/events.parquet"))
    return run_to_end(rows, "complete").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query
def streamed_sessions(spark, d):
    """Sessions of users, found by a stream."""
    return run_to_end(user_sessions(stream_of(spark, f"{d}/events.parquet")), "complete")


@query
def hourly_events(spark, d):
    return event_windows(table(spark, d, "events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query
def sessions(spark, d):
    return user_sessions(table(spark, d, "events"))


def queries() -> dict:
    return dict(QUERIES)
