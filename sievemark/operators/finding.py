"""The finding profile: masked and hashed findings in twenty categories, levels per file.

Findings of a chunk are one array, built without a shuffle.  The first finding
of every (path, category, hash) is kept by a partial aggregation on the
smallest (chunk, rule, place), and the counts of a file come from sums over
those rows, so no file's findings have to fit into one task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.masking import mask, value_hash
from ..functions.normalize import trim
from ..functions.spans import SPANS, any_of, find_spans, window
from ..functions.validators import bik_valid, digits, field_has, full_name_like, inn_valid, luhn, mentions, snils_valid

FINDING = "array<struct<rule:int,start:int,category:string,value:string>>"


def _found(rule: int, category: Column | str, spans: Column) -> Column:
    name = F.lit(category) if isinstance(category, str) else None
    return F.transform(spans, lambda s: F.struct(F.lit(rule).alias("rule"), s["start"].alias("start"), (name if name is not None else category(s)).alias("category"), s["value"].alias("value")))


def _whole(rule: int, category: str, holds: Column, value: Column) -> Column:
    one = F.array(F.struct(F.lit(rule).alias("rule"), F.lit(0).alias("start"), F.lit(category).alias("category"), value.alias("value")))
    return F.when(F.coalesce(holds, F.lit(False)), one).otherwise(F.array().cast(FINDING))


def _named(text: Column, field: Column, persons: Column) -> Column:
    """Recognised names of a chunk without a field name: at least three characters, and a word of two letters."""
    whole = lambda s: (F.length(trim(s["value"])) >= 3) & F.exists(F.split(trim(s["value"]), r"(?U)\s+"), lambda w: F.length(F.regexp_replace(w, r"\.+$", "")) >= 2)
    own = (F.coalesce(field, F.lit("")) == "") & text.rlike(r"(?U)\S")
    return _found(19, "FIO", F.when(own, F.filter(persons, whole)).otherwise(F.array().cast(SPANS)))


def candidates(text: Column, field: Column, persons: Column | None = None, only: tuple[str, ...] = ()) -> Column:
    """All findings of one chunk, in the order of rules and places; empty for null and empty texts.

    ``persons`` are spans of recognised names (``operators.recognise``); the
    place of a span is in its own chunk, so none has to be looked up.  With
    ``only``, no rule runs but those of these categories.
    """

    def beside(kind: str, pad: int = 40):
        return lambda s: any_of(F.lower(window(text, s["start"] - pad, s["end"] + pad)), vocab.NEAR_WORDS[kind])

    def by_field(kind: str) -> Column:
        return field_has(field, vocab.FIELD_WORDS[kind])

    def near(kind: str, pad: int = 40):
        return lambda s: by_field(kind) | beside(kind, pad)(s)

    none = F.array().cast("array<struct<value:string,start:int,end:int>>")
    spans = lambda pattern: find_spans(text, pattern)
    own_code = digits(text)
    said = lambda kind: any_of(F.lower(text), vocab.NEAR_WORDS[kind])
    parts = [
        (("EMAIL",), _found(0, "EMAIL", spans(vocab.EMAIL))),
        (("PHONE",), _found(1, "PHONE", spans(vocab.F_PHONE))),
        (("PASSPORT_RF",), _found(2, "PASSPORT_RF", F.filter(spans(vocab.F_PASSPORT), near("passport")))),
        (("SNILS",), _found(3, "SNILS", F.filter(spans(vocab.F_SNILS), lambda s: snils_valid(s["value"])))),
        (("INN_PERSONAL", "INN_LEGAL"), _found(4, lambda s: F.when(F.length(s["value"]) == 12, "INN_PERSONAL").otherwise("INN_LEGAL"), F.filter(spans(vocab.F_INN), lambda s: inn_valid(s["value"]) & near("inn")(s)))),
        (("BANK_CARD",), _found(5, "BANK_CARD", F.filter(spans(vocab.F_CARD), lambda s: luhn(s["value"], 19) & near("card", 60)(s)))),
        (("BANK_ACCOUNT",), _found(6, "BANK_ACCOUNT", F.when(by_field("account"), spans(vocab.F_ACCOUNT)).otherwise(none))),
        (("BIC",), _found(7, "BIC", F.filter(spans(vocab.F_BIC), lambda s: bik_valid(s["value"])))),
        (("CVV",), _whole(8, "CVV", by_field("cvv") & F.length(own_code).between(3, 4), own_code)),
        (("CVV",), _found(8, "CVV", F.when(~by_field("cvv") & said("cvv"), F.filter(spans(vocab.F_CVV), beside("cvv", 15))).otherwise(none))),
        (("DRIVER_LICENSE",), _found(9, "DRIVER_LICENSE", spans(vocab.F_DRIVER))),
        (("MRZ",), _found(10, "MRZ", spans(vocab.F_MRZ))),
        (("BIRTH_DATE",), _found(11, "BIRTH_DATE", F.when(by_field("birth_date"), spans(vocab.F_DATE)).when(said("birth_date"), F.filter(spans(vocab.F_DATE), beside("birth_date"))).otherwise(none))),
        (("BIRTH_PLACE",), _whole(12, "BIRTH_PLACE", by_field("birth_place"), text)),
        (("ADDRESS",), _whole(13, "ADDRESS", by_field("address"), text)),
        (("FIO",), _whole(14, "FIO", by_field("fio") & full_name_like(text), text)),
        *[((k,), _whole(15 + n, k, mentions(text, p), F.substring(text, 1, vocab.SNIPPET))) for n, (k, p) in enumerate(vocab.MENTIONS.items())],
        *([(("FIO",), _named(text, field, persons))] if persons is not None else []),
    ]
    chosen = [p for kinds, p in parts if not only or set(kinds) & set(only)]
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.concat(*[p.cast(FINDING) for p in chosen])).otherwise(F.array().cast(FINDING))


def group_of(category: Column) -> Column:
    """The group of a category."""
    return F.create_map(*[F.lit(x) for pair in vocab.FINDING_GROUPS.items() for x in pair])[category]


def chunk_findings(chunks: DataFrame, *keep: str, persons: str | None = None, only: tuple[str, ...] = ()) -> DataFrame:
    """One row for each finding of ``chunks(path, chunk_seq, text, source, field_name)``: masked, hashed, not yet distinct.

    ``keep`` names further columns that stay, such as an event time;
    ``persons`` the column of recognised names, ``only`` the categories looked for.
    """
    value = trim(F.col("f.value"))
    return (
        chunks.select(*keep, "path", "chunk_seq", "source", "field_name", F.explode(candidates(F.col("text"), F.col("field_name"), F.col(persons) if persons else None, only)).alias("f"))
        .where(value != "")
        .where(F.col("f.category").isin(*only) if only else F.lit(True))
        .select(
            *keep,
            "path",
            F.struct("chunk_seq", "f.rule", "f.start").alias("place"),
            F.col("f.category").alias("category"),
            group_of(F.col("f.category")).alias("pd_group"),
            mask(F.col("f.category"), value).alias("masked"),
            value_hash(value).alias("hash"),
            "source",
            "field_name",
        )
    )


def distinct_findings(found: DataFrame) -> DataFrame:
    """The first finding of every path, category and hash; combined map-side before its one shuffle."""
    first = F.min_by(F.struct("pd_group", "masked", "source", "field_name"), F.struct(F.col("place"), F.coalesce("source", F.lit("")))).alias("x")
    return found.groupBy("path", "category", "hash").agg(first).select("path", "category", "x.pd_group", "x.masked", "hash", "x.source", "x.field_name")


def findings(chunks: DataFrame, persons: str | None = None, only: tuple[str, ...] = ()) -> DataFrame:
    """Distinct findings of every file; ``persons`` names a column of recognised names, if there is one; ``only`` some categories."""
    return distinct_findings(chunk_findings(chunks, persons=persons, only=only))


def level(n: dict[str, Column], strict: Column, big: int = vocab.BIG_VOLUME) -> Column:
    """The level 1 to 4 from the counts of groups; null for none."""
    sensitive = (n["special"] > 0) | (n["biometric"] > 0)
    nothing = sum(n.values(), F.lit(0)) == 0
    return (
        F.when(nothing, F.lit(None).cast("int"))
        .when(sensitive & strict, 1)
        .when(n["payment"] > 0, 2)
        .when(n["state_ids"] >= big, 2)
        .when(sensitive, 3)
        .when(n["state_ids"] > 0, 3)
        .when(n["regular"] >= big, 3)
        .otherwise(4)
    )


GROUPS = ("regular", "state_ids", "payment", "biometric", "special")


def classify(distinct: DataFrame, big: int = vocab.BIG_VOLUME) -> DataFrame:
    """``(path, total_findings, findings_by_group, findings_by_category, uz_level)`` of every file with a finding.

    Counted per (path, category) first, so a file with very many findings costs at most twenty rows in the second step.
    """
    per = distinct.groupBy("path", "category").agg(F.count("*").alias("n"), F.any_value("pd_group").alias("g"))
    per_file = per.groupBy("path").agg(
        *[F.sum(F.when(F.col("g") == g, F.col("n")).otherwise(0)).alias(g) for g in GROUPS],
        F.bool_or(F.col("category").isin(*vocab.STRICT_IDS)).alias("strict"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.col("n").cast("int"))))).alias("findings_by_category"),
    )
    n = {g: F.col(g) for g in GROUPS}
    by_group = F.map_filter(F.create_map(*[x for g in GROUPS for x in (F.lit(g), F.col(g).cast("int"))]), lambda k, v: v > 0)
    return per_file.select(
        "path", sum(n.values(), F.lit(0)).cast("int").alias("total_findings"), by_group.alias("findings_by_group"), "findings_by_category", level(n, F.col("strict"), big).alias("uz_level")
    )


def finding_lists(distinct: DataFrame) -> DataFrame:
    """``(path, findings)`` with the findings of every file as a map of lists, for the JSON report of a run."""
    lists = distinct.groupBy("path", "category").agg(F.array_sort(F.collect_list(F.struct("masked", "hash", "source", F.col("field_name").alias("field")))).alias("items"))
    return lists.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "items")))).alias("findings"))


def advice(uz: Column) -> Column:
    """Recommendations of a level."""
    rows = [F.array(*map(F.lit, vocab.FINDING_ADVICE[k])) for k in (1, 2, 3, 4)]
    out = F.array(*map(F.lit, vocab.FINDING_ADVICE[None]))
    for k, texts in zip((1, 2, 3, 4), rows):
        out = F.when(uz == k, texts).otherwise(out)
    return out
