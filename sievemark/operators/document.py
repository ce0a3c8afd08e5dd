"""The document profile: counts of personal data in five categories, and a protection level.

Everything is a column over one text, so a scan of texts needs no shuffle.
Null and empty texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import normalize as N
from ..functions import validators as V
from ..functions.spans import SPANS, about_start, any_of, around, find_spans, window
from .classifier import add, classifier_counts, counts, keyword_counts

DEMO_RADIUS = 200


@dataclass(frozen=True)
class Entity:
    """One kind of value: how it looks, when a match holds, and what makes two of them the same."""

    name: str
    category: str
    pattern: str
    holds: Callable[[Column, Column], Column]
    key: Callable[[Column], Column]
    demo: bool = True


def _near(words: tuple[str, ...], radius: int) -> Callable[[Column, Column], Column]:
    return lambda low, s: any_of(about_start(low, s, radius), words)


def _group(pattern: str) -> Callable[[Column], Column]:
    return lambda s: F.regexp_extract(s["value"], pattern, 1)


_STATE, _PAY, _COMMON = "государственные", "платежные", "обычные"
ENTITIES = (
    Entity("email", _COMMON, vocab.EMAIL, lambda low, s: V.email_valid(s["value"]) & ~V.email_of_role(s["value"]), lambda s: N.email(s["value"])),
    Entity("phone", _COMMON, vocab.PHONE, lambda low, s: V.phone_valid(s["value"]), lambda s: N.phone(s["value"])),
    Entity("snils", _STATE, vocab.SNILS, lambda low, s: V.snils_valid(s["value"]), lambda s: V.digits(s["value"])),
    Entity("inn10", _STATE, vocab.TEN_DIGITS, lambda low, s: V.inn_valid(s["value"]), lambda s: s["value"]),
    Entity("inn12", _STATE, vocab.TWELVE_DIGITS, lambda low, s: V.inn_valid(s["value"]), lambda s: s["value"]),
    Entity("passport", _STATE, vocab.PASSPORT, lambda low, s: V.passport_valid(s["value"]) & _near(vocab.PASSPORT_WORDS, 50)(low, s), lambda s: V.digits(s["value"])),
    Entity("driver", _STATE, vocab.TEN_DIGITS, _near(vocab.DRIVER_WORDS, 50), lambda s: s["value"]),
    Entity("mrz", _STATE, vocab.MRZ, lambda low, s: V.mrz_valid(s["value"]) & _near(vocab.MRZ_WORDS, 60)(low, s), lambda s: s["value"], demo=False),
    Entity("card", _PAY, vocab.CARD, lambda low, s: V.luhn(s["value"], 19) & V.card_prefix_valid(V.digits(s["value"])) & _near(vocab.CARD_WORDS, 50)(low, s), lambda s: V.digits(s["value"])),
    Entity("account", _PAY, vocab.ACCOUNT, _near(vocab.ACCOUNT_WORDS, 60), _group(vocab.ACCOUNT)),
    Entity("bik", _PAY, vocab.BIK, lambda low, s: V.bik_valid(_group(vocab.BIK)(s)) & _near(vocab.ACCOUNT_WORDS, 60)(low, s), _group(vocab.BIK)),
    Entity("cvv", _PAY, vocab.CVV, _near(vocab.CARD_WORDS, 40), lambda s: F.concat_ws("/", _group(vocab.CVV)(s), (s["start"] / 200).cast("int").cast("string"))),
)
BY_NAME = {e.name: e for e in ENTITIES}


def demo(low: Column, s: Column) -> Column:
    """Does a match stand among words of a sample or test?"""
    return any_of(around(low, s, DEMO_RADIUS), vocab.DEMO_WORDS)


def entity_keys(text: Column, low: Column, name: str) -> Column:
    """Distinct values of an entity in a text, in their normal form."""
    e = BY_NAME[name]
    kept = F.filter(find_spans(text, e.pattern), lambda s: e.holds(low, s) & (~demo(low, s) if e.demo else F.lit(True)))
    return F.array_distinct(F.transform(kept, e.key))


def regex_counts(text: Column, low: Column) -> Column:
    """Counts of the entities that patterns find; a taxpayer number counts once whatever its length."""
    sizes: dict[str, Column] = {}
    for e in ENTITIES:
        n = F.size(entity_keys(text, low, e.name))
        sizes[e.category] = sizes[e.category] + n if e.category in sizes else n
    return counts(**sizes)


def full_names(text: Column, low: Column, persons: Column | None = None, others: Column | None = None) -> Column:
    """Distinct names of persons: Cyrillic and Latin ones by pattern and context, and those that recognised spans add.

    ``persons`` and ``others`` (places and firms) are arrays of spans from a recogniser; without one they are empty.
    """
    none = F.array().cast(SPANS)
    persons, others = (none if x is None else x for x in (persons, others))
    known = F.transform(persons, lambda p: p["value"])

    def geo(s: Column) -> Column:
        return any_of(window(low, s["start"] - 25, s["start"]), vocab.GEO_WORDS)

    def cyrillic(s: Column) -> Column:
        name = N.full_name(s["value"])
        seen = F.exists(known, lambda k: F.contains(k, name) | F.contains(name, k))
        inside = F.exists(others, lambda o: (s["start"] >= o["start"]) & (s["end"] <= o["end"]))
        return ~demo(low, s) & ~inside & ~geo(s) & (seen | V.person_name(s["value"], around(low, s, 60), around(low, s, 80)))

    def latin(s: Column) -> Column:
        return any_of(around(low, s, 80), vocab.LATIN_PERSON_WORDS) & ~demo(low, s)

    def extra(s: Column) -> Column:
        return (F.size(F.split(s["value"], r"\s+")) >= 2) & ~demo(low, s) & ~geo(s)

    keys = [F.transform(F.filter(find_spans(text, p), f), lambda s: N.full_name(s["value"])) for p, f in ((vocab.FIO, cyrillic), (vocab.FIO_LATIN, latin))]
    return F.array_distinct(F.concat(*keys, F.transform(F.filter(persons, extra), lambda s: s["value"])))


def birth_dates(text: Column, low: Column, this_year: int | None = None) -> Column:
    """Spans of dates of birth."""

    def holds(s: Column) -> Column:
        left, right = window(low, s["start"] - 40, s["start"]), window(low, s["end"], s["end"] + 40)
        birth = any_of(left, vocab.BIRTH_WORDS) | any_of(right, vocab.BIRTH_WORDS)
        issue = any_of(left, vocab.NOT_BIRTH_WORDS) | any_of(right, vocab.NOT_BIRTH_WORDS)
        said = F.contains(left, F.lit("дата рождения")) | F.contains(right, F.lit("г. рождения"))
        return V.birth_date_valid(s["value"], this_year) & birth & (~issue | said)

    return F.filter(find_spans(text, vocab.DOB), holds)


def birth_places(text: Column) -> Column:
    return F.filter(find_spans(text, vocab.BIRTH_PLACE), lambda s: around(text, s, 120).rlike(vocab.CAPITALISED))


def addresses(text: Column) -> Column:
    return F.filter(find_spans(text, vocab.ADDRESS_CONTEXT), lambda s: V.address_like(around(text, s, 160)))


def person_counts(text: Column, low: Column, persons: Column | None = None, others: Column | None = None, this_year: int | None = None) -> Column:
    """Counts of names (ten at most), dates and places of birth, and addresses."""
    names = F.least(F.lit(10), F.size(full_names(text, low, persons, others)))
    return counts(обычные=names + F.size(birth_dates(text, low, this_year)) + F.size(birth_places(text)) + F.size(addresses(text)))


def level(c: Column) -> Column:
    """The protection level of category counts."""
    common, state, pay, bio, special = (F.coalesce(c[k], F.lit(0)) for k in vocab.DOC_CATEGORIES)
    return (
        F.when((special != 0) | (bio != 0), vocab.LEVEL_1)
        .when((pay != 0) | (state >= 5), vocab.LEVEL_2)
        .when((state != 0) | (common >= 5), vocab.LEVEL_3)
        .when(common != 0, vocab.LEVEL_4)
        .otherwise(vocab.LEVEL_NONE)
    )


def advice(c: Column, uz: Column) -> Column:
    """Recommendations: the level's, then those of its categories."""
    _, state, pay, bio, special = (F.coalesce(c[k], F.lit(0)) for k in vocab.DOC_CATEGORIES)
    by_level = F.create_map(*[F.lit(x) for pair in vocab.DOC_ADVICE.items() for x in pair])
    return F.array_compact(
        F.array(
            F.try_element_at(by_level, uz),
            F.when(pay != 0, vocab.ADVICE_PAYMENT),
            F.when(state != 0, vocab.ADVICE_STATE),
            F.when((special != 0) | (bio != 0), vocab.ADVICE_SENSITIVE),
        )
    )


def total(c: Column) -> Column:
    """All findings of a text."""
    return sum((c[k] for k in vocab.DOC_CATEGORIES[1:]), c[vocab.DOC_CATEGORIES[0]])


def analyze(df: DataFrame, text: str = "text", gated: bool = True, persons: str | None = None, others: str | None = None, labels: str | None = None, this_year: int | None = None) -> DataFrame:
    """``df`` with ``categories`` (a struct), ``uz``, ``findings_count`` and ``recommendations``.

    ``gated`` decides whether the classifier's counts pass its gate (as in a
    scan) or not.  Built in three projections, which keeps each piece of
    generated code small.
    """
    t, low = F.col("_text"), F.col("_low")
    col = lambda name: F.col(name) if name else None
    special = classifier_counts(low, col(labels)) if gated else keyword_counts(low)
    return (
        df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("_low", F.lower("_text"))
        .withColumns({"_a": regex_counts(t, low), "_b": person_counts(t, low, col(persons), col(others), this_year), "_c": special})
        .withColumn("categories", add(F.col("_a"), F.col("_b"), F.col("_c")))
        .withColumn("uz", level(F.col("categories")))
        .withColumns({"findings_count": total(F.col("categories")), "recommendations": advice(F.col("categories"), F.col("uz"))})
        .drop("_text", "_low", "_a", "_b", "_c")
    )


def as_map(c: Column) -> Column:
    """Counts as ``map<string,int>``."""
    return F.create_map(*[x for k in vocab.DOC_CATEGORIES for x in (F.lit(k), c[k])])


def detected(c: Column) -> Column:
    """The categories found, in reporting order."""
    return F.array_compact(F.array(*[F.when(c[k] > 0, k) for k in vocab.DOC_CATEGORIES]))
