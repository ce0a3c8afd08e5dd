"""Problem 1: texts that look the same in one consistent form.

Characters of the same look are mapped onto one another (``translate``), and
the mapped values are grouped in SQL under the accent-sensitive Unicode
collation, which takes composed and combining forms for equal.  Each class gets
one canonical member, the most frequent stored text and among those the
smallest, and the canonical text is joined back.

A coarse hash of the text without accents, made in Arrow batches by one table
of the whole Unicode range, finds the few classes with more than one stored
form first, so that only their rows are mapped and collated; copies of one
stored text never meet one another.  Pairs of a large class are formed in parts.

Defined results: a null text stays null; texts without any visible character
form no class and stay as they are; copies of the same stored text are no pair;
repeated rows take part each.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

#: A class is joined with itself in parts of about so many rows.
PART = 5000

# fixed values: characters without a look of their own
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿︎️"
# fixed values: kinds of blank and of hyphen of the same look
BLANKS = "              　"
HYPHENS = "‐‑﹣"
# fixed values: letters of other alphabets and the letter whose shape they have
SHAPES = dict(
    zip("АВЕКМНОРСТУХІЅЈԚԜҮӀЁЇӒӦЀӐӖ", "ABEKMHOPCTYXISJQWYIËÏÄÖÈĂĔ")
) | dict(
    zip("аеорсухіѕјһԁԛԝүӏёїӓӧѐӑӗ", "aeopcyxisjhdqwylëïäöèăĕ")
) | dict(
    zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧΓΠΦονρϲϳ", "ABEZHIKMNOPTYXГПФovpcj")
)


@lru_cache(maxsize=1)
def _shaped() -> tuple[dict[str, str], dict[str, str]]:
    """Composed letters whose base has the shape of another letter: with a composed form of that letter, and with none (base and marks)."""
    one, several = {}, {}
    for c, (base, *marks) in _decompositions().items():
        if base in SHAPES and c not in SHAPES:
            to = unicodedata.normalize("NFC", SHAPES[base] + "".join(marks))
            if len(to) == 1:
                one[c] = to
            else:
                several[c] = unicodedata.normalize("NFD", to)
    return one, several


@lru_cache(maxsize=1)
def _decompositions() -> dict[str, str]:
    """Every character with a canonical decomposition, with it; bounded by the Unicode table."""
    chars = (chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return {c: d for c in chars if (d := unicodedata.normalize("NFD", c)) != c}


class _Coarse(dict):
    """Code points and what the coarse hash takes them for: the plain base of a look-alike, nothing for marks and invisible characters; filled as they come."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if 0x1160 <= code < 0x1200 or 0xD7B0 <= code < 0xD800:  # the later letters of a Korean syllable
            out = ""
        elif c in INVISIBLE or unicodedata.category(c) in ("Mn", "Me", "Cf", "Mc") or unicodedata.combining(c):
            out = ""
        elif c in BLANKS:
            out = " "
        elif c in HYPHENS:
            out = "-"
        elif 0xFF01 <= code < 0xFF5F:
            out = self[code - 0xFEE0]
        else:
            first = unicodedata.normalize("NFD", SHAPES.get(c, c))[0]
            out = first if first == c else self[ord(first)]
        self[code] = out
        return out


_COARSE = _Coarse()


def coarse(text: str) -> str:
    """What equal-looking texts share: the shape, without accents."""
    return text if text.isascii() else text.translate(_COARSE)


def _class(chars) -> str:
    """A class of few ranges that holds at least ``chars``, quick to look for."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ranges and c - ranges[-1][1] < 64:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def _mapped(text: Column) -> Column:
    """The shape but for letters whose base has a Latin shape while they have no composed Latin form."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    one = _shaped()[0]
    source = "".join(SHAPES) + "".join(one) + BLANKS + HYPHENS + wide + INVISIBLE
    target = "".join(SHAPES.values()) + "".join(one.values()) + " " * len(BLANKS) + "-" * len(HYPHENS) + narrow
    return F.translate(text, source, target)


def shape(text: Column) -> Column:
    """The text with characters of the same look made one; accents as stored."""
    several, by_marks = _shaped()[1], {}
    for c, to in several.items():
        by_marks.setdefault(to[1:], []).append(c)
    parted = _mapped(text)
    for marks, letters in by_marks.items():  # the marks are set behind, then the base is exchanged
        parted = F.regexp_replace(parted, f"([{''.join(letters)}])", f"$1{marks}")
    parted = F.translate(parted, "".join(several), "".join(to[0] for to in several.values()))
    return F.when(text.rlike(_class(several)), parted).otherwise(_mapped(text))


def _hashed(texts: DataFrame) -> DataFrame:
    """``texts(rec_table, rec_id, text)`` with the coarse hash ``h``, without texts that show nothing."""

    def run(batches):
        for batch in batches:
            forms = [coarse(t) for t in batch.column(2).to_pylist()]
            shown = pa.array([bool(f) and not f.isspace() for f in forms], pa.bool_())
            h = pa.array([xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass")) - (1 << 63) for f in forms], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, h], names=["rec_table", "rec_id", "text", "h"]).filter(shown)

    rows = texts.select("rec_table", "rec_id", "text").where(F.col("text").isNotNull())
    return spread(rows).mapInArrow(run, "rec_table string, rec_id long, text string, h long")


def _several_forms(texts: DataFrame) -> DataFrame:
    """Rows of ``(rec_table, rec_id, text, shape)`` that share a coarse hash with a different stored text."""
    keyed = _hashed(texts)
    stored = F.xxhash64("text")
    groups = keyed.groupBy("rec_table", "h").agg(F.min(stored).alias("a"), F.max(stored).alias("b")).where("a <> b").select("rec_table", "h")
    # the shape is made anew behind the join, so that a text travels once and not in two forms
    return keyed.join(groups, ["rec_table", "h"], "left_semi").select("rec_table", "rec_id", "text", shape(F.col("text")).alias("shape"))


def classes(texts: DataFrame, leave_out=None) -> DataFrame:
    """``(rec_table, rec_id, text, canonical)`` of rows in classes of several stored forms.

    ``leave_out`` may narrow the candidate rows, for example to sound ones.
    """
    rows = _several_forms(texts)
    if leave_out is not None:
        rows = leave_out(rows)
    spark = texts.sparkSession
    return spark.sql(
        """
        WITH form AS (
            SELECT rec_table, text, any_value(shape COLLATE UNICODE) AS look, count(*) AS n
            FROM {rows} GROUP BY rec_table, text),
        class AS (
            SELECT rec_table, look, count(*) AS forms, min(struct(-n, text)).text AS canonical
            FROM form GROUP BY rec_table, look),
        member AS (
            SELECT f.rec_table, f.text, c.canonical
            FROM form f JOIN class c ON f.rec_table = c.rec_table AND f.look = c.look WHERE c.forms > 1)
        SELECT r.rec_table, r.rec_id, r.text, m.canonical
        FROM {rows} r JOIN member m ON r.rec_table = m.rec_table AND r.text = m.text
        """,
        rows=rows,
    )


def consistent(texts: DataFrame, leave_out=None) -> DataFrame:
    """``(rec_table, rec_id, text)`` with every text in its class's canonical form; ``leave_out`` as of ``classes``."""
    found = classes(texts, leave_out).select("rec_table", "rec_id", "canonical")
    return (
        texts.select("rec_table", "rec_id", "text")
        .join(found, ["rec_table", "rec_id"], "left")
        .select("rec_table", "rec_id", F.coalesce("canonical", "text").alias("text"))
    )


def pairs(members: DataFrame, part: int = PART) -> DataFrame:
    """``(rec_table, id_a, id_b)`` of rows of one class with different stored texts.

    Pairs are formed between the stored forms of a class, never within one, so
    copies of one text stay out of the join.  A class of more than ``part`` rows
    is joined in as many parts as it needs: its rows as first members are dealt
    out over them, as second members they are in each.
    """
    rows = members.select("rec_table", F.xxhash64("canonical").alias("c"), "canonical", "rec_id", "text")
    parts = rows.groupBy("rec_table", "c").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where(F.col("parts") > 1)
    rows = rows.join(parts, ["rec_table", "c"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = rows.withColumn("part", F.pmod(F.xxhash64("rec_id"), F.col("parts")).cast("int")).alias("a")
    b = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("rec_table", "c", "part")]
    return (
        a.join(b, same[0] & same[1] & same[2] & (F.col("a.rec_id") < F.col("b.rec_id")))
        .where("a.text <> b.text AND a.canonical = b.canonical")
        .select(F.col("a.rec_table").alias("rec_table"), F.col("a.rec_id").alias("id_a"), F.col("b.rec_id").alias("id_b"))
    )
