"""Normal forms of values and texts, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .validators import digits


def trim(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def phone(value: Column) -> Column:
    """Digits of a phone number, a leading 8 or none made a 7."""
    d = digits(value)
    return F.when((F.length(d) == 11) & d.rlike("^[78]"), F.concat(F.lit("7"), F.substring(d, 2, 10))).when(F.length(d) == 10, F.concat(F.lit("7"), d)).otherwise(d)


def email(value: Column) -> Column:
    return F.lower(trim(value))


def full_name(value: Column) -> Column:
    return F.lower(trim(F.regexp_replace(value, r"(?U)\s+", " ")))


def finalize(text: Column, limit: int = 200_000) -> Column:
    """``struct<text, truncated>``: blanks squeezed, empty lines at most one in a row, ends trimmed, cut at the limit."""
    plain = trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    return F.struct(F.substring(plain, 1, limit).alias("text"), (F.length(plain) > limit).alias("truncated"))


def heading_hint(heading: Column) -> Column:
    """The word put before the cells of a column, by its heading; the first rule that fits holds."""
    return reduce(lambda acc, rule: F.when(F.coalesce(heading, F.lit("")).rlike(rule[0]), F.lit(rule[1])).otherwise(acc), reversed(vocab.HEADING_HINTS), F.lit(""))


def mixed_script(text: Column) -> Column:
    """Words of both scripts with their Latin signs made Cyrillic; white space kept."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\S+|\s+"), F.lit(0))
    fixed = F.transform(words, lambda w: F.when(w.rlike("[А-Яа-яЁё]") & w.rlike("[A-Za-z]"), F.translate(w, vocab.GLYPHS_FROM, vocab.GLYPHS_TO)).otherwise(w))
    return F.array_join(fixed, "")


def cyrillic_share(text: Column) -> Column:
    """Share of Cyrillic among Cyrillic and Latin letters, 0 where there are none."""
    c, l = (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)) for p in ("[А-Яа-яЁё]", "[A-Za-z]"))
    return F.coalesce(F.try_divide(c, c + l), F.lit(0.0))


def meaningful(text: Column, least: int = 50) -> Column:
    """At least so many letters and digits."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)[^\W_]")) >= least


def result_time(modified: Column) -> Column:
    """``sep 26 18:31``, in the session's time zone."""
    return F.lower(F.date_format(modified, "MMM dd HH:mm"))


def binary_strings(content: Column, least: int = 4, limit: int = 5_000_000) -> Column:
    """Printable runs of bytes, then those of two-byte characters, a line each."""
    text = F.decode(F.substring(content, 1, limit), "ISO-8859-1")
    plain = F.regexp_extract_all(text, F.lit(r"[\x20-\x7E]{%d,}" % least), F.lit(0))
    wide = F.transform(F.regexp_extract_all(text, F.lit(r"(?:[\x20-\x7E]\x00){%d,}" % least), F.lit(0)), lambda x: F.regexp_replace(x, r"\x00", ""))
    return F.array_join(F.concat(plain, wide), "\n")


def chunks(text: Column, size: int = vocab.CHUNK_CHARS) -> Column:
    """Sentences gathered to chunks of at most ``size`` characters; the rest of a longer sentence is left out."""
    plain = trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    parts = F.filter(F.split(plain, r"(?<=[.!?])\s+"), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def gather(acc: Column, part: Column) -> Column:
        joined = F.when(acc["now"] == "", part).otherwise(F.concat_ws(" ", acc["now"], part))
        done = F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        return F.when(F.length(joined) <= size, F.struct(acc["done"].alias("done"), joined.alias("now"))).otherwise(
            F.struct(done.alias("done"), F.substring(part, 1, size).alias("now"))
        )

    return F.aggregate(parts, zero, gather, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
