"""Matches with their places, as columns.

``regexp_extract_all`` knows no offsets; the text between the matches
(``split``) gives them back, so no Python is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<value:string,start:int,end:int>>"


def find_spans(text: Column, regex: str) -> Column:
    """All matches of ``regex`` left to right as ``(value, start, end)``, in code points from 0; empty for null.

    The search for places runs only where there is a match at all.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"), F.split(text, regex, -1).alias("g"))

    def places(x: Column) -> Column:
        def span(value: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(x["g"], F.lit(1), i + 1), F.lit(0), lambda a, y: a + F.length(y))
            matched = F.aggregate(F.slice(x["m"], F.lit(1), i), F.lit(0), lambda a, y: a + F.length(y))
            start = before + matched
            return F.struct(value.alias("value"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"))

        return F.transform(x["m"], span)

    # bound to a lambda's variable, matches and gaps are computed once a text, not once a match
    return F.when(text.rlike(regex), F.element_at(F.transform(F.array(both), places), 1)).otherwise(F.array().cast(SPANS))


def window(text: Column, start: Column, end: Column) -> Column:
    """The characters ``[start, end)``; a start before the text counts as its beginning."""
    first = F.greatest(start, F.lit(0))
    return F.substring(text, first + 1, F.greatest(end - first, F.lit(0)))


def around(text: Column, s: Column, radius: int) -> Column:
    """A match with ``radius`` characters on either side."""
    return window(text, s["start"] - radius, s["end"] + radius)


def about_start(text: Column, s: Column, radius: int) -> Column:
    """``radius`` characters to either side of where a match begins, whatever its length."""
    return window(text, s["start"] - radius, s["start"] + radius)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Does the text contain one of the words?

    One alternation instead of a search for each word: ``text`` is often a
    window that would have to be cut out anew for every one of them.
    """
    return text.rlike("|".join(rf"\Q{w}\E" for w in words))


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text contains, each counted once."""
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words))
