"""Problem 9: evaluation passages inside corpus documents, by Wu-Manber search over words.

Texts are compared as sequences of words in a form that ignores letter case,
punctuation, spacing, line breaks, invisible characters and same-shaped
letters.  A stretch of ``min_words`` words with at most one exchanged word in
any ``spacing`` always holds an exact run of at least ``seed`` words, so all
runs of ``seed`` words of all items are the patterns of the search: a shift
table over word pairs skips impossible places, suffix buckets select patterns,
direct comparison confirms the run, and the alignment of the hit is then
compared word by word for a whole stretch.

Defined results: null, empty and blank texts (documents or items) match
nothing, nor does an item of fewer than ``min_words`` words; repeated rows are
reported each; an item is reported once a document; ids may be null.
"""

from __future__ import annotations

import re
import unicodedata
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

MIN_WORDS, SPACING, SEED, BLOCK = 10, 7, 5, 2
#: Items are searched in blocks of at most so many characters each, which bounds what is sent to an executor.
BLOCK_CHARS = 8_000_000

# fixed values: capital letters of Cyrillic and Greek with the shape of a Latin one
_SHAPES = dict(zip("АВЕКМНОРСТУХІЅЈԚԜҮ", "ABEKMHOPCTYXISJQWY")) | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"))
# fixed values: characters without a look of their own
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿︎️"
_REMOVE = str.maketrans({**dict.fromkeys(_INVISIBLE, ""), **{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}})
_ODD = re.compile(rf"[{_INVISIBLE}̀-ͯ！-～]")
_WORDS = re.compile(r"\w+")


class _Forms(dict):
    """Words with same-shaped letters replaced; emptied when it grows large, so its size is bounded."""

    _shapes = str.maketrans(_SHAPES)

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[word] = form = word.translate(self._shapes)
        return form


_FORMS = _Forms()


def words(text: str | None) -> list[str]:
    """The words of a text in the form in which they are compared."""
    if not text:
        return []
    if _ODD.search(text):
        text = unicodedata.normalize("NFC", text.translate(_REMOVE))
    return list(map(_FORMS.__getitem__, _WORDS.findall(text.upper())))


class WuManber:
    """Many patterns of words, all at least ``seed`` words long, found in one pass over a word list."""

    def __init__(self, patterns: list[tuple[tuple[str, ...], tuple[int, int]]], seed: int = SEED, block: int = BLOCK):
        self.seed, self.block = seed, block
        self.default = seed - block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple[int, int]]]] = {}
        for pattern, where in patterns:
            head = pattern[:seed]
            for end in range(block, seed + 1):
                key = head[end - block : end]
                self.shift[key] = min(self.shift.get(key, self.default), seed - end)
            self.buckets.setdefault(head[seed - block :], {}).setdefault(head, []).append(where)

    def hits(self, text: list[str]):
        """``(place, where)`` of every pattern's first ``seed`` words found."""
        shift, default, seed = self.shift.get, self.default, self.seed
        at, n = seed - 1, len(text)
        while at < n:
            key = (text[at - 1], text[at])
            step = shift(key, default)
            if step:
                at += step
                continue
            start = at - seed + 1
            for where in self.buckets.get(key, {}).get(tuple(text[start : at + 1]), ()):
                yield start, where
            at += 1


def _order(i: int | None) -> tuple[bool, int]:
    """Ids in their order, null last."""
    return i is None, i or 0


def holds_stretch(same: list[bool], min_words: int = MIN_WORDS, spacing: int = SPACING) -> bool:
    """Is there a stretch of ``min_words`` that begins and ends with equal words, with at most one unequal in any ``spacing``?"""
    start, last = 0, None  # the stretch's first word; its last unequal word
    end = -1  # the stretch's last equal word
    for i, ok in enumerate(same):
        if ok:
            if end < start:
                start = i
            end = i
            if end - start + 1 >= min_words:
                return True
        else:
            if end < start:  # nothing equal so far
                start, last = i + 1, None
                continue
            if last is not None and i - last < spacing:
                start = last + 1
            last = i
            if end < start:
                start, last = i + 1, None
    return False


class Leaks:
    """The items of one block, ready to search."""

    def __init__(self, items: list[tuple[int, str | None]], min_words: int = MIN_WORDS, spacing: int = SPACING, seed: int = SEED):
        self.min_words, self.spacing = min_words, spacing
        self.items = [(i, w) for i, text in items if len(w := words(text)) >= min_words]
        self.search = WuManber([(tuple(w[p : p + seed]), (k, p)) for k, (_, w) in enumerate(self.items) for p in range(len(w) - seed + 1)], seed)

    def of(self, text: str | None) -> list[int]:
        own = words(text)
        seen: set[tuple[int, int]] = set()
        found: set[int] = set()
        for place, (k, p) in self.search.hits(own):
            if k in found or (k, place - p) in seen:
                continue
            seen.add((k, place - p))
            item = self.items[k][1]
            a, b = max(0, place - p), max(0, p - place)
            same = [x == y for x, y in zip(own[a:], item[b:])]
            if holds_stretch(same, self.min_words, self.spacing):
                found.add(k)
        return sorted({self.items[k][0] for k in found}, key=_order)


_STATE: dict[str, Leaks] = {}


def leaked_items(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, spacing: int = SPACING, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id)`` of every document that holds a stretch of an item.

    Held-out sets are small beside a corpus, but nothing here relies on it:
    the items' sizes are summed first, and the items go out in as many blocks
    of at most ``block_chars`` as they need, each searched in one narrow pass
    over the documents.
    """
    seed = SEED
    # an exact run of ``seed`` words must exist in every stretch
    if min_words < 2 * seed or spacing < seed + 1:
        raise ValueError("the stretch must hold an exact run of the seed's length")
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).where(F.col("_text").isNotNull())
    out = None
    for b in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        # a broadcast's value lies in a file, so the driver holds one block at a time, and so does a worker
        sent = docs.sparkSession.sparkContext.broadcast(tuple(sorted(((r[0], r[1]) for r in part.toLocalIterator()), key=lambda x: (_order(x[0]), x[1]))))
        name = uuid.uuid4().hex

        def run(cols, sent=sent, name=name):
            if name not in _STATE:
                _STATE.clear()
                _STATE[name] = Leaks(list(sent.value), min_words, spacing, seed)
            leaks = _STATE[name]
            ids, found = [], []
            for i, text in zip(cols["doc_id"], cols["_text"]):
                own = leaks.of(text)
                ids += [i] * len(own)
                found += own
            return {"doc_id": ids, "item_id": found}

        one = map_batches(rows, run, "doc_id long, item_id long")
        out = one if out is None else out.unionByName(one)
    return out
