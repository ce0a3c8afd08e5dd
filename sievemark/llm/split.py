"""Problem 3: oversized texts cut into overlapping pieces by pointer doubling.

Every possible cut is a boundary of a kind: paragraph, line, sentence, word,
or, where a window holds none, the bare character position.  Each boundary is
joined to its farthest legal successor, that is the last boundary of the best
kind within ``limit`` characters of the piece that the boundary starts, the
overlap included.  Legal are first the boundaries of the window's second half,
so that pieces are not short for an early paragraph end; those of its first
half only where the second holds none.  Squaring the successor table k times gives the boundary
2**k cuts ahead of every boundary, so the whole greedy chain of a text comes
from log2(cuts) table look-ups instead of a walk.

Defined results: texts of at most ``limit`` code points and null texts give no
pieces; every piece but the first repeats the last ``overlap`` code points of
the one before; pieces joined without the overlaps give back the text exactly.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

LIMIT, OVERLAP = 3000, 200

# kinds of boundary, best first; a boundary lies after the match
_KINDS = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[.!?…。！？।؟]+[\"'»”’)\]」』]*\s+|[。！？।]+[”」』）]*"),
    re.compile(r"\s+"),
)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions (the end included) and the kind of each, 0 best."""
    n = len(text)
    kind = np.full(n + 1, len(_KINDS), np.int8)
    for k in range(len(_KINDS) - 1, -1, -1):
        ends = np.fromiter((m.end() for m in _KINDS[k].finditer(text)), np.int64)
        kind[ends] = k
    kind[n] = -1
    pos = np.flatnonzero(kind < len(_KINDS))
    return pos, kind[pos]


def successors(pos: np.ndarray, kind: np.ndarray, n: int, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all cuts (0, natural ones and bare ones) and, for each, the index of its farthest legal successor.

    A cut at c starts its next piece at ``c - overlap`` (the first piece at 0),
    which may reach to ``c - overlap + limit``; a successor lies beyond c.
    """
    starts = [0]
    table: dict[int, int] = {}
    by_kind = [pos[kind == k] for k in range(-1, len(_KINDS))]

    def farthest(cuts: np.ndarray) -> np.ndarray:
        begin = np.where(cuts == 0, 0, cuts - overlap)
        reach = np.minimum(begin + limit, n)
        best = reach.copy()
        open_ = np.ones(len(cuts), bool)
        # a cut must leave a new piece that is longer than the overlap
        for least in (np.maximum(overlap, limit // 2), overlap):
            for own in by_kind:
                if not len(own):
                    continue
                at = np.searchsorted(own, reach, side="right") - 1
                place = own[np.maximum(at, 0)]
                found = open_ & (at >= 0) & (place > cuts) & (place - begin > least)
                best[found] = place[found]
                open_ &= ~found
        return best

    # natural boundaries all get a successor; a bare successor is a new cut and needs its own
    todo = np.unique(np.concatenate([np.array(starts), pos[pos < n]]))
    while len(todo):
        nxt = farthest(todo)
        table.update(zip(todo.tolist(), nxt.tolist()))
        todo = np.array(sorted({x for x in nxt.tolist() if x < n and x not in table}), np.int64)
    cuts = np.array(sorted({*table, n}), np.int64)
    succ = np.searchsorted(cuts, np.array([table.get(c, n) for c in cuts.tolist()], np.int64))
    return cuts, succ


def greedy_cuts(succ: np.ndarray) -> np.ndarray:
    """Indices of the chain from boundary 0 to the last one, by squaring the successor table."""
    last = len(succ) - 1
    chain, jump = np.array([0]), succ
    while chain[-1] != last:
        chain = np.concatenate([chain, jump[chain]])  # the next 2**k members of the chain, in order
        jump = jump[jump]
        if (end := np.flatnonzero(chain == last)).size:
            chain = chain[: end[0] + 1]
    return chain


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of a text, half open, in code points."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    cuts, succ = successors(*boundaries(text), n, limit, overlap)
    ends = cuts[greedy_cuts(succ)][1:]
    begins = np.concatenate([[0], ends[:-1] - overlap])
    return list(zip(begins.tolist(), ends.tolist()))


def split_oversized(contents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, id_col: str = "content_id", text_col: str = "text") -> DataFrame:
    """``(id, piece_no from 1, start_pos from 1, end_pos, piece)`` of all texts longer than ``limit``; no shuffle."""

    def run(cols):
        out = {k: [] for k in (id_col, "piece_no", "start_pos", "end_pos", "piece")}
        for i, text in zip(cols[id_col], cols["_text"]):
            for no, (a, b) in enumerate(pieces(text, limit, overlap), 1):
                for k, v in zip(out, (i, no, a + 1, b, text[a:b])):
                    out[k].append(v)
        return out

    long_rows = contents.where(F.length(text_col) > limit).select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))
    return map_batches(long_rows, run, f"{id_col} long, piece_no int, start_pos int, end_pos int, piece string")
