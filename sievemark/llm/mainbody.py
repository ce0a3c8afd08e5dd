"""Problem 2: the main body of web pages by gradient-boosted trees over page-node features.

The tags of these pages are gone, so the tree is rebuilt from what is left: a
page has blocks (runs of lines of one kind between empty ones), a block has
lines, and a line has items (its parts between menu separators).  Each line gets
features of itself, its items, its siblings, its block and its depth on the
page, the density of prose around it, stems that stand for a tag's attributes,
and how common it, its items and its opening are over all pages, as lines and
as names of pages.  Boosted trees give the odds that a line belongs to the body,
others those that a block holds such a line; hierarchical decoding takes the
best choice over the tree of page, blocks and lines that has no contradiction.

The trees are trained on the lines of invented pages (``page_table``), whose
labels are known, and then once more together with at most ``SAMPLE`` pages of
the corpus (those with the smallest hash, at most ``SAMPLE_CHARS`` characters),
labelled by the first trees and the decoding.

Defined results: null, empty and blank pages keep nothing; repeated rows keep
their lines each; a page without surroundings is kept whole, one without a body
keeps nothing.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass

from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import page_table
from .common import Both, digest, ensure_checkpoint_dir, map_batches, with_rare

SAMPLE, SAMPLE_CHARS = 1500, 20_000_000
#: Lines, items and openings that stand on at least this share of pages are broadcast, at most ``60 / COMMON`` of each; rarer ones on two pages or more are joined.
COMMON = 2e-4
#: Items on more than this share of pages are entries of menus; always broadcast.
MENU = 0.01

_ITEMS = re.compile(r"\s*[|·•/»>›→]\s*")
_BULLET = re.compile(r"^(?:[•\-–—*▪◦]|\(?\d{1,3}[.)]|[а-яa-z][.)])\s")
_END = re.compile(r"[.!?…][»”\")]*$")

# fixed values: stems of words that name a page's furniture on any site, by what they speak of; features of a line as a tag's attributes would be
TOKENS = {
    "cookie": "cookie статистик соглас",
    "rights": "© copyright правил права прав. соглашен конфиденц перепечат редакци оферт услови terms privacy закон",
    "site": "сайт портал журнал газет магазин разработ поддержк рассылк соц наверх вверх ошибк опечатк",
    "share": "печат pdf поделит ссылк друз избранн скача закладк слуша share print",
    "meta": "автор просмотр опублик обновл теги метки рейтинг оцен коммент мин. минут ★ views posted текст: фото:",
    "more": "теме тему читайте читать смотрите похож рекоменд подробн ещё раньше more also",
    "ad": "реклам спонсор партнёр партнер промо объявлен",
    "home": "главная home здесь тут:",
}
_TOKENS = [tuple(v.split()) for v in TOKENS.values()]
_TIME = re.compile(r"\d\d?[.:]\d\d")


def key(line: str) -> str:
    """A line without its numbers and names; a long one by the digest of the whole."""
    text = re.sub(r"«[^»]*»", "«»", re.sub(r"\d+", "0", line.strip().lower()))
    return text if len(text) <= 64 else digest(text).hex()


def opening(line: str) -> str:
    """The first words of a line up to its first colon or dash, else its first two."""
    m = re.match(r"^([^:—]{2,30})\s*[:—]\s", line)
    return key(m.group(1) + ":") if m else " ".join(re.sub(r"\d+", "0", line.lower()).split()[:2])


_ARROW = re.compile(r"\s[>/»›→]\s")


def tail(line: str) -> str | None:
    """The last part of a breadcrumb line, which names the page; None for other lines."""
    parts = _ARROW.split(line)
    return parts[-1].strip() if len(parts) > 1 else None


def _items(line: str) -> list[str]:
    """Keys of a line's parts between menu separators; the line's own where it has none."""
    return [key(x) for x in _ITEMS.split(line) if x.strip()] if _ITEMS.search(line) else [key(line)]


#: Tables of counts: lines, items, openings, and names of pages (whole and by their opening).
TABLES = "liot"


class Commons:
    """How many pages hold a line, an item, an opening or are named so; how often prose follows a line, and where it stands."""

    def __init__(self, pages: int, tables: dict[str, dict], prose: dict, places: dict):
        self.pages, self.tables, self.prose, self.places = pages, tables, prose, places

    def share(self, table: str, k: str) -> float:
        return self.tables[table].get(k, 0) / max(1, self.pages)

    def log_share(self, table: str, k: str) -> float:
        return math.log10(self.share(table, k) + 1e-4)

    def rare_keys(self, text: str) -> list[str]:
        """Keys that a page asks for and that are not listed, each behind the letter of its table."""
        return [t + k for t, k in _asked(text) if k not in self.tables[t]]

    def of_page(self, text: str, rare: list[dict] | None) -> Commons:
        """With what was joined for one page."""
        if not rare:
            return self
        by_digest = {r["d"]: r for r in rare}
        tables: dict[str, dict] = {t: {} for t in TABLES}
        prose, places = {}, {}
        for tk in self.rare_keys(text):
            if (r := by_digest.get(digest(tk))) is not None:
                tables[tk[0]][tk[1:]] = r["n"]
                if tk[0] == "l":
                    prose[tk[1:]], places[tk[1:]] = r["prose"], r["place"]
        return Commons(self.pages, {t: Both(tables[t], self.tables[t]) for t in TABLES}, Both(prose, self.prose), Both(places, self.places))

    def covered(self, line: str) -> float:
        """The share of a line's words that are entries of menus, which stand on many pages."""
        words = re.sub(r"\d+", "0", line.lower()).split()
        if not 1 < len(words) <= 30:
            return 0.0
        done = at = 0
        while at < len(words):
            size = next((k for k in (4, 3, 2, 1) if at + k <= len(words) and self.share("i", " ".join(words[at : at + k])) > MENU), 0)
            done += size
            at += size or 1
        return done / len(words)


def page_stats(text: str):
    """``(table, key, followed by prose, place)`` of one page, each key once."""
    infos = [_info(y) for x in text.split("\n") if (y := x.strip())]
    seen = set()
    n = len(infos)
    for i, (k, first_words, items, name, *_) in enumerate(infos):
        if ("l", k) not in seen:
            seen.add(("l", k))
            yield "l", k, float(i + 1 < n and infos[i + 1][4]), i / n
        own = [("i", item) for item in items] + [("o", first_words)]
        if name is not None:
            own += [("t", key(name)), ("t", "o " + opening(name))]
        for tk in own:
            if tk not in seen:
                seen.add(tk)
                yield *tk, 0.0, 0.0


def _asked(text: str) -> set[tuple[str, str]]:
    out = set()
    for line in text.split("\n"):
        if line := line.strip():
            k, o, items = _info(line)[:3]
            out |= {("l", k), ("o", o), ("t", k), ("t", "o " + o), *(("i", x) for x in items)}
    return out


FEATURES = 53 + len(TOKENS)
_SENTENCES = re.compile(r"[.!?…]\s+[А-ЯЁA-Z]")
_INFO: dict[str, tuple] = {}


def _info(v: str) -> tuple:
    """What a line says by itself: key, opening, items, named page, end of a sentence, bullet, and features."""
    if (got := _INFO.get(v)) is not None:
        return got
    low, ends, bullet, items = v.lower(), bool(_END.search(v)), bool(_BULLET.match(v)), _items(v)
    own = (
        math.log1p(len(v)), len(v.split()), ends, v[-1] in ";:", v[:1].islower(), bullet, v.count(" | "), len(items),
        len(_SENTENCES.findall(v)), sum(map(str.isdigit, v)) / len(v), " — " in v, ": " in v, v[:1].isupper(), bool(_TIME.search(v)),
        *(any(t in low for t in own) for own in _TOKENS),
    )
    got = (key(v), opening(v), items or [key(v)], tail(v), ends, bullet, np.array(own, np.float32))
    if len(v) < 120:
        if len(_INFO) > 100_000:
            _INFO.clear()
        _INFO[v] = got
    return got


def features(text: str, commons: Commons) -> tuple[list[int], list[str], np.ndarray]:
    """Line numbers (0-based) and texts of the non-empty lines, and a row of features for each."""
    all_lines = text.split("\n")
    at = [i for i, x in enumerate(all_lines) if x.strip()]
    lines = [all_lines[i].strip() for i in at]
    n = len(lines)
    x = np.zeros((n, FEATURES), np.float32)
    if not n:
        return at, lines, x
    infos = [_info(v) for v in lines]
    keys = [f[0] for f in infos]
    share = [commons.log_share("l", k) for k in keys]
    ends = [f[4] for f in infos]
    block, blocks = [], []
    for j, i in enumerate(at):
        if j and i == at[j - 1] + 1:
            blocks[-1].append(j)
        else:
            blocks.append([j])
        block.append(len(blocks) - 1)
    tails = {f[3] for f in infos if f[3] is not None}
    named = [max(commons.log_share("t", keys[j]), commons.log_share("t", "o " + infos[j][1])) if len(v) < 120 else -4.0 for j, v in enumerate(lines)]
    title = next((j for j in range(n) if lines[j] in tails), -1)
    common = [j for j in range(n) if share[j] > -2.2]
    # a side column's head: common, in the page's middle, not followed by prose
    heads = [
        j for j in common
        if 0.1 < commons.places.get(keys[j], 0) < 0.85 and commons.prose.get(keys[j], 1) < 0.35 and not ends[j] and len(lines[j]) < 40
    ]
    last_common = last_head = -99
    next_common = [99] * (n + 1)
    for j in range(n - 1, -1, -1):
        next_common[j] = 0 if share[j] > -2.2 else min(99, next_common[j + 1] + 1)
    first_prose = next((j for j in range(n) if ends[j] and share[j] <= -2.2 and len(lines[j]) > 60), -1)
    last_prose = next((j for j in range(n - 1, -1, -1) if ends[j] and share[j] <= -2.2 and len(lines[j]) > 60), -1)
    head_set = set(heads)
    last_named = next((j for j in range((first_prose if first_prose >= 0 else n) - 1, -1, -1) if named[j] > -3.0), -1)
    # how much prose lies near, before and after; how long the run of heading-like lines is that a line is in
    dense = [0.0, *accumulate(min(len(v), 400) / 100 if ends[j] and len(v) > 60 else 0.0 for j, v in enumerate(lines))]
    heads_run, j = [0] * n, 0
    while j < n:
        i = j
        while i < n and not ends[i] and lines[i][-1] not in ";:" and not infos[i][5]:
            i += 1
        for x_ in range(j, i):
            heads_run[x_] = i - j
        j = max(i, j + 1)
    of_block = [(len(b), sum(len(lines[i]) for i in b) / len(b), sum(ends[i] for i in b) / len(b), max(share[i] for i in b)) for b in blocks]
    for j, v in enumerate(lines):
        _, first_words, parts, _, _, _, own = infos[j]
        size, mean_length, prose_share, most_common = of_block[block[j]]
        shares = [commons.share("i", p) for p in parts]
        x[j, : len(own)] = own
        x[j, len(own) :] = (
            share[j], share[j - 1] if j else 0, share[j + 1] if j + 1 < n else 0, j / n, v in tails,
            ends[j - 1] if j else 0, ends[j + 1] if j + 1 < n else 0, ends[j + 2] if j + 2 < n else 0, ends[j - 2] if j > 1 else 0,
            size, mean_length, prose_share,
            min(20, j - last_common), min(20, next_common[j]), max(-20, min(20, j - title)) if title >= 0 else -30,
            commons.log_share("o", first_words), sum(q > 0.02 for q in shares) / len(parts), math.log10(max(shares) + 1e-4),
            commons.prose.get(keys[j], -1), commons.places.get(keys[j], -1), min(20, j - last_head) if last_head >= 0 else 25, j in head_set,
            j - first_prose if first_prose >= 0 else -40, j - last_prose if last_prose >= 0 else 40,
            most_common, title >= 0, len(lines[j + 1]) if j + 1 < n else 0,
            dense[min(n, j + 4)] - dense[j + 1 if j + 1 < n else n], dense[j] - dense[max(0, j - 3)], dense[n] - dense[j], dense[j], n - j, heads_run[j],
            named[j], named[j + 1] if j + 1 < n else -5, named[j + 2] if j + 2 < n else -5, named[j - 1] if j else -5, last_named == j, commons.covered(v) if not ends[j] else 0,
        )
        if j in head_set:
            last_head = j
        elif share[j] > -2.2:
            last_common = j
            if last_head >= 0 and commons.places.get(keys[j], 0) > 0.7:
                last_head = -99
        if title == j:
            last_head = -99
    return at, lines, x


class Trees:
    """Gradient-boosted regression trees on the logistic loss, by histograms of at most 32 bins; each tree sees ``bag`` rows at random."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.2, least: int = 20, bag: int = 10_000):
        self.rounds, self.depth, self.rate, self.least, self.bag = rounds, depth, rate, least, bag
        self.trees: list[list[tuple]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base = math.log(p / (1 - p))
        if not len(y) or y.min() == y.max():
            self.base = 6.0 if len(y) and y.min() else -6.0 if len(y) else 0.0
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
        # bins of all features side by side, 32 each, so that one count makes all histograms of a node
        bins = np.stack([32 * f + np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1).astype(np.int32)
        score = np.full(len(y), self.base)
        rng = np.random.default_rng(7)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            tree: list[tuple] = []
            rows = np.sort(rng.choice(len(y), self.bag, replace=False)) if len(y) > self.bag else np.arange(len(y))
            self._grow(tree, rows, bins, cuts, g, h, 0)
            self._add(tree, 0, np.arange(len(y)), x, score)
            self.trees.append(tree)
        return self

    def _grow(self, tree, rows, bins, cuts, g, h, depth) -> int:
        place = len(tree)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-3, None, None)
        if depth < self.depth and len(rows) >= 2 * self.least:
            own, width = bins[rows].ravel(), bins.shape[1]

            def below(weights=None):
                total = np.bincount(own, None if weights is None else np.repeat(weights[rows], width), 32 * width)
                return np.cumsum(total.reshape(width, 32), 1)

            gl, hl, nl = below(g), below(h), below()
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
            f, k = divmod(int(gain.argmax()), 32)
            if gain[f, k] > best[0] and k < len(cuts[f]):
                best = (float(gain[f, k]), f, k)
        if best[1] is None:
            value = self.rate * gs / (hs + 1)
            tree.append((-1, 0.0, 0, 0, value))
            return place
        _, f, k = best
        tree.append(None)
        left = bins[rows, f] <= 32 * f + k
        a = self._grow(tree, rows[left], bins, cuts, g, h, depth + 1)
        b = self._grow(tree, rows[~left], bins, cuts, g, h, depth + 1)
        tree[place] = (f, float(cuts[f][k]), a, b, 0.0)
        return place

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        for tree in self.trees:
            self._add(tree, 0, np.arange(len(x)), x, out)
        return out

    def _add(self, tree, node, rows, x, out) -> None:
        f, cut, a, b, value = tree[node]
        if f < 0:
            out[rows] += value
        elif len(rows):
            left = x[rows, f] <= cut
            self._add(tree, a, rows[left], x, out)
            self._add(tree, b, rows[~left], x, out)


def blocks_of(at: list[int], lines: list[str]) -> list[tuple[int, int]]:
    """Blocks ``[a, b)`` of a page's lines: runs of one kind (headings, prose, lists, table rows) between empty lines."""

    def sort(v: str) -> int:
        _, _, _, _, ends, bullet, _ = _info(v)
        return 2 if bullet or v[-1] in ";:" else 3 if " | " in v else 1 if ends else 0

    out, start = [], 0
    kinds = [sort(v) for v in lines]
    for j in range(1, len(lines) + 1):
        if j == len(lines) or kinds[j] != kinds[j - 1] or at[j] != at[j - 1] + 1:
            out.append((start, j))
            start = j
    return out


def block_features(x: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """A row for each block: its size, and the mean and the highest of its lines' features."""
    if not blocks:
        return np.zeros((0, 2 * x.shape[1] + 1), np.float32)
    starts = [a for a, _ in blocks]
    size = np.array([b - a for a, b in blocks], np.float32)
    return np.concatenate([size[:, None], np.add.reduceat(x, starts, 0) / size[:, None], np.maximum.reduceat(x, starts, 0)], 1)


@dataclass
class Model:
    """Odds of lines to belong to the body, and of blocks to hold a line that does."""

    lines: Trees
    blocks: Trees

    def decide(self, parts: list[tuple[list[int], list[str], np.ndarray]]) -> list[list[int]]:
        """Lines kept of each page ``(places, lines, features)``."""
        own = [blocks_of(at, lines) for at, lines, _ in parts]
        full = [p for p in parts if p[1]]
        if not full:
            return [[] for _ in parts]
        line_odds = self.lines.odds(np.concatenate([x for *_, x in parts]))
        block_odds = self.blocks.odds(np.concatenate([block_features(x, b) for (*_, x), b in zip(parts, own) if b]))
        out, n, m = [], 0, 0
        for (_, lines, x), blocks in zip(parts, own):
            out.append(decode(line_odds[n : n + len(x)], lines, blocks, block_odds[m : m + len(blocks)]))
            n, m = n + len(x), m + len(blocks)
        return out


def fit(parts: list[tuple[list[int], list[str], np.ndarray]], labels: list) -> Model:
    """Trees of both levels from labelled pages."""
    xs, ys, bx, by = [np.zeros((0, FEATURES), np.float32)], [np.zeros(0)], [np.zeros((0, 2 * FEATURES + 1), np.float32)], [np.zeros(0)]
    for (at, lines, x), y in zip(parts, labels):
        if lines:
            blocks, y = blocks_of(at, lines), np.asarray(y, float)
            xs.append(x)
            ys.append(y)
            bx.append(block_features(x, blocks))
            by.append(np.array([y[a:b].max() for a, b in blocks]))
    return Model(Trees().fit(np.concatenate(xs), np.concatenate(ys)), Trees(rounds=40).fit(np.concatenate(bx), np.concatenate(by)))


#: What a block inside the body that does not belong to it costs, and how much a block's own odds count beside its lines'.
BRIDGE, BLOCK_WEIGHT = 0.4, 1.0


def decode(odds: np.ndarray, lines: list[str] | None = None, blocks: list[tuple[int, int]] | None = None, block_odds: np.ndarray | None = None) -> list[int]:
    """Lines kept: the best choice over the tree of page, blocks and lines in which no line is kept without its block, and no block outside the page's one region.

    From below, a block is worth its own odds and those of its best lines, at
    least one; from above, the region is the run of blocks of the highest
    total, in which a block that is dropped costs at most ``BRIDGE`` a line, so
    a link between paragraphs does not end it and a long side column does.
    Without blocks, every line is one.
    """
    n = len(odds)
    blocks = blocks if blocks is not None else [(j, j + 1) for j in range(n)]
    own = np.clip(odds, -4.0, 4.0).tolist()
    worth, kept_of = [], []
    for k, (a, b) in enumerate(blocks):
        best = [j for j in range(a, b) if own[j] > 0] or [max(range(a, b), key=own.__getitem__)]
        value = sum(own[j] for j in best) + (BLOCK_WEIGHT * float(np.clip(block_odds[k], -4.0, 4.0)) if block_odds is not None else 0.0)
        value -= sum(min(BRIDGE, -own[j]) for j in range(a, b) if own[j] < 0 and j not in best)
        left = -sum(min(BRIDGE, max(0.0, -own[j])) if own[j] < 0 else 0.3 for j in range(a, b))  # dropped
        worth.append(max(value, left))
        kept_of.append(best if value > left else [])
    top, region, total, start = 0.0, None, 0.0, 0
    for k, v in enumerate(worth):
        if total <= 0:
            total, start = 0.0, k
        total += v
        if total > top:
            top, region = total, (start, k)
    if region is None:
        return []
    kept = [j for k in range(region[0], region[1] + 1) for j in kept_of[k]]
    if lines is None or not kept:
        return kept
    # a body has its headline before it, unless nothing there could be one
    first = lines[kept[0]]
    plain = bool(_END.search(first)) or first.endswith((";", ":")) or bool(_BULLET.match(first)) or " | " in first
    above = [i for i in range(max(0, kept[0] - 4), kept[0]) if odds[i] > (-2.7 if plain else -1.0) and not _END.search(lines[i]) and len(lines[i]) > 8]
    if above:
        kept.insert(0, max(above, key=lambda i: odds[i]))
    return kept


def commons_of(pages: DataFrame, common: float = COMMON) -> tuple[Commons, DataFrame | None]:
    """Counts over all pages: listed are keys on at least ``common`` of them and at least two; and the rest on at least two by digest, None if there can be none."""

    def run(cols):
        out = {k: [] for k in ("t", "k", "prose", "place")}
        for text in cols["text"]:
            for row in page_stats(text or ""):
                for k, v in zip(out, row):
                    out[k].append(v)
        return out

    rows = pages.select("text").where(F.col("text").isNotNull())
    n = rows.count()
    least = max(2, math.ceil(common * n))
    stats = (
        map_batches(rows, run, "t string, k string, prose double, place double")
        .groupBy("t", "k")
        .agg(F.count("*").alias("n"), F.avg("prose").alias("prose"), F.avg("place").alias("place"))
        .where(F.col("n") >= 2)
    )
    listed = (F.col("n") >= least) | ((F.col("t") == "i") & (F.col("n") > MENU * n))
    rare = None
    if least > 2:
        ensure_checkpoint_dir(pages.sparkSession)
        stats = stats.checkpoint()
        rare = stats.where(~listed).select(F.unhex(F.md5(F.concat("t", "k"))).alias("d"), "n", "prose", "place")
    tables: dict[str, dict] = {t: {} for t in TABLES}
    prose, places = {}, {}
    for r in stats.where(listed).collect():
        tables[r["t"]][r["k"]] = r["n"]
        if r["t"] == "l":
            prose[r["k"]], places[r["k"]] = r["prose"], r["place"]
    return Commons(n, tables, prose, places), rare


def count_locally(texts: list[str]) -> Commons:
    """What ``commons_of`` gives, for a list of pages."""
    tables: dict[str, Counter] = {t: Counter() for t in TABLES}
    prose, places = Counter(), Counter()
    for text in texts:
        for t, k, follows, place in page_stats(text):
            tables[t][k] += 1
            if t == "l":
                prose[k] += follows
                places[k] += place
    often = {t: {k: n for k, n in c.items() if n > 1} for t, c in tables.items()}
    return Commons(len(texts), often, {k: prose[k] / n for k, n in often["l"].items()}, {k: places[k] / n for k, n in often["l"].items()})


@lru_cache(maxsize=1)
def invented() -> tuple[list, list]:
    """Invented pages as ``(places, lines, features)``, and their labels, in sets of different size and number of sites."""
    parts, labels = [], []
    for seed, (count, sites) in enumerate(((550, 40), (250, 20), (150, 50), *((40, 1),) * 6), 11):
        made = page_table.pages(count, seed, sites)
        own = count_locally([t for t, _ in made])
        parts += [features(t, own) for t, _ in made]
        labels += [y for _, y in made]
    return parts, labels


@lru_cache(maxsize=1)
def first_model() -> Model:
    return fit(*invented())


def train(sample: list[str], commons: list[Commons]) -> Model:
    """Trees of the invented pages, then of these and the sample pages as the first trees and the decoding see them."""
    parts, labels = invented()
    own = [features(text, c) for text, c in zip(sample, commons)]
    kept = first_model().decide(own)
    return fit(parts + own, labels + [[j in k for j in range(len(lines))] for (_, lines, _), k in zip(own, map(set, kept))])


_STATE: dict[str, tuple[Commons, Model]] = {}


def _with_commons(rows: DataFrame, commons: Commons, rare: DataFrame | None) -> DataFrame:
    if rare is None:
        return rows
    sent = rows.sparkSession.sparkContext.broadcast(commons)
    return with_rare(rows, rare, lambda text: sent.value.rare_keys(text))


def keep_lines(pages: DataFrame, sample: int = SAMPLE, common: float = COMMON) -> DataFrame:
    """``(content_id, line_no from 1)`` of the lines to keep of ``pages(content_id, text)``."""
    rows = pages.select("content_id", "text").where(F.col("text").isNotNull())
    commons, rare = commons_of(rows, common)
    chosen = rows.orderBy(F.xxhash64("content_id"), "content_id").limit(sample)
    total = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("content_id"), "content_id"))
    chosen = chosen.withColumn("_size", total).where(F.col("_size") <= SAMPLE_CHARS).drop("_size").collect()
    if rare is not None:
        few = pages.sparkSession.createDataFrame(chosen, rows.schema)
        chosen = _with_commons(few, commons, rare).orderBy(F.xxhash64("content_id"), "content_id").collect()
    of_chosen = [commons.of_page(r["text"], r["rare"] if rare is not None else None) for r in chosen]
    sent = pages.sparkSession.sparkContext.broadcast((commons, train([r["text"] for r in chosen], of_chosen)))
    name = uuid.uuid4().hex

    def run(cols):
        if name not in _STATE:
            _STATE.clear()
            _STATE[name] = sent.value
        own, model = _STATE[name]
        lists = cols.get("rare") or [None] * len(cols["text"])
        parts = [features(t, own.of_page(t, r)) for t, r in zip(cols["text"], lists)]
        out = {"content_id": [], "line_no": []}
        for i, (at, _, _), kept in zip(cols["content_id"], parts, model.decide(parts)):
            out["content_id"] += [i] * len(kept)
            out["line_no"] += [at[k] + 1 for k in kept]
        return out

    return map_batches(_with_commons(rows, commons, rare), run, "content_id long, line_no int")
