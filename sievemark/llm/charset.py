"""Problem 6: texts garbled by a wrong character set.

1. Counts of adjacent character pairs over the whole corpus give the mutual
   information of every pair against the marginals of its two characters.  A
   first count tells rows of mostly improbable pairs, a second one leaves them
   out, so that garbled text does not vouch for itself.  Characters that usual
   rows hardly have count with the marginal of an even alphabet: their own
   would make garbled text, which has an alphabet of its own, look normal.
2. Pairs far below the usual mutual information score positive, others
   negative; maximum-scoring segments of a text are its improbable runs.
3. Only inside those runs (widened to whole tokens) the inverse mappings are
   tested: the characters go back to bytes by the wrong set and are read by the
   right one, up to two times.  A mapping holds if the result is free of
   improbable runs, coherent in script, and far more probable.
4. Runs in which letters became replacement or question marks are named too,
   inside the same segments; these cannot be restored.

Pairs are kept by class (letter case folded, digits alike, rare code points
hashed), so the table has at most ``CLASSES ** 2`` entries whatever the corpus.

Defined results: null, empty and blank texts are never affected; repeated rows
are reported each; texts in rare letters or other languages are not affected.
"""

from __future__ import annotations

import codecs
import re
import uuid
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

CLASSES = 2048
_PLAIN = 1536  # code points below this have a class of their own
#: A pair scores its information beyond the corpus mean plus this many nats.
MARGIN = 3.0
#: A segment counts as improbable from this score on.
SEGMENT = 4.0
#: Extra score of a capital letter inside a word after a small one.
CASE_BREAK = 8.0
#: A row is usual if its pairs hold at most this much more information than the corpus mean.
USUAL = 0.8
#: So many characters of a run are tried with all mappings at once, then the next ones.
PROBE = 80
#: The least information an inverse mapping must save.
GAIN = 6.0


# fixed values: characters without a look of their own, which are no sign of a wrong set
_UNSEEN = "\xad\u200b\u200c\u200d\u2060\ufeff"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cls = np.empty(0x10000, np.uint16)
    lower = np.zeros(0x10000, bool)
    upper = np.zeros(0x10000, bool)
    for cp in range(0x10000):
        c = chr(cp)
        if c.islower():
            lower[cp] = True
        elif c.isupper():
            upper[cp] = True
        if 0xD800 <= cp < 0xE000:
            f = 0xFFFD
        elif c.isdigit() and cp < 128:
            f = ord("0")
        elif c.isspace() and cp not in (0x85, 0x1C, 0x1D, 0x1E, 0x1F) or c in _UNSEEN:
            f = ord(" ")
        else:
            low = c.lower()
            f = ord(low) if len(low) == 1 else cp
        cls[cp] = f if f < _PLAIN else _PLAIN + f % (CLASSES - _PLAIN)
    return cls, lower, upper


@lru_cache(maxsize=1)
def tables():
    return _tables()


def codes_of(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(a):
        return np.empty(0, np.uint16)
    # code points beyond the first plane stand in the private area, so that they too fall into the classes of rare ones
    return np.where(a > 0xFFFF, 0xE000 + a % 0x1900, a).astype(np.uint16)


def batch_codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column, a line end before, between and after the rows, and the places of those line ends."""
    texts = col.fill_null("").to_pylist()
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=ends[1:])
    return codes_of("\n".join(["", *texts, ""])), ends


def pair_keys(codes: np.ndarray) -> np.ndarray:
    """Keys of the adjacent pairs: entry i is the pair (i, i + 1)."""
    cls = tables()[0][codes].astype(np.int32)
    return cls[:-1] * CLASSES + cls[1:]


def case_breaks(codes: np.ndarray) -> np.ndarray:
    _, lower, upper = tables()
    return lower[codes[:-1]] & upper[codes[1:]]


class Model:
    """Information of character pairs, from their counts over a corpus."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        total = max(1.0, float(counts.sum()))
        # an unseen pair counts as a third of one; the sum is that of the counts, which is enough here
        self.info = np.full(CLASSES * CLASSES, np.log(total) - np.log(1 / 3), np.float32)
        self.mean = 0.0
        left, right = np.zeros(CLASSES), np.zeros(CLASSES)
        if len(keys):
            self.info[keys] = np.log(total) - np.log(counts)
            self.mean = float((counts * self.info[keys]).sum() / total)
            np.add.at(left, keys // CLASSES, counts)
            np.add.at(right, keys % CLASSES, counts)
        usual = self.info.copy()
        for lost in tables()[0][[0x3F, 0xFFFD]].tolist():  # two marks in a row tell nothing, however often lost letters left them
            usual[lost * CLASSES + lost] = self.info.max()
        # what speaks against a pair: its mutual information, turned round; no marginal is below that of an even alphabet as large as the corpus' own
        marginals = []
        for m in (left / total, right / total):
            seen = m[m > 0]
            even = np.exp((seen * np.log(seen)).sum()) if len(seen) else 1.0
            m[ord(" ")] = 0  # a blank is the edge of a word and tells nothing of the character beside it
            marginals.append(np.log(np.maximum(m, even)).astype(np.float32))
        self.against = (usual.reshape(CLASSES, CLASSES) + marginals[0][:, None] + marginals[1][None]).ravel()
        mean = float((counts * self.against[keys]).sum() / total) if len(keys) else 0.0
        self.bar = mean + MARGIN
        self.promising = lru_cache(maxsize=100_000)(lambda run: promising(run, self))

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Score of each adjacent pair, positive where improbable."""
        if len(codes) < 2:
            return np.empty(0, np.float32)
        s = self.against[pair_keys(codes)] - self.bar
        s[case_breaks(codes)] += CASE_BREAK
        ascii_ = (codes < 128) & (codes != 0x3F)  # a question mark may stand for a lost letter
        s[ascii_[:-1] & ascii_[1:]] = -2.0  # these are the same in all sets
        return np.maximum(s, -4.0)

    def cost(self, text: str) -> float:
        """Information of a text, its edges taken as blanks."""
        codes = codes_of(f" {text} ")
        return float(self.info[pair_keys(codes)].sum() + CASE_BREAK * case_breaks(codes).sum())

    def worst(self, text: str) -> float:
        """The highest segment score of a text."""
        return max((x for _, _, x in segments(self.scores(codes_of(f" {text} ")))), default=0.0)


def segments(scores: np.ndarray, least: float = 0.0) -> list[tuple[int, int, float]]:
    """Maximum-scoring disjoint segments ``(first pair, last pair, score)``, left to right.

    A segment starts at a positive score and ends at its maximum; it is given
    up when its running sum falls to zero or far below the maximum.
    """
    out = []
    n = len(scores)
    positive = np.flatnonzero(scores > 0)
    k = 0
    while k < len(positive):
        i = j = end = int(positive[k])
        total = best = float(scores[i])
        going = True
        while going and j + 1 < n:
            for v in scores[j + 1 : j + 65].tolist():
                j += 1
                total += v
                if total > best:
                    best, end = total, j
                elif total <= 0 or best - total >= 12:
                    going = False
                    break
        if best > least:
            out.append((i, end, best))
        k = int(np.searchsorted(positive, end + 1))
    return out


def best_segments(scores: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The highest segment score of every row of a batch, all rows at once; ``ends`` as of ``batch_codes``.

    A large drop between rows keeps segments from reaching over.
    """
    s = scores.astype(np.float64)
    drop = np.zeros(len(s))
    drop[ends[1:-1]] = 1e4
    sums = np.cumsum(s - drop)
    before = np.concatenate([[0.0], sums[:-1]]) - drop
    return np.maximum.reduceat(sums - np.minimum.accumulate(before), ends[:-1])


# fixed values: sets by which text is read wrongly, and those in which it was written
_WRONG = ("cp1251", "latin-1", "cp1252", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5")
_RIGHT = ("utf-8", "cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5", "cp1252")


@lru_cache(maxsize=32)
def _charmap(charset: str):
    """The set's 256 characters and its inverse; undefined bytes stand for the control characters of their number, as lenient decoders have it."""
    table = "".join(bytes([b]).decode(charset, "ignore") or chr(b) for b in range(256))
    return table, codecs.charmap_build(table)


def back(text: str, wrong: str, right: str) -> str | None:
    """``text`` with the wrong reading undone, or None where that cannot be; a few lost bytes are passed over."""
    try:
        raw = codecs.charmap_encode(text, "strict", _charmap(wrong)[1])[0]
        if right != "utf-8":
            return codecs.charmap_decode(raw, "strict", _charmap(right)[0])[0]
    except UnicodeError:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out = raw.decode("utf-8", "replace")
        lost = out.count("�")
        return out.replace("�", "") if lost and lost * 12 < len(out) else None


_CYRILLIC = re.compile("[Ѐ-ӿ]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_WORD = re.compile(r"[^\W\d_]+")
_ASCII_LETTER = re.compile("[A-Za-z]")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")


def coherent(text: str) -> bool:
    """No word of mixed scripts, no control characters, no capital inside a word after a small letter."""
    if re.search("[\x00-\x08\x0e-\x1f\x7f-\x9f�]", text):
        return False
    for m in _WORD.finditer(text):
        w = m.group()
        if _CYRILLIC.search(w) and _LATIN.search(w):
            return False
    return True


def _telling(text: str, out: str) -> bool:
    """Is a one-to-one mapping more than the exchange of a usual character or two?"""
    changed = [k for k, (a, b) in enumerate(zip(text, out)) if a != b]
    if len(changed) >= max(4, 0.6 * sum(c.isalpha() for c in text)):
        return True
    for k in changed:
        c = text[k]
        if "А" <= c <= "я" or c in "Ёё":
            continue
        if c.isalpha() or re.match(r"\s?[а-яё]", text[k + 1 : k + 3]) and (k == 0 or text[k - 1].isspace()) and out[k].isalpha():
            return True
    return False


Chain = tuple[tuple[str, str], ...]


def apply(text: str, chain: Chain) -> str | None:
    for wrong, right in chain:
        if (text := back(text, wrong, right)) is None:
            return None
    return text


def promising(run: str, model: Model) -> tuple[Chain, ...]:
    """Those chains of inverse mappings that make sense of a run, the best first."""
    cost = model.cost(run)
    found = []
    mixed = any(not w.isascii() and _ASCII_LETTER.search(w) for w in _WORD.findall(run))

    def consider(out: str | None, chain: Chain) -> None:
        if out and out != run and coherent(out) and (new := model.cost(out)) < cost - 2:
            found.append((new, chain))

    for wrong in _WRONG:
        if back(run, wrong, wrong) is None:
            continue  # holds characters that the set has not
        for right in _RIGHT:
            if wrong == right or {wrong, right} == {"latin-1", "cp1252"} or (mixed and right != "utf-8"):
                continue  # a word of two scripts would stay one
            out = back(run, wrong, right)
            consider(out, ((wrong, right),))
            if right == "utf-8" and out is not None:
                for again in _WRONG:
                    consider(back(out, again, "utf-8"), ((wrong, "utf-8"), (again, "utf-8")))
    return tuple(c for _, c in sorted(found, key=lambda x: x[0]))


def holds(text: str, chain: Chain, model: Model) -> str | None:
    """What a chain makes of a part of a text, if that is much more probable and free of improbable runs."""
    out = apply(text, chain)
    if out is None or out == text or not coherent(out):
        return None
    cost = model.cost(text)
    saved = cost - model.cost(out)
    share = 0.12 * cost if len(out) != len(text) else float(sum(a != b for a, b in zip(text, out)))
    if saved < GAIN or saved < share or (len(out) == len(text) and not _telling(text, out)):
        return None
    return out if model.worst(out) < max(SEGMENT, 0.4 * saved) else None


_URLISH = re.compile(r"://|[/=&@]|www\.", re.I)
_IN_WORD = re.compile(r"(?<!\S)\S*(?:[^\W\d_]\?[^\W\d_]|(?<!\S)[«\"„“(]?\?[^\W\d_])\S*")
_ALONE = re.compile(r"(?<!\S)[«\"„“(]?\?[?\-–—.,:;!»\"”)\d]*(?!\S)")


def lost_letters(text: str) -> bool:
    """Did letters of the text become replacement or question marks?"""
    if "�" in text:
        return True
    if "?" not in text:
        return False
    for m in _IN_WORD.finditer(text):
        if not _URLISH.search(m.group()):
            return True
    alone = [m.group() for m in _ALONE.finditer(text)]
    marks = sum(t.count("?") for t in alone)
    return marks >= 4 and (len(alone) > 1 or max(t.count("?") for t in alone) >= 4)


_BLANK = re.compile("[ \t\n\r\u2007\u2009\u202f\u3000]")  # a no-break space may stand for a letter


def _widen(text: str, a: int, b: int, blanks: list[int]) -> tuple[int, int]:
    """To whole tokens, from the first to the last that is not blank."""
    while a < b and text[a].isspace():
        a += 1
    while a < b and text[b - 1].isspace():
        b -= 1
    k, n = bisect_left(blanks, a), bisect_left(blanks, b)
    return blanks[k - 1] + 1 if k else 0, blanks[n] if n < len(blanks) else len(text)


def _probes(run: str):
    """Stretches of a run, of whole tokens where there are any, until all of it was seen."""
    at = 0
    while at < len(run):
        to = at + PROBE
        if to < len(run) and (cut := run.rfind(" ", at + PROBE // 2, to)) > 0:
            to = cut
        yield run[at:to]
        at = to


_STOP = re.compile(r"[.!?…]\s+")


def _units(text: str, a: int, b: int, stops_of: dict[int, list[int]]):
    """Wider and wider parts of the text around a run, the widest first: its line, its sentences, its neighbour words, itself.

    ``stops_of`` keeps the ends of sentences of a line for its other runs.
    """
    left, right = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    right = right if right >= 0 else len(text)
    units = [(left, right)]
    if (stops := stops_of.get(left)) is None:
        stops = stops_of[left] = [left + m.end() for m in _STOP.finditer(text[left:right])]
    before, behind = bisect_right(stops, a), bisect_left(stops, b)
    units.append((stops[before - 1] if before else left, stops[behind] if behind < len(stops) else right))
    x, y = a, b
    if m := re.search(r"(?<!\S)\S{1,2}[^\S\n]$", text[max(0, a - 4) : a]):
        x -= len(m.group())
    if m := re.match(r"[^\S\n]\S{1,2}(?!\S)", text[b : b + 4]):
        y += len(m.group())
    return dict.fromkeys([*units, (x, y), (a, b)])


_RARE_CYRILLIC = re.compile("[Ѐ-Џѐѓ-џҐґ]")


def _explains(text: str, fix: tuple[int, int, str], chain: Chain, runs: list[list[int]], fixes: list[tuple[int, int, str]]) -> bool:
    """A mapping that changes but a few signs must explain all that is odd in its line: another language's letters fit here and there by chance."""
    a, b, out = fix
    if len(out) != b - a:
        return True
    changed = sum(x != y for x, y in zip(text[a:b], out))
    if changed >= max(4, 0.6 * sum(c.isalpha() for c in text[a:b])):
        return True
    left, right = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    right = right if right >= 0 else len(text)
    for x, y in runs:
        if x < left or y > right or any(p <= x and y <= q for p, q, _ in fixes):
            continue
        other = apply(text[x:y], chain)
        if (other is not None and other != text[x:y]) or (other is None and _RARE_CYRILLIC.search(text[x:y])):
            return False
    return True


def restore(text: str, scores: np.ndarray, model: Model, gap: int = 40) -> tuple[bool, bool, str]:
    """Has the text runs that can be restored, has it runs of lost letters, and what it says with the former restored.

    ``scores`` are those of the text between two line ends.
    """
    runs: list[list[int]] = []
    lost = False
    blanks = [m.start() for m in _BLANK.finditer(text)]
    for a, b, _ in segments(scores, SEGMENT):
        a, b = _widen(text, max(0, a - 1), min(b + 1, len(text)), blanks)
        if a >= b:
            continue
        lost = lost or lost_letters(text[a:b])
        if text[a:b].isascii():
            continue
        if runs and a - runs[-1][1] <= 0:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    if not runs:
        return False, lost, text
    fixes: list[tuple[int, int, str]] = []
    chains_of: dict[int, Chain] = {}
    stops_of: dict[int, list[int]] = {}
    made: dict[tuple[int, int, Chain], str | None] = {}  # what a chain makes of a part that other runs are in too
    for n, (a, b) in enumerate(runs):
        if fixes and a < fixes[-1][1]:
            continue
        lonely = all(abs(text_gap) > gap for text_gap in [*([a - runs[n - 1][1]] if n else []), *([runs[n + 1][0] - b] if n + 1 < len(runs) else [])])
        found, tried = None, set()
        units = None
        for probe in _probes(text[a:b]):
            chains = [c for c in model.promising(probe) if c not in tried]
            if not chains:
                continue
            tried.update(chains)
            units = units or list(_units(text, a, b, stops_of))
            for x, y in units:
                # alone, a short run among others proves a mapping only if that is strict
                strict = (x, y) != (a, b) or lonely or b - a >= 12
                for chain in chains:
                    if not strict and chain[0][1] != "utf-8":
                        continue
                    if (x, y, chain) not in made:
                        made[x, y, chain] = holds(text[x:y], chain, model)
                    if (out := made[x, y, chain]) is not None:
                        found = (x, y, out)
                        break
                if found:
                    break
            if found:
                break
        if found and (not fixes or found[0] >= fixes[-1][1]):
            fixes.append(found)
            chains_of[found[0]] = chain
    fixes = [f for f in fixes if _explains(text, f, chains_of[f[0]], runs, fixes)]
    at, parts = 0, []
    for a, b, out in fixes:
        parts += [text[at:a], out]
        at = b
    return bool(fixes), lost, "".join([*parts, text[at:]])


def count_pairs(texts: DataFrame, counts: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of pair classes over all rows; with earlier counts, over rows that these make usual.

    Each task adds up its own rows, so what is shuffled is one small table a
    task, and the result has at most ``CLASSES ** 2`` entries.
    """

    handle = _Handle(texts.sparkSession, counts) if counts is not None else None

    def run(batches):
        clean_by = model_of(handle) if handle else None
        acc = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            codes, ends = batch_codes(batch.column(0))
            keys = pair_keys(codes)
            if clean_by is not None:
                sums = np.add.reduceat(clean_by.info[keys], ends[:-1]) if len(ends) > 1 else np.empty(0)
                usual = sums / np.diff(ends) <= clean_by.mean + USUAL
                keys = keys[np.repeat(usual, np.diff(ends))]
            acc += np.bincount(keys, minlength=CLASSES * CLASSES)
        own = np.flatnonzero(acc)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(acc[own], pa.int64())], names=["k", "n"])

    got = texts.select("text").where(F.col("text").isNotNull()).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(got["k"].to_numpy())
    return got["k"].to_numpy()[order], got["n"].to_numpy()[order]


def fit(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The pair counts of the corpus' usual rows."""
    return count_pairs(texts, count_pairs(texts))


class _Handle:
    """Broadcast counts, whose model a worker builds once."""

    def __init__(self, spark, counts: tuple[np.ndarray, np.ndarray]):
        self.broadcast = spark.sparkContext.broadcast(counts)
        self.name = uuid.uuid4().hex


_MODELS: dict[str, Model] = {}


def model_of(handle: _Handle) -> Model:
    if handle.name not in _MODELS:
        _MODELS.clear()
        _MODELS[handle.name] = Model(*handle.broadcast.value)
    return _MODELS[handle.name]


def garbled(texts: DataFrame, counts: tuple[np.ndarray, np.ndarray] | None = None, corpus: DataFrame | None = None, with_text: bool = False) -> DataFrame:
    """``(rec_table, rec_id [, restored])`` of the affected rows of ``texts(rec_table, rec_id, text)``.

    ``corpus`` is what the pair counts are taken from, ``texts`` if not given.
    ``restored`` is null where nothing could be restored.
    """
    spark = texts.sparkSession
    counts = counts if counts is not None else fit(corpus if corpus is not None else texts)
    handle = _Handle(spark, counts)

    def run(batches):
        model = model_of(handle)
        for batch in batches:
            codes, ends = batch_codes(batch.column(2))
            if len(ends) < 2:
                continue
            s = model.scores(codes)
            a, b = ends[:-1], ends[1:]
            marked = best_segments(s, ends) >= SEGMENT
            keep, fixed = [], []
            for r in np.flatnonzero(marked).tolist():
                hit, lost, out = restore(batch.column(2)[r].as_py(), s[a[r] : b[r]], model)
                if hit or lost:
                    keep.append(r)
                    fixed.append(out if hit else None)
            if keep:
                take = pa.array(keep)
                cols = [batch.column(0).take(take), batch.column(1).take(take)] + ([pa.array(fixed, pa.string())] if with_text else [])
                yield pa.RecordBatch.from_arrays(cols, names=["rec_table", "rec_id"] + ["restored"] * with_text)

    rows = texts.select("rec_table", "rec_id", "text").where(F.col("text").isNotNull())
    return spread(rows).mapInArrow(run, "rec_table string, rec_id long" + ", restored string" * with_text)
