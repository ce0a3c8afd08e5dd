"""Problem 5: text of scanned pages made continuous again.

1. Page furniture: lines that hold only a page number, in one of the usual
   styles and in a running order, and running headers and footers, told by
   their repetition within a document and at page edges over the corpus.
2. What is left is one stream of characters without its lines.  Its words are
   decoded jointly by Viterbi over a lattice of word costs, which are those of
   word frequencies of the whole corpus: a token is kept, has one or two letters
   exchanged, is split in two, is merged with the next one over a blank or a
   line end, or is joined to it over a line end's hyphen, which goes or stays.
3. Paragraph boundaries are chosen by dynamic programming over the lines.

The word list holds the words of a relative frequency of at least ``RARE``, so
it has at most ``1 / RARE`` entries however large the corpus; the list of
header lines is bounded in the same way by ``EDGE_SHARE``, and rarer ones on two
documents or more are joined to the lines by key.

Defined results: null, empty and blank texts give nothing; repeated rows give
their lines each; a line is of at most one of the kinds header and page number,
and those are never misread or hyphenated.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Both, digest, ensure_checkpoint_dir, map_batches, with_rare

RARE = 5e-6
EDGE_SHARE = 1e-4
#: A correction must be so many times as frequent as what stands, for each exchanged letter.
RATIO = 40
EXCHANGE = math.log(RATIO)
#: The cost of a blank that was read too much or too little.
BLANK = 10.0
#: A line end without a hyphen inside a word costs so many blanks.
LINE = 1.4

# fixed values: hyphens that end a broken line; the second group is never part of a word
_HYPHENS = "-‐¬\xad"
_SOFT = "¬\xad"
# fixed values: groups of signs that are read for one letter
_GROUPS = (("lII", "ш"), ("LII", "Ш"), ("ьl", "ы"), ("ЬI", "Ы"), ("bl", "ы"), ("I0", "ю"), ("jl", "л"), ("JI", "Л"), ("JL", "Л"), *((c, "") for c in "^~|¦'`´"))
# fixed values: Latin letters and digits that are read for a Cyrillic letter
_FOREIGN = dict(
    zip("aceopxyukmnrhtbi03468", "асеорхуиктпгнтьіозчбв")
) | dict(zip("ABCEHKMOPTXYN", "АВСЕНКМОРТХУИ"))
# fixed values: Cyrillic letters that are read for one another
_CONFUSED = {a: b for a, b in zip("нписелымшщолцгтпсзэ", ("иплнн", "нл", "нц", "ео", "со", "пд", "м", "ы", "щ", "шц", "сое", "п", "ищ", "т", "г", "н", "е", "э", "з"))} | {
    "н": "ипл", "п": "нл", "и": "нц", "с": "ео", "е": "со", "л": "пд", "ы": "м", "м": "ы", "ш": "щ", "щ": "шц", "о": "се", "ц": "ищ", "ь": "ъ", "ъ": "ь",
}

# fixed values: specks that are read inside a word
_SPECKS = "~|¦^'`´"
_CORE = re.compile(rf"[^\W_](?:[\w{_SPECKS}\-‐¬\xad’]*[\w{_SPECKS}])?|[{_SPECKS}]+[^\W_][\w{_SPECKS}]*")
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_CYR = re.compile("[А-Яа-яЁё]")
_FOREIGN_LETTER = re.compile("[^А-Яа-яЁё]")
_END = re.compile(rf"([\w{_SPECKS}]+(?:-[\w{_SPECKS}]+)*)([{_HYPHENS}])\s*$")
_BEGIN = re.compile(rf"\s*([\w{_SPECKS}]+(?:-[\w{_SPECKS}]+)*)")
_NUMBER = r"[\dlIOОоoi|]{1,4}"
_STYLES = (
    re.compile(rf"[-–—]\s*({_NUMBER})\s*[-–—]"),
    re.compile(rf"\[\s*({_NUMBER})\s*\]"),
    re.compile(rf"(?:лист|[сc]тр\.?|[сc]траница|page|p\.|с\.|seite|л\.)\s*({_NUMBER})(?:\s*(?:из|of|von|/)\s*{_NUMBER})?", re.I),
    re.compile(rf"({_NUMBER})\s*(?:из|of|/)\s*{_NUMBER}"),
)
_ROMAN = re.compile(r"[IVXLl]{1,6}")
_BARE = re.compile(_NUMBER)
_TRAILING = re.compile(rf"\S\s{{3,}}({_NUMBER})\s*$")
_SENTENCE_END = re.compile(r"[.!?:;,…»)]\s*$")


def _int(text: str) -> int | None:
    digits = text.translate(str.maketrans("lIi|OОоo", "11110000"))
    return int(digits) if digits.isdigit() else None


def skeleton(line: str) -> str:
    """A header line without numbers and in a form that survives misreadings."""
    text = re.sub(r"(?<![^\W_])[\dlIO]+(?![^\W_])", "", line.strip())
    for group, letter in _GROUPS:
        text = text.replace(group, letter)
    text = "".join(_FOREIGN.get(c, c) for c in text).lower()
    text = re.sub(r"\d+", "", text)
    text = text.translate(str.maketrans({"п": "н", "л": "н", "и": "н", "ц": "н", "с": "о", "е": "о", "ё": "о", "з": "о", "ч": "о", "б": "о", "ы": "м", "щ": "ш", "ъ": "ь"}))
    return " ".join(re.findall(r"[^\W_]+", text))


def _numbers_only(text: str) -> bool:
    text = text.strip()
    return any(x.fullmatch(text) for x in (*_STYLES, _BARE, _ROMAN))


def page_numbers(lines: list[str]) -> set[int]:
    """Lines (0-based) that hold only a page number."""
    styled: set[int] = set()
    bare: list[tuple[int, int]] = []
    roman: list[int] = []
    solid = [k for k, line in enumerate(lines) if line.strip()]
    for k in solid:
        text = lines[k].strip()
        if any(s.fullmatch(text) for s in _STYLES):
            styled.add(k)
        elif _ROMAN.fullmatch(text) and text not in ("l", "ll"):
            roman.append(k)
        elif _BARE.fullmatch(text) and (n := _int(text)) is not None:
            bare.append((k, n))
    if styled:
        return styled
    if roman and (len(roman) > 1 or not any(n < 100 for _, n in bare) or lines[roman[0]].strip() != "I"):
        return set(roman) | {k for k, n in bare if n == 1 and lines[k].strip() == "l"}
    bare += [(k, 1) for k in roman]
    # numbers at the end of header lines belong to the order of pages too
    within = {k: n for k in solid if (m := _TRAILING.search(lines[k])) and (n := _int(m.group(1))) is not None}
    alone = {k for k, _ in bare}
    bare = sorted(bare + list(within.items()))
    # the longest chain of numbers that rise with the pages; lone numbers count at a page edge only
    best: list[int] = []
    chains: dict[int, list[int]] = {}
    for k, n in bare:
        chain = [*chains.get(n - 1, chains.get(n - 2, [])), k]
        if len(chain) > len(chains.get(n, [])):
            chains[n] = chain
        if len(chains[n]) > len(best):
            best = chains[n]
    if len(best) > 1:
        return set(best) & alone
    # at the text's own edges any number but a year may be one; a lone one inside it only if it is small, as figures of the text stand there too
    return {k for k, n in bare if k in alone and ((k in solid[-2:] or k == solid[0]) and not 1900 <= n < 2100 or len(bare) == 1 and n < 100)}


def _candidate(line: str) -> bool:
    text = line.strip()
    return bool(text) and not _SENTENCE_END.search(text) and text[-1] not in _HYPHENS and sum(c.isalpha() for c in text) >= 3


def _parts(line: str) -> list[str]:
    """The independent parts of a header line, as skeletons."""
    parts = re.split(r"\s+[·|•—]\s+|\s{3,}", line.strip())
    return [s for p in parts if not _numbers_only(p) and (s := skeleton(p))]


def edges(lines: list[str], numbers: set[int]) -> set[int]:
    """Lines at the edges of pages, as far as page numbers and the text's ends tell."""
    solid = [k for k, line in enumerate(lines) if line.strip()]
    place = {k: n for n, k in enumerate(solid)}
    out = {solid[0], solid[-1]} if solid else set()
    for k in numbers:
        for step in (-1, 1):
            n = place[k] + step
            if 0 <= n < len(solid):
                out.add(solid[n])
    for k in list(out):  # a footer may be followed by the next page's header
        for step in (-1, 1):
            n = place[k] + step
            if 0 <= n < len(solid) and _candidate(lines[k]) and k not in numbers:
                out.add(solid[n])
    return out - numbers


def edge_keys(text: str) -> set[str]:
    """Skeletons of short lines at page edges: what a corpus-wide list of headers is made from."""
    lines = text.split("\n")
    width = max((len(x) for x in lines), default=0)
    numbers = page_numbers(lines)
    return {p for k in edges(lines, numbers) if _candidate(lines[k]) and len(lines[k].strip()) < 0.8 * width for p in _parts(lines[k])}


def headers(lines: list[str], numbers: set[int], known: frozenset[str]) -> set[int]:
    """Lines (0-based) that are running headers or footers."""
    keys = {k: skeleton(lines[k]) for k in range(len(lines)) if k not in numbers and _candidate(lines[k])}
    times = Counter(keys.values())
    at_edge = edges(lines, numbers)
    edge_times = Counter(keys[k] for k in at_edge if k in keys)
    out = set()
    for k, key in keys.items():
        listed = bool(known) and all(p in known for p in _parts(lines[k]))
        if listed or (times[key] > 1 and (k in at_edge or edge_times[key] > 1)):
            out.add(k)
    return out


@dataclass
class Lexicon:
    """Frequencies of the corpus' usual words, in lower case."""

    counts: dict[str, int]
    total: int
    _cache: dict[str, str | None] = field(default_factory=dict)
    _tokens: dict[str, tuple[float, str, bool, bool]] = field(default_factory=dict)

    def __post_init__(self):
        #: the cost of the most frequent word
        self.least = -math.log(max(self.counts.values(), default=1) / max(1, self.total))

    def p(self, word: str) -> float:
        return self.counts.get(word, 0) / max(1, self.total)

    def cost(self, word: str) -> float:
        n = self.counts.get(word, 0)
        return -math.log(n / self.total) if n else 10 + 1.5 * len(word)

    def reading(self, word: str) -> float:
        """The cost of a word as it stands or as it is corrected, whichever ``correct`` chooses."""
        good = self.correct(word)
        return self.cost(good) + EXCHANGE * (1 if len(good) != len(word) else max(1, sum(a != b for a, b in zip(good, word.lower())))) if good else self.cost(word.lower())

    def known(self, word: str) -> bool:
        return word in self.counts

    def token(self, token: str) -> tuple[float, str, bool, bool]:
        """A token by itself: its cost, how it reads, whether it is misread, whether it is of plain Cyrillic letters."""
        if (got := self._tokens.get(token)) is None:
            if len(self._tokens) > 200_000:
                self._tokens.clear()
            plain = token.isalpha() and not _FOREIGN_LETTER.search(token)
            marks: set[int] = set()
            fixed = _fix_token(token, 0, self, marks)
            got = self._tokens[token] = (self.reading(token) if plain else 0.0, fixed, bool(marks), plain)
        return got

    def correct(self, word: str) -> str | None:
        """What a misread word (letters only, as printed) reads in lower case; '' if it is misread beyond that; None if it stands."""
        if len(self._cache) > 200_000:
            self._cache.clear()
        if word not in self._cache:
            self._cache[word] = self._correct(word)
        return self._cache[word]

    def _correct(self, word: str) -> str | None:
        if not _CYR.search(word):
            return None
        low = word.lower()
        mixed = bool(re.search(rf"[A-Za-z{_SPECKS}]", word)) or bool(re.search(r"\d", word) and not re.fullmatch(r"\d+[А-Яа-яЁё]{1,2}|[А-ЯЁ]{1,3}\d+", word))
        if mixed:
            plain = word
            for group, letter in _GROUPS:
                plain = plain.replace(group, letter)
            plain = "".join(_FOREIGN.get(c, _FOREIGN.get(c.lower(), c)) for c in plain).lower()
            return plain if self.known(plain) else next((x for x in self._near(plain) if self.known(x)), "")
        if not low.isalpha():
            return None
        # by cost alone: one or two exchanged letters, words of any length and rarity in the list
        best, at = None, self.cost(low)
        if at <= EXCHANGE:
            return None
        one = set(self._near(low))
        for x in one:
            if self.known(x) and (c := self.cost(x) + EXCHANGE) < at:
                best, at = x, c
        if at > 2 * EXCHANGE:
            for x in {y for x in one for y in self._near(x)} - one - {low}:
                if self.known(x) and (c := self.cost(x) + 2 * EXCHANGE) < at:
                    best, at = x, c
        return best

    @staticmethod
    def _near(word: str):
        for k, c in enumerate(word):
            for other in _CONFUSED.get(c, ""):
                yield word[:k] + other + word[k + 1 :]


def break_costs(left: str, right: str, mark: str, lexicon: Lexicon) -> tuple[float, float]:
    """Costs of joining ``left`` and ``right`` over a line end without and with the mark between them."""
    never = math.inf
    if mark in _SOFT:
        return 0.0, never
    l, r = left.lower(), right.lower()
    if not l[-1:].isalpha() or not r[:1].isalpha() or (left.isupper() and len(left) < 4 and not right.isupper()):
        return never, 0.0
    if not right[:1].islower():
        goes = right.isupper() and left.isupper() and len(left) > 1 and lexicon.known(l + r)
        return (0.0, never) if goes else (never, 0.0)
    tail, head = l.rsplit("-", 1)[-1], r.split("-", 1)[0]
    compound = f"{tail}-{head}"
    stays = lexicon.cost(compound) if lexicon.known(compound) else lexicon.cost(tail) + lexicon.cost(head)
    return lexicon.reading(tail + head), stays


@dataclass
class Decoded:
    headers: set[int]
    numbers: set[int]
    hyphens: set[int]
    misread: set[int]
    text: str


def decode(text: str, lexicon: Lexicon, known: frozenset[str]) -> Decoded:
    """All of the above for one text; line numbers 0-based."""
    lines = text.split("\n")
    numbers = page_numbers(lines)
    head = headers(lines, numbers, known)
    running = [k for k in range(len(lines)) if k not in numbers and k not in head]
    solid = [k for k in running if lines[k].strip()]
    stream = "\n".join(lines[k] for k in solid)
    found = [m.span() for m in _CORE.finditer(stream)]
    words = [stream[a:b] for a, b in found]
    hyphens: set[int] = set()
    misread: set[int] = set()
    buffers: list[list[str]] = [[]]  # of each solid line
    at = 0
    for i, j, way in best_path(words, [stream[x:y] for (_, x), (y, _) in zip(found, found[1:])], lexicon):
        for n, part in enumerate(stream[at : found[i][0]].split("\n")):
            if n:
                buffers.append([])
            buffers[-1].append(part)
        k, out = solid[len(buffers) - 1], buffers[-1]
        at = found[j - 1][1]
        if way in (GOES, STAYS):
            if way == GOES:
                hyphens.add(k)
            nxt = solid[len(buffers)]
            out.append(_join(words[i], words[i + 1], way == GOES, k, nxt, lexicon, misread))
            buffers.append([])
            while stream[at : at + 1] in (" ", "\t"):
                at += 1
        elif way == MERGED:
            out.append("".join(words[i:j]))
            if "\n" in stream[found[i][1] : found[i + 1][0]]:
                buffers.append([])  # nothing was misread, a hyphen was lost
            else:
                misread.add(k)
        elif way:
            misread.add(k)
            out.append(" ".join(lexicon.token(w)[1] for w in (words[i][:way], words[i][way:])))
        else:
            _, fixed, bad, _ = lexicon.token(words[i])
            if bad:
                misread.add(k)
            out.append(fixed)
    for n, part in enumerate(stream[at:].split("\n")):
        if n:
            buffers.append([])
        buffers[-1].append(part)
    fixed_lines = {k: "".join(parts).rstrip() for k, parts in zip(solid, buffers)}
    return Decoded(head, numbers, hyphens, misread, _paragraphs(lines, running, fixed_lines))


GOES, STAYS, MERGED = -1, -2, -3


def best_path(words: list[str], gaps: list[str], lexicon: Lexicon) -> list[tuple[int, int, int]]:
    """The reading of least total cost of a text's tokens: ``(first, behind the last, way)`` of each word.

    ``gaps`` are what stands between the tokens.  The way is 0 for a token by
    itself, as it stands or corrected; the place of a missing blank; or
    ``GOES``, ``STAYS`` (the hyphen of a line end) and ``MERGED`` for two.
    """
    n = len(words)
    best, back = [0.0] * (n + 1), [(0, 0)] * (n + 1)
    floor = BLANK + lexicon.least
    before = (0.0, "", False, False)
    counts, cost = lexicon.counts, lexicon.cost
    gap = ""
    for i, w in enumerate(words):
        own = lexicon.token(w)
        alone = own[0]
        low, way, first = best[i] + alone, 0, i
        if i:
            gap = gaps[i - 1]
            mark = gap.strip() if "\n" in gap else ""
            if len(mark) == 1 and mark in _HYPHENS and gap.count("\n") == 1 and gap[0] == mark:
                goes, stays = break_costs(words[i - 1], w, mark, lexicon)
                low = math.inf  # the mark is decided on, whatever else is cheap
                for c, own_way in ((best[i - 1] + goes, GOES), (best[i - 1] + stays, STAYS)):
                    if c < low:
                        low, way, first = c, own_way, i - 1
                if back[i][1] in (GOES, STAYS) and back[i][0] == i - 2:  # the token before is the end of a broken word itself
                    low, way, first = best[i] + alone, 0, i
            elif own[3] and before[3] and before[0] + alone > floor and w.islower() and (gap == " " or gap == "\n"):
                both = words[i - 1].lower() + w
                if both in counts and (c := best[i - 1] + BLANK * (1 if gap == " " else LINE) + cost(both)) < low:
                    low, way, first = c, MERGED, i - 1
        if own[3] and alone > floor + lexicon.least and len(w) > 1:
            text = w.lower()
            for cut in range(1, len(w)):
                if text[:cut] in counts and text[cut:] in counts and (c := best[i] + BLANK + cost(text[:cut]) + cost(text[cut:])) < low:
                    low, way, first = c, cut, i
        best[i + 1], back[i + 1] = low, (first, way)
        before = own
    out, i = [], n
    while i:
        first, way = back[i]
        out.append((first, i, way))
        i = first
    return out[::-1]


def _like(model: str, low: str) -> str:
    """``low`` in the capitals of ``model``."""
    letters = [c for c in model if c.isalpha()]
    if len(letters) > 1 and sum(c.isupper() for c in letters) > len(letters) / 2:
        return low.upper()
    return low[:1].upper() + low[1:] if model[:1].isupper() else low


def _fix_token(token: str, k: int, lexicon: Lexicon, misread: set[int]) -> str:
    """A token of line ``k`` with its misread parts exchanged; notes the line."""
    if re.fullmatch(r"\d*[lIO]\d+|\d+[lIO]\d*", token):
        misread.add(k)
        return token.translate(str.maketrans("lIO", "110"))
    if lexicon.known(token.lower()) and lexicon.p(token.lower()) > 1e-4:
        return token
    parts = re.split(r"([-‐])", token)
    code = len(parts) > 1 and any(p.isdigit() or (p.isupper() and len(p) < 3) or re.fullmatch(r"[А-ЯЁA-Z]\d+|\d+[А-ЯЁA-Z]", p) for p in parts[::2])
    if code:
        return token
    for n in range(0, len(parts), 2):
        part = parts[n]
        good = lexicon.correct(part)
        if good is None:
            continue
        misread.add(k)
        if good:
            parts[n] = _like(part, good)
    return "".join(parts)


def _join(left: str, right: str, goes: bool, k: int, nxt: int, lexicon: Lexicon, misread: set[int]) -> str:
    """The word broken after line ``k``; a misread character is noted on the line that holds it."""
    if not goes:
        whole = f"{left}-{right}"
        marks: set[int] = set()
        a, b = _fix_token(left, k, lexicon, marks) if not _is_code(left, right) else left, right
        if not _is_code(left, right):
            b = _fix_token(right, nxt, lexicon, marks)
        misread |= marks
        return f"{a}-{b}" if (a, b) != (left, right) else whole
    tail, head = left.rsplit("-", 1)[-1], right.split("-", 1)[0]
    good = lexicon.correct(tail + head)
    if good is None:
        return left + right
    for part, line in ((tail, k), (head, nxt)):
        if re.search(rf"[A-Za-z{_SPECKS}\d]", part):
            misread.add(line)
    if good:
        if not re.search(rf"[A-Za-z{_SPECKS}\d]", tail + head) and len(good) == len(tail + head):
            for p, (x, y) in enumerate(zip((tail + head).lower(), good)):
                if x != y:
                    misread.add(k if p < len(tail) else nxt)
        return left[: len(left) - len(tail)] + _like(tail + head, good) + right[len(head) :]
    return left + right


def _is_code(left: str, right: str) -> bool:
    return any(p.isdigit() or (p.isupper() and len(p) < 3) for p in (left.rsplit("-", 1)[-1], right.split("-", 1)[0]))


def _paragraphs(lines: list[str], running: list[int], fixed: dict[int, str]) -> str:
    """Lines joined to paragraphs; the boundaries of least total cost.

    A boundary costs less after a short line that ends a sentence, at an empty
    line or before a capital; a paragraph that begins in a sentence costs much.
    """
    solid = [k for k in running if k in fixed and fixed[k].strip()]
    if not solid:
        return ""
    width = sorted(len(lines[k]) for k in solid)[int(0.9 * (len(solid) - 1))]
    # best[s]: least cost so far, the last line ending a paragraph (1) or not (0)
    best, back = [0.0, 0.0], []
    for a, b in zip(solid, solid[1:]):
        ends = bool(re.search(r"[.!?…»\"”)]\s*$", lines[a]))
        short = len(lines[a].rstrip()) < 0.75 * width
        opens = lines[b].lstrip()[:1].isupper() or not lines[b].lstrip()[:1].isalpha()
        empty = any(not lines[x].strip() for x in range(a + 1, b)) and all(x in running for x in range(a + 1, b))
        cut = 4.0 - 3.0 * empty - 2.5 * (short and ends) - 0.5 * opens + 4.0 * (not ends) + 3.0 * (not opens)
        keep = 0.0 + 1.5 * (empty and ends and opens) + 1.0 * (short and ends and opens)
        costs = [[best[s] + keep + (0.0 if s == 0 else 0.0) for s in (0, 1)], [best[s] + cut + (0.7 if s == 1 else 0.0) for s in (0, 1)]]
        back.append([min((0, 1), key=lambda s: costs[x][s]) for x in (0, 1)])
        best = [min(costs[0]), min(costs[1])]
    state = min((0, 1), key=lambda s: best[s])
    cuts = []
    for pointer in reversed(back):
        cuts.append(state == 1)
        state = pointer[state]
    cuts.reverse()
    out = [fixed[solid[0]].strip()]
    for cut, k in zip(cuts, solid[1:]):
        piece = fixed[k].strip()
        out.append(("\n\n" if cut else " " if piece else "") + piece)
    return "".join(out)


def word_counts(texts: DataFrame, rare: float = RARE) -> tuple[dict[str, int], int]:
    """Words of at least the relative frequency ``rare`` with their counts, and the number of all words."""

    def run(batches):
        import pyarrow as pa

        acc: Counter[str] = Counter()
        raw: Counter[str] = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(acc), pa.string()), pa.array(list(acc.values()), pa.int64())], names=["w", "n"])

        def of_tokens():
            """Words of the tokens counted; what is left of a word broken at a line end counts for nothing."""
            for token, n in raw.items():
                if token[-1] not in _HYPHENS:
                    for w in _WORD.findall(token):
                        acc[w] += n
            raw.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                raw.update(text.lower().split())
                if len(raw) > 300_000:
                    of_tokens()
            if len(acc) > 300_000:
                yield flush()
                acc.clear()
        of_tokens()
        if acc:
            yield flush()

    words = texts.select("text").where(F.col("text").isNotNull()).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    words = words.persist()
    try:
        total = words.agg(F.sum("n")).first()[0] or 0
        least = max(2, math.ceil(rare * total))
        return {r["w"]: r["n"] for r in words.where(F.col("n") >= least).collect()}, total
    finally:
        words.unpersist()


def header_keys(scanned: DataFrame, share: float = EDGE_SHARE) -> tuple[frozenset[str], DataFrame | None]:
    """Header lines found at page edges of at least two documents: those of ``share`` of all, and the rest by digest, None if there can be none."""

    def run(cols):
        out = [k for text in cols["text"] if text for k in edge_keys(text)]
        return {"k": out}

    rows = scanned.select("text").where(F.col("text").isNotNull())
    least = max(2, math.ceil(share * rows.count()))
    keys = map_batches(rows, run, "k string").groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= 2)
    rare = None
    if least > 2:
        ensure_checkpoint_dir(scanned.sparkSession)
        keys = keys.checkpoint()
        rare = keys.where(F.col("n") < least).select(F.unhex(F.md5("k")).alias("d"))
    return frozenset(r["k"] for r in keys.where(F.col("n") >= least).collect()), rare


def _all_parts(text: str) -> set[str]:
    """The parts of all lines of a text that a list of headers is asked for."""
    return {p for line in text.split("\n") if _candidate(line) for p in _parts(line)}


_STATE: dict[str, tuple[Lexicon, frozenset[str]]] = {}


def _state(name: str, broadcast) -> tuple[Lexicon, frozenset[str]]:
    if name not in _STATE:
        _STATE.clear()
        counts, total, known = broadcast.value
        _STATE[name] = Lexicon(counts, total), known
    return _STATE[name]


def _fitted(scanned: DataFrame, corpus: DataFrame, share: float):
    """``(content_id, text [, rare])``, and a function of such columns that decodes each text, None for one without text."""
    counts, total = word_counts(corpus)
    known, rare = header_keys(scanned, share)
    name, sent = uuid.uuid4().hex, scanned.sparkSession.sparkContext.broadcast((counts, total, known))
    rows = scanned.select("content_id", "text")
    if rare is not None:
        rows = with_rare(rows, rare, lambda text: _all_parts(text) - _state(name, sent)[1])

    def decoded(cols):
        lexicon, listed = _state(name, sent)
        for text, own in zip(cols["text"], cols.get("rare") or [None] * len(cols["text"])):
            if not text or text.isspace():
                yield None
                continue
            found = {r["d"] for r in own or ()}
            yield decode(text, lexicon, Both({p for p in _all_parts(text) if digest(p) in found}, listed) if found else listed)

    return rows, decoded


def scan_lines(scanned: DataFrame, corpus: DataFrame, share: float = EDGE_SHARE) -> DataFrame:
    """``(content_id, line_no from 1, kind)`` for the texts of scanned pages; ``corpus`` gives the word frequencies."""
    rows, decoded = _fitted(scanned, corpus, share)

    def run(cols):
        out = {"content_id": [], "line_no": [], "kind": []}
        for i, d in zip(cols["content_id"], decoded(cols)):
            if d is None:
                continue
            for kind, found in (("header", d.headers), ("page_no", d.numbers), ("hyphen", d.hyphens), ("misread", d.misread)):
                for k in sorted(found):
                    out["content_id"].append(i)
                    out["line_no"].append(k + 1)
                    out["kind"].append(kind)
        return out

    return map_batches(rows, run, "content_id long, line_no int, kind string")


def repaired(scanned: DataFrame, corpus: DataFrame, share: float = EDGE_SHARE) -> DataFrame:
    """``(content_id, text)`` in continuous paragraphs."""
    rows, decoded = _fitted(scanned, corpus, share)

    def run(cols):
        return {"content_id": cols["content_id"], "text": [d.text if d else t and "" for t, d in zip(cols["text"], decoded(cols))]}

    return map_batches(rows, run, "content_id long, text string")
