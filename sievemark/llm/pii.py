"""Problem 7: personal information in free text, by a linear-chain conditional random field.

Texts become tokens (words, groups of digits, mailboxes, marks); each token has
word-shape features, seen in a window of three tokens to either side.  The
field is trained on a small labelled table (``pii_table``) by its likelihood
and decoded by Viterbi, many texts at once in numpy, whole
texts and not only the surroundings of likely places.  Weights of a window are
summed once per kind of token, so a text costs a look-up a token.  Spans are
the field's own; they pass an exact check of their kind (a whole mailbox, the
number of digits and checksums, a house number, a name's words), which trims
loose marks or rejects, and become values or typed placeholders.

In training, words are hidden at random, from their own token and from their
neighbours, so that the field learns shapes and not the table's wordings.

Defined results: null, empty and blank texts hold nothing and stay as they are;
repeated rows are reported each; a value found twice in a row is reported once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_table
from .common import spread

KINDS = ("email", "phone", "id_number", "address", "person_name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW = 3
#: Texts are decoded in pieces of at most so many tokens, cut behind a sentence or at an empty line.
PIECE = 400
#: Rows of the labelled table of more tokens are not trained on.
LONGEST = 42
#: So large a share of words is hidden in training, where their shapes must do.
UNREAD = 0.3
#: Weights of neighbours, and of words themselves, are held down so many times as much as those of a token's shape.
CONTEXT, WORDS = 50, 8
#: Such shares of tokens are hidden from their neighbours in training, one of them in each text.
UNSEEN = (0.0, 0.4, 0.8, 1.0)
#: Beyond so many kinds of token the summed weights are dropped between two calls.
KEPT_ROWS = 150_000

_GAP = "[ \u00a0\u2007\u2009\u202f]"
_AT = rf"(?:{_GAP}?@{_GAP}?|{_GAP}?[(\[{{]{_GAP}?(?:at|собака|эт)\b{_GAP}?[)\]}}]{_GAP}?|{_GAP}(?:at|собака){_GAP})"
_DOT = rf"(?:\.|{_GAP}?[(\[{{]{_GAP}?(?:dot|точка){_GAP}?[)\]}}]{_GAP}?|{_GAP}(?:dot|точка){_GAP})"
_EMAIL = rf"[\w][\w.+\-]*{_AT}[\w\-]+(?:{_DOT}[\w\-]+)+"
_NUMBER = rf"\+?\(?\d+(?:(?:\){_GAP}?|{_GAP}?\(|[\-‑–./  ]|{_GAP}|{_GAP}?№{_GAP}?)\d+)*(?:[А-Яа-яA-Z](?![\w]))?"
_TOKEN = re.compile(rf"([A-ZА-ЯЁ]\.)|([^\W\d_]+(?:[\-‑'’][^\W\d_]+)*)|({_NUMBER})|(\S)")
_MAILBOX = re.compile(_EMAIL, re.I)
_AT_HINT = re.compile(r"@|[(\[{] ?(?:at|собака|эт)\b| (?:at|собака) \S+(?: (?:dot|точка) |\.[a-z])", re.I)
_INITIAL = re.compile(r"[A-ZА-ЯЁ]\.")
_DIGIT_RUN = re.compile(r"\d")

_PATRONYMIC = re.compile(r"(?:ович|евич|ьич|овн|евн|ичн|ыч)(?:[аыеуой]|ем|ом|ой|ою|)$", re.I)
_SURNAME = re.compile(r"(?:ов|ев|ёв|ин|ын|ск|цк|енк|ук|юк|ых|их)(?:[аыуе]|ым|ой|ою|ий|ая|ого|ому|им|о|)$", re.I)
_LATIN_SURNAME = re.compile(r"(?:ov|ev|yov|in|yn|sky|skaya|enko|uk)a?$", re.I)
_STREET = re.compile(r"(?:ул|улиц[аыеу]|пер|переул\w+|просп|проспект\w*|пр-кт|бульвар\w*|б-р|шоссе|ш|набережн\w+|наб|площад\w+|пл|проезд\w*|тупик|аллея|street|lane|road|avenue|st|rd|ave|drive|strasse|straße)$", re.I)
_PLACE = re.compile(r"(?:г|гор|город\w*|пос|посёл\w+|посел\w+|п|с|сел[оеа]|дер|деревн\w+|обл|область|край|респ|р-н|станиц\w+|хутор)$", re.I)
_HOUSE = re.compile(r"(?:д|дом|корп|корпус|стр|строение|кв|квартира|оф|офис|apt|flat|house|вл|литер\w?|под|подъезд|эт|этаж)$", re.I)
_FIRST = frozenset(pii_table.first_name_stems())
_FIRST_LATIN = frozenset(pii_table.latin_first_names())


# fixed values: case endings of first names
_ENDINGS = frozenset(("", "а", "я", "у", "ю", "е", "и", "ы", "ом", "ем", "ой", "ей", "ою", "ею", "ии", "ию", "ия", "ией", "ь", "ью", "й"))


def first_name(word: str) -> bool:
    """Is the word a usual first name in any grammatical form?"""
    low = word.lower().replace("ё", "е")
    if low in _FIRST_LATIN:
        return True
    return any(low[: len(low) - cut] in _FIRST and low[len(low) - cut :] in _ENDINGS for cut in range(0, 4) if len(low) - cut >= 2)


def tokens(text: str) -> tuple[list[str], list[int], list[int], list[int]]:
    """Keys, starts, ends and flags (1 first of a line, 2 no blank before, 4 behind an empty line) of a text's tokens."""
    keys, starts, ends, flags = [], [], [], []
    mailboxes = [m.span() for m in _MAILBOX.finditer(text)] if _AT_HINT.search(text) else []
    last = 0

    def add(key: str, a: int, b: int) -> None:
        nonlocal last
        flag = 0
        if a == last:
            flag = 2 if a else 1
        elif a - last > 1 or text[last] == "\n":
            feeds = text.count("\n", last, a)
            flag = (1 if feeds else 0) | (4 if feeds > 1 else 0)
        keys.append(key)
        starts.append(a)
        ends.append(b)
        flags.append(flag)
        last = b

    for a, b in [*mailboxes, (len(text), len(text))]:
        for m in _TOKEN.finditer(text, last, a):
            add(_number_key(m.group()) if m.lastindex == 3 else m.group(), *m.span())
        if a < b:
            add("<@>", a, b)
    return keys, starts, ends, flags


def _number_key(text: str) -> str:
    digits = re.sub(r"\D", "", text)
    shape = re.sub(_GAP + r"|\n", " ", _DIGIT_RUN.sub("9", text)).replace("\u2011", "-")
    if text[-1].isalpha():
        shape = shape[:-1] + "A"
    lead = digits[:1] if digits[:1] in "78" else ""
    return f"#{shape[:24]}|{lead}|{len(digits)}|{'i' if inn_holds(digits) else ''}{'s' if snils_holds(digits) else ''}{'m' if text[:1] == '+' else ''}"


def inn_holds(d: str) -> bool:
    if len(d) != 12:
        return False
    n = list(map(int, d))
    a = sum(x * y for x, y in zip((7, 2, 4, 10, 3, 5, 9, 4, 6, 8), n)) % 11 % 10
    b = sum(x * y for x, y in zip((3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8), n)) % 11 % 10
    return n[10] == a and n[11] == b


def snils_holds(d: str) -> bool:
    if len(d) != 11:
        return False
    s = sum(int(c) * w for c, w in zip(d, range(9, 0, -1))) % 101
    return (0 if s == 100 else s) == int(d[9:])


def features(key: str) -> list[str]:
    """Word-shape features of a kind of token."""
    if key == "<@>":
        return ["mail"]
    if key.startswith("#") and "|" in key:
        shape, lead, n, flags = key[1:].split("|")
        runs = re.sub(r"9+", lambda m: str(min(len(m.group()), 6)), shape)
        out = ["num", f"shape={shape}", f"runs={runs}", f"n={n}", f"lead={lead}:{n}", f"mark={''.join(sorted(set(re.sub('[9A]', '', shape))))}:{n}"]
        return out + [f"flag={c}" for c in flags] + (["numA"] if shape.endswith("A") else []) + (["short"] if int(n) < 4 else [])
    if not key[0].isalpha():
        return ["mark", f"w={key}"]
    if _INITIAL.fullmatch(key):
        return ["initial", "init"] if key[0].isupper() else ["initial", f"w={key}"]
    low = key.lower()
    cap = "X" if key.isupper() and len(key) > 1 else "Xx" if key[:1].isupper() and key[1:].islower() else "x" if key.islower() else "X1" if len(key) == 1 else "mixed"
    script = "c" if "а" <= low[0] <= "я" or low[0] == "ё" else "l"
    out = ["word", f"cap={cap}", f"cap={cap}{script}", f"w={low}", f"p={low[:5]}", f"s3={low[-3:]}:{cap != 'x'}", f"s2={low[-2:]}:{cap != 'x'}", f"len={min(len(key), 4)}"]
    big = cap != "x"
    if first_name(key):
        out += ["first", f"first{big}"]
    if _PATRONYMIC.search(low) and len(low) > 5:
        out += ["patronymic", f"patr{big}"]
    if (_SURNAME.search(low) or script == "l" and _LATIN_SURNAME.search(low)) and len(low) > 3:
        out += [f"surname{big}"]
    if _STREET.fullmatch(low):
        out += ["street"]
    if _PLACE.fullmatch(low):
        out += ["place"]
    if _HOUSE.fullmatch(low):
        out += ["house"]
    return out


class Field:
    """The conditional random field: weights of features in a window, of flags and of label pairs."""

    def __init__(self, vocabulary: dict[str, int], w: np.ndarray, f: np.ndarray, t: np.ndarray):
        self.vocabulary, self.w, self.f, self.t = vocabulary, w, f, t
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, 2 * WINDOW + 1, len(LABELS)), np.float32)

    def fresh(self) -> None:
        """Drop a large index; only before the first place of a call is taken, as places are read at its end."""
        if len(self.index) > KEPT_ROWS:
            self.index.clear()
            self.rows = np.zeros((1024, *self.rows.shape[1:]), np.float32)

    def row(self, key: str) -> int:
        """The place of a token kind's summed weights."""
        if (i := self.index.get(key)) is not None:
            return i
        i = len(self.index)
        if i >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        ids = [self.vocabulary[x] for x in features(key) if x in self.vocabulary]
        self.rows[i] = self.w[:, ids].sum(1) if ids else 0
        self.index[key] = i
        return i

    def emissions(self, places: np.ndarray, flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of labels at all tokens of many pieces laid end to end."""
        n = len(places)
        out = np.zeros((n, len(LABELS)), np.float32)
        piece = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        for o in range(-WINDOW, WINDOW + 1):
            lo, hi = max(0, -o), min(n, n - o)
            part = self.rows[places[lo + o : hi + o], o + WINDOW]
            same = piece[lo:hi] == piece[lo + o : hi + o]
            out[lo:hi] += part * same[:, None]
        for bit in range(3):
            out += self.f[bit] * ((flags >> bit) & 1)[:, None]
        return out


def viterbi(e: np.ndarray, t: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Best labels of pieces laid end to end, pieces of like length at once."""
    out = np.zeros(len(e), np.int8)
    lengths = np.diff(ends)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        longest = lengths[order[at]]
        stop = at
        while stop < len(order) and lengths[order[stop]] <= max(longest * 1.25, longest + 4) and stop - at < 4096:
            stop += 1
        group = order[at:stop]
        size = int(lengths[group[-1]])
        begin, own = ends[group], lengths[group]
        score = e[begin].copy()
        score[:, 2::2] = -1e4  # no piece begins inside
        back = np.zeros((size, len(group), len(LABELS)), np.int8)
        for k in range(1, size):
            total = score[:, :, None] + t[None]
            back[k] = total.argmax(1)
            live = own > k
            new = total.max(1) + e[np.minimum(begin + k, len(e) - 1)]
            score = np.where(live[:, None], new, score)
        label = score.argmax(1).astype(np.int8)
        for k in range(size - 1, -1, -1):
            live = own > k
            out[begin[live] + k] = label[live]
            if k:
                step = np.take_along_axis(back[k], label[:, None].astype(np.int64), 1)[:, 0]
                label = np.where(live, step, label)
        at = stop
    return out


@lru_cache(maxsize=2)
def train(rounds: int = 200, rate: float = 0.1, l2: float = 2e-5, seed: int = 7, without: int | None = None) -> Field:
    """The field of greatest likelihood on the labelled table, for held-out accuracy without a part of its wordings."""
    rows = pii_table.labelled(seed, without=without)
    seqs = []
    for text, spans in rows:
        keys, starts, ends, flags = tokens(text)
        if len(keys) > LONGEST:
            continue  # a few rows that would make every round of training long
        y = np.zeros(len(keys), np.int8)
        for a, b, kind in spans:
            inside = [k for k in range(len(keys)) if starts[k] >= a and ends[k] <= b]
            for n, k in enumerate(inside):
                y[k] = 1 + 2 * KINDS.index(kind) + (n > 0)
        seqs.append((keys, np.array(flags), y))
    counts: dict[str, int] = {}
    kinds = sorted({k for s in seqs for k in s[0]})
    by_kind = {k: features(k) for k in kinds}
    for s in seqs:
        for k in s[0]:
            for x in by_kind[k]:
                counts[x] = counts.get(x, 0) + 1
    vocabulary = {x: i for i, x in enumerate(sorted(x for x, n in counts.items() if n >= 4))}
    # the features of every kind of token, and once more without the word itself, so that shapes are learnt and not the table's words; a row of zeros where there are fewer
    most = max(len(x) for x in by_kind.values())
    ids = np.full((2 * len(kinds), most), len(vocabulary))
    for i, k in enumerate(kinds):
        own = [vocabulary[x] for x in by_kind[k] if x in vocabulary]
        bare = [vocabulary[x] for x in by_kind[k] if x in vocabulary and not (by_kind[k][0] == "word" and x[:2] in ("w=", "p="))]
        ids[i, : len(own)], ids[len(kinds) + i, : len(bare)] = own, bare
    number = {k: i for i, k in enumerate(kinds)}
    size, count, labels = max(len(s[0]) for s in seqs), len(seqs), len(LABELS)
    kind = np.full((count, size + 2 * WINDOW), -1)
    flag = np.zeros((count, size), int)
    gold = np.zeros((count, size), int)
    mask = np.zeros((count, size), bool)
    for r, (keys, flags, y) in enumerate(seqs):
        kind[r, WINDOW : WINDOW + len(keys)] = [number[k] for k in keys]
        flag[r, : len(keys)], gold[r, : len(keys)], mask[r, : len(keys)] = flags, y, True
    w = np.zeros((2 * WINDOW + 1, len(vocabulary), labels), np.float32)
    f = np.zeros((3, labels), np.float32)
    t = np.zeros((labels, labels), np.float32)
    barred = np.zeros((labels, labels), bool)
    for b in range(2, labels, 2):
        barred[:, b] = True
        barred[b - 1, b] = barred[b, b] = False
    t[barred] = -1e4
    # what a token is counts most, what stands around it and the very words less
    l2_w = np.full((2 * WINDOW + 1, len(vocabulary), 1), CONTEXT * l2, np.float32)
    l2_w[WINDOW] = l2
    l2_w[:, [i for x, i in vocabulary.items() if x[:2] in ("w=", "p=") and x[2:3].isalpha()]] *= WORDS
    rng = np.random.default_rng(seed)
    params, moments = [w, f, t], [[np.zeros_like(p), np.zeros_like(p)] for p in (w, f, t)]
    for step in range(1, rounds + 1):
        pick = rng.choice(count, min(count, 256), replace=False)
        kb, fb, yb, mb = kind[pick], flag[pick], gold[pick], mask[pick]
        width = int(mb.sum(1).max())
        kb, fb, yb, mb = kb[:, : width + 2 * WINDOW], fb[:, :width], yb[:, :width], mb[:, :width]
        kb = np.where((kb >= 0) & (rng.random(kb.shape) < UNREAD), kb + len(kinds), kb)
        near = np.where(rng.random(kb.shape) < rng.choice(UNSEEN, (len(pick), 1)), -1, kb)  # what the neighbours see
        e = np.zeros((len(pick), width, labels), np.float32)
        used = np.unique(kb[kb >= 0])
        place = np.full(2 * len(kinds) + 1, len(used))
        place[used] = np.arange(len(used))
        own = ids[used]
        order = np.argsort(own.ravel(), kind="stable")
        features_used, starts_used = np.unique(own.ravel()[order], return_index=True)
        for o in range(2 * WINDOW + 1):
            rowsw = np.zeros((len(used) + 1, labels), np.float32)
            rowsw[:-1] = np.concatenate([w[o], np.zeros((1, labels), np.float32)])[own].sum(1)
            e += rowsw[place[(kb if o == WINDOW else near)[:, o : o + width]]]
        for bit in range(3):
            e += f[bit] * ((fb >> bit) & 1)[..., None]
        # forward and backward sums
        alpha = np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        alpha[:, 0, 2::2] = -1e4
        for k in range(1, width):
            s = alpha[:, k - 1, :, None] + t
            top = s.max(1)
            new = top + np.log(np.exp(s - top[:, None]).sum(1)) + e[:, k]
            alpha[:, k] = np.where(mb[:, k, None], new, alpha[:, k - 1])
        beta = np.zeros_like(e)
        for k in range(width - 2, -1, -1):
            s = t + (e[:, k + 1] + beta[:, k + 1])[:, None, :]
            top = s.max(2)
            new = top + np.log(np.exp(s - top[..., None]).sum(2))
            beta[:, k] = np.where(mb[:, k + 1, None], new, beta[:, k + 1])
        last = alpha[:, -1]
        top = last.max(1, keepdims=True)
        z = (top + np.log(np.exp(last - top).sum(1, keepdims=True)))[:, 0]
        p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mb[..., None]
        g = (np.eye(labels, dtype=np.float32)[yb] - p) * mb[..., None]
        gw = np.zeros_like(w)
        for o in range(2 * WINDOW + 1):
            acc = np.zeros((len(used) + 1, labels), np.float32)
            np.add.at(acc, place[(kb if o == WINDOW else near)[:, o : o + width]].ravel(), g.reshape(-1, labels))
            sums = np.add.reduceat(np.repeat(acc[:-1], own.shape[1], 0)[order], starts_used)
            gw[o][features_used[features_used < len(vocabulary)]] = sums[features_used < len(vocabulary)]
        gf = np.stack([(g * ((fb >> bit) & 1)[..., None]).sum((0, 1)) for bit in range(3)])
        gt = np.zeros_like(t)
        for k in range(1, width):
            live = mb[:, k]
            if not live.any():
                break
            s = alpha[live, k - 1, :, None] + t + (e[live, k] + beta[live, k])[:, None, :] - z[live, None, None]
            gt -= np.exp(np.minimum(s, 0)).sum(0)
            np.add.at(gt, (yb[live, k - 1], yb[live, k]), 1)
        gt[barred] = 0
        for n, (param, grad) in enumerate(zip(params, (gw, gf, gt))):
            grad = grad / len(pick) - (l2_w if n == 0 else l2) * np.where(np.abs(param) < 1e3, param, 0)
            moments[n][0] = 0.9 * moments[n][0] + 0.1 * grad
            moments[n][1] = 0.99 * moments[n][1] + 0.01 * grad**2
            param += rate * (moments[n][0] / (1 - 0.9**step)) / (np.sqrt(moments[n][1] / (1 - 0.99**step)) + 1e-6) * (1 if step < rounds * 0.7 else 0.3)
        t[barred] = -1e4
    return Field(vocabulary, w, f, t)


def pieces(text: str, ends: list[int], flags: list[int]) -> list[int]:
    """Ends of decoding pieces among a text's tokens."""
    n = len(ends)
    out, start = [], 0
    for k in range(1, n):
        long = k - start >= PIECE and (text[ends[k - 1] - 1] in ".!?;" or flags[k] & 1 or k - start >= 2 * PIECE)
        if flags[k] & 4 or long:
            out.append(k)
            start = k
    if n:
        out.append(n)
    return out


def find_all(texts: Iterable[str | None], field: Field) -> list[list[tuple[int, int, str]]]:
    """``(start, end, kind)`` of the pieces of personal information in each text."""
    texts = list(texts)
    field.fresh()
    row_tokens, places, flags_all, ends_all = [], [], [], [0]
    for text in texts:
        if not text or text.isspace():
            row_tokens.append(None)
            continue
        keys, starts, ends, flags = tokens(text)
        base = len(places)
        cuts = pieces(text, ends, flags)
        places += [field.row(k) for k in keys]
        flags_all += flags
        ends_all += [base + c for c in cuts]
        row_tokens.append((base, starts, ends))
    if not places:
        return [[] for _ in texts]
    edges = np.array(ends_all)
    labels = viterbi(field.emissions(np.array(places), np.array(flags_all), edges), field.t, edges)
    out = []
    for text, own in zip(texts, row_tokens):
        found: list[tuple[int, int, str]] = []
        if own is not None:
            base, starts, ends = own
            lab = labels[base : base + len(starts)]
            for k in np.flatnonzero(lab % 2 == 1).tolist():
                kind = (lab[k] - 1) // 2
                j = k
                while j + 1 < len(lab) and lab[j + 1] == lab[k] + 1:
                    j += 1
                for a, b in _whole(text, starts, ends, k, j, KINDS[kind]):
                    if (span := checked(text, a, b, KINDS[kind])) is not None:
                        if (*span, KINDS[kind]) not in found[-3:]:
                            found.append((*span, KINDS[kind]))
        out.append(found)
    return out


def _whole(text: str, starts: list[int], ends: list[int], k: int, j: int, kind: str) -> list[tuple[int, int]]:
    """A labelled span, or its tokens where each is a whole piece of the kind by itself."""
    if j > k and kind in ("email", "phone", "id_number"):
        own = [(starts[i], ends[i]) for i in range(k, j + 1) if checked(text, starts[i], ends[i], kind) is not None]
        if own:
            return own
    return [(starts[k], ends[j])]


def checked(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span without loose marks, if it is a whole piece of its kind."""
    while a < b and (text[a].isspace() or text[a] in ",;:|—–-«\"“ "):
        a += 1
    while a < b and (text[b - 1].isspace() or text[b - 1] in ",;:|—–-«»\"“”!?" or (text[b - 1] == "." and not _INITIAL.fullmatch(text[max(a, b - 2) : b]))):
        b -= 1
    value = text[a:b]
    digits = re.sub(r"\D", "", value)
    if kind == "email":
        return (a, b) if _MAILBOX.fullmatch(value) else None
    if kind == "phone":
        if text[:a].rstrip().endswith("№"):
            return None
        lead = value[:1] == "+" or "(" in value or (len(digits) == 11 and digits[0] in "78")
        return (a, b) if 10 <= len(digits) <= 15 and lead and re.fullmatch(r"[\d\s+()./\-‑–   ]+", value) else None
    if kind == "id_number":
        holds = len(digits) == 10 or snils_holds(digits) or inn_holds(digits)
        return (a, b) if holds and re.fullmatch(r"[\d\s№\-‑–   ]+", value) else None
    if kind == "address":
        return _address(text, a, b)
    # a name is written in one letter case: a small word before capital ones is none of it
    while (m := re.match(r"[а-яёa-z]+\s+(?=[^\W\d_])", text[a:b])) and re.search(r"(?<!\w)[А-ЯЁA-Z]", text[a:b]):
        a += m.end()
    value = text[a:b]
    # a second initial belongs to the first
    if len(re.findall(r"\b[A-ZА-ЯЁ]\.", value)) == 1:
        if value[-1] == "." and (m := re.match(r"\s?[A-ZА-ЯЁ]\.(?!\w)", text[b : b + 4])):
            b += m.end()
        elif value[1:2] == "." and (m := re.search(r"(?<!\w)[A-ZА-ЯЁ]\.\s?$", text[max(0, a - 3) : a])):
            a -= len(m.group())
    words = re.findall(r"[^\W\d_]+", text[a:b])
    if len(words) < 2 or digits or len(words) > 4 or not re.fullmatch(r"[А-ЯЁа-яёA-Za-z.\s\-'’]+", text[a:b]):
        return None
    full = [w for w in words if len(w) > 1]
    if not full or (len(full) == 1 and len(full[0]) < 3):
        return None
    if all(w.islower() and first_name(w) for w in full):
        return None  # «вера», «роман» and the like are words too
    if any(first_name(w) or (_PATRONYMIC.search(w) and len(w) > 5) for w in full):
        return a, b
    if len(full) == 1:  # a surname with initials
        return (a, b) if len(words) > 1 and full[0][0].isupper() and not full[0].isupper() or _SURNAME.search(full[0]) else None
    capital = all(w[0].isupper() and w[1:].islower() for w in full)
    return (a, b) if capital and any(_SURNAME.search(w) or _LATIN_SURNAME.search(w) for w in full) else None


_WAY_WORD = re.compile(r"\b(?:ул|улица|улице|улицы|пер|переул\w+|просп|проспект\w*|пр-кт|пр-т|бульвар\w*|б-р|шоссе|ш|набережн\w+|наб|площад\w+|пл|проезд\w*|тупик|аллея|д|дом|кв|street|lane|road|avenue|drive|square|st|rd|ave|apt|flat)\b", re.I)
_HOUSE_NUMBER = re.compile(r"(?<!\d)\d{1,4}(?!\d)")


def _address(text: str, a: int, b: int) -> tuple[int, int] | None:
    """An address names a way or a house, has a house number, and is one line of a card or table."""
    value = text[a:b]
    return (a, b) if len(value) <= 160 and "|" not in value and _WAY_WORD.search(value) and _HOUSE_NUMBER.search(value) else None


_PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "person_name": "[NAME]"}


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by the placeholder of its kind."""
    at, parts = 0, []
    for a, b, kind in sorted(found):
        if a < at:
            continue
        parts += [text[at:a], _PLACEHOLDERS[kind]]
        at = b
    return "".join([*parts, text[at:]])


_FIELDS: dict[str, Field] = {}


def _shared(spark):
    field = train()
    name = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast((field.vocabulary, field.w, field.f, field.t))

    def get() -> Field:
        if name not in _FIELDS:
            _FIELDS.clear()
            _FIELDS[name] = Field(*sent.value)
        return _FIELDS[name]

    return get


def _parts(texts: list, size: int = 2_000_000):
    """Stretches of a batch of bounded total length."""
    start = total = 0
    for k, t in enumerate(texts):
        total += len(t or "")
        if total > size:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def personal_information(texts: DataFrame) -> DataFrame:
    """``(rec_table, rec_id, kind, value)``, distinct within a row of ``texts(rec_table, rec_id, text)``; a narrow map."""
    get = _shared(texts.sparkSession)

    def run(batches):
        field = get()
        for batch in batches:
            tables, ids, rows = (batch.column(i).to_pylist() for i in range(3))
            for a, b in _parts(rows):
                out: tuple[list, list, list, list] = ([], [], [], [])
                for r, found in zip(range(a, b), find_all(rows[a:b], field)):
                    for kind, value in dict.fromkeys((k, rows[r][x:y]) for x, y, k in found):
                        for col, v in zip(out, (tables[r], ids[r], kind, value)):
                            col.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["rec_table", "rec_id", "kind", "value"])

    rows = texts.select("rec_table", "rec_id", "text").where(F.col("text").isNotNull())
    return spread(rows).mapInArrow(run, "rec_table string, rec_id long, kind string, value string")


def redacted(texts: DataFrame) -> DataFrame:
    """``(rec_table, rec_id, text)`` with typed placeholders."""
    get = _shared(texts.sparkSession)

    def run(batches):
        field = get()
        for batch in batches:
            rows = batch.column(2).to_pylist()
            out = []
            for a, b in _parts(rows):
                out += [redact(t, f) if t else t for t, f in zip(rows[a:b], find_all(rows[a:b], field))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["rec_table", "rec_id", "text"])

    return spread(texts.select("rec_table", "rec_id", "text")).mapInArrow(run, "rec_table string, rec_id long, text string")
