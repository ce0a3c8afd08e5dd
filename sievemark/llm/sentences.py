"""Problem 10: sentence units of texts in any language and script.

The character properties of the public sentence-break rules (full stops,
sentence terminators, closing marks, of all scripts) name the candidates; a
candidate becomes a boundary unless abbreviation, number, initial or quotation
rules forbid it.  Abbreviations are those of the language of the paragraph: its
script tells it, and for Latin letters its most usual words, then those of the
whole text; a language column is not needed and not read.  An empty line always ends a sentence.  In Thai, whose
sentences carry no mark, a blank between two Thai letters is the candidate.

Defined results: null, empty and blank texts have no sentence; repeated rows
give their sentences each; a text without any mark is one sentence; the units
joined with the white space between them give back the text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches


def _property(name: str) -> str:
    """All characters of a sentence-break property."""
    test = regex.compile(rf"\p{{Sentence_Break={name}}}")
    return "".join(c for x in range(0x110000) if not 0xD800 <= x < 0xE000 and test.match(c := chr(x)))


_STERM = _property("STerm") + "…"
_ATERM = _property("ATerm")
_NO_BLANK = set("。！？｡︒﹖﹗")  # these end a sentence without a blank after them
_PAIRS = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "‹": "›"}
# marks of the closing property that only open are no closers: initial and opening punctuation
_CLOSERS = {c for c in _property("Close") if unicodedata.category(c) not in ("Ps", "Pi")} | {"’"}
_EVENTS = frozenset(_STERM + _ATERM)
_QUOTES = frozenset("«»“”„「」『』()（）[]【】《》‹›\"")


@lru_cache(maxsize=4096)
def _event_pattern(marks: frozenset, quotes: frozenset) -> re.Pattern:
    """A pattern of only those marks that a text holds: a small class is searched much faster."""
    parts = ["[" + re.escape("".join(sorted(marks))) + "]+"] * bool(marks) + ["[" + re.escape("".join(sorted(quotes))) + "]"] * bool(quotes)
    return re.compile("|".join(parts) or r"(?!)")
# an empty line; carriage returns are blanks here, and old line ends without a line feed are rare enough for a pattern of their own
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_OTHER_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*|\r[^\S\r\n]*\r\s*| \s*|[\x85 ][^\S\n]*[\n\x85 ]\s*")
_OTHER_ENDS = frozenset("\r\x85  ")
_THAI_LETTERS = frozenset(map(chr, range(0x0E01, 0x0E5C)))
_THAI_BLANK = re.compile(r"(?<=[ก-๎๚])\s+(?=[ก-๎])")
_SKIP = re.compile(r"\s*")

# fixed values: abbreviations by language; the first are followed by what they introduce and so never end a sentence,
# the second do so before a figure, the third may end a sentence and do where the next one visibly begins
ABBREVIATIONS = {
    "cyrillic": (
        """проф акад доц канд инж им ул пер просп пл наб бул ш д корп стр кв оф эт тел доб факс моб см ср рис табл илл п пп ст гл разд прил напр т
        тт с сс обл р-н пос дер сост ред изд вып № ч нач зав зам гр гос св""",
        "",
        "др пр руб коп тыс млн млрд трлн экз шт гг вв долл кг мин сек час т.д т.п т.е т.к",
    ),
    "en": (
        "dr prof mr mrs ms st rev hon gen col capt lt sgt messrs e.g i.e cf vs approx viz",
        "no nos nr sec secs fig figs p pp vol vols ch eq ref eds ed art arts para tel ext",
        "inc ltd co corp jr sr a.m p.m etc u.s u.k dept est",
    ),
    "de": (
        "dr prof z.b d.h bzw vgl hr fr frl inkl exkl evtl ggf sog zzgl st e d z u",
        "abs art nr nrn s seite bd kap ziff tel str mind max ca abb tab",
        "usw u.a mio mrd std etc gmbh co",
    ),
    "devanagari": ("डॉ श्री सुश्री पं प्रो रु", "", ""),
    "thai": ("ดร นพ พญ ผศ รศ ศ", "", ""),
    "arabic": ("د أ م ص ج", "", ""),
}
_ABBREVIATIONS = {k: tuple(frozenset(x.split()) for x in v) for k, v in ABBREVIATIONS.items()}
#: Where usual words do not tell the language, what both have.
_ABBREVIATIONS["latin"] = tuple(a & b if k == 0 else a | b for k, (a, b) in enumerate(zip(_ABBREVIATIONS["en"], _ABBREVIATIONS["de"])))
_ANY_LATIN = frozenset().union(*_ABBREVIATIONS["en"], *_ABBREVIATIONS["de"])
_NONE = (frozenset(),) * 3
# fixed values: the most usual words of English and German
_USUAL = {
    "en": frozenset("the of and to in is was were for that with are at by on from it this which be has have not as we he she they you".split()),
    "de": frozenset("der die das und ist nicht ein eine einen den dem des zu mit von für auf wird im am es sie er wir auch sind war bei nach".split()),
}


def _script(word: str) -> str:
    c = next((c for c in word if c.isalpha()), "a")
    for name, low, high in (("cyrillic", "\u0400", "\u052f"), ("devanagari", "\u0900", "\u097f"), ("thai", "\u0e00", "\u0e7f"), ("arabic", "\u0600", "\u06ff")):
        if low <= c <= high:
            return name
    return "latin"


def _latin_language(text: str) -> str:
    own = [w.lower() for w in re.findall(r"[^\W\d_]+", text)]
    en, de = (sum(w in _USUAL[k] for w in own) for k in ("en", "de"))
    return "latin" if en == de else "en" if en > de else "de"


# fixed values: words before a German ordinal, and months that follow one
_BEFORE_ORDINAL = frozenset("am im zum vom beim der die das den dem des bis ab seit ein eine einen einem einer jede jeder jedes jeden".split())
_MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

#: So far back a word before a full stop is looked for; no abbreviation, initial or number of a list is as long, so a longer word is none.
_BACK = 100
#: Pairs nested deeper were never closed; the outermost are given up.
_DEPTH = 8
_WORD_BEFORE = re.compile(r"[^\s(\[{«“„\"'‘「『]*$")
_LAST_WORD = re.compile(r"([^\s]+)\s*$")


def _caseless(c: str) -> bool:
    return c.isalpha() and not c.islower() and not c.isupper() and not c.istitle()


def _attributed(rest: str) -> bool:
    """Does the text after a closing quotation mark carry the quotation's sentence on?"""
    if not rest:
        return False
    c = rest[0]
    if c in ",;:—–-،、，と":
        return True
    if c.islower():
        return True
    head = re.split(r"[。！？，、\s“「]", rest[:12], maxsplit=1)[0]
    return len(head) < 7 and bool(re.search(r"[说說問问答喊道]$", head))


class _Paragraph:
    """Boundaries within one paragraph; positions are those of the paragraph."""

    def __init__(self, text: str, pattern: re.Pattern, thai: bool, whole: str | None = None):
        self.text = text
        self.whole = text if whole is None else whole
        self.language: str | None = None
        self.pattern = pattern
        self.thai = thai
        self.starts: list[int] = []
        self.start = _SKIP.match(text).end()
        self.closes: dict[int, int] = {}  # where the pair opened at a place is closed, or -1
        self.open: list[tuple[str, int]] = []  # open quotations and brackets: the closing mark and the place of the opening one

    def cut(self, at: int) -> None:
        nxt = _SKIP.match(self.text, at).end()
        if nxt < len(self.text):
            self.starts.append(nxt)
            self.start = nxt

    def run(self) -> list[int]:
        text = self.text
        self.starts.append(self.start)
        events = self.pattern.finditer(text)
        if self.thai:
            events = sorted([*events, *_THAI_BLANK.finditer(text)], key=lambda m: m.start())
        done = 0
        for m in events:
            at, mark = m.start(), m.group()
            if at < done:
                continue
            if mark.isspace():
                if not self.open and not self._thai_abbreviation(at):
                    self.cut(at)
            elif mark in _PAIRS or mark in _CLOSERS or mark == "“":
                self._quote(mark, at)
            else:
                done = self._mark(m)
        return self.starts

    def _thai_abbreviation(self, at: int) -> bool:
        return self.text[max(0, at - 1) : at] == "."

    def _quote(self, mark: str, at: int) -> None:
        if self.open and self.open[-1][0] == mark:
            self.open.pop()
        elif mark == '"' or mark in _PAIRS:
            self.open.append((_PAIRS.get(mark, mark), at))
            del self.open[:-_DEPTH]
        else:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == mark:
                    del self.open[k:]
                    break

    def _closing(self, end: int) -> tuple[int, tuple[str, int] | None]:
        """Behind the closing marks that follow a terminator; the outermost pair that they closed."""
        text, closed = self.text, None
        while end < len(text):
            c = text[end]
            if self.open and self.open[-1][0] == c:
                closed = self.open.pop()
            elif c in "'’" and (end + 1 == len(text) or not text[end + 1].isalnum()):
                pass
            elif c in _CLOSERS and c != '"' and c not in "'’":
                pass
            else:
                break
            end += 1
        return end, closed

    def _inside_running(self) -> bool:
        """Is the terminator inside a quotation or bracket that is set in a longer sentence?"""
        text = self.text
        for closer, at in self.open:
            to = self.closes.get(at)
            if to is None or 0 <= to < self._now:
                to = self.closes[at] = text.find(closer, max(at + 1, self._now))
            if to < 0:
                continue
            if at > self.start and not self._only_opening(self.start, at):
                return True
            after = to + 1
            while after < len(text) and text[after] in _CLOSERS:
                after += 1
            if closer not in ")）]】" and _attributed(text[after:].lstrip()[:12]):
                return True
        return False

    def _only_opening(self, a: int, b: int) -> bool:
        return b - a < 20 and all(c in _PAIRS or c.isspace() or c == '"' for c in self.text[a:b])

    def _mark(self, m: re.Match) -> int:
        text, at, mark = self.text, m.start(), m.group()
        if not self.open and mark == "." and text[at + 1 : at + 2] == " ":
            # the usual case: a long word, a full stop, a blank, a capital letter
            word = text[text.rfind(" ", self.start, at) + 1 : at]
            if len(word) > 5 and word.isalpha() and text[at + 2 : at + 3].isupper():
                self.starts.append(at + 2)
                self.start = at + 2
                return at + 1
        self._now = at
        end, closed = self._closing(m.end())
        if self.open and self._inside_running():
            return end
        if end >= len(text):
            return end
        after = _SKIP.match(text, end).end()
        if after >= len(text):
            return end
        nxt, blank = text[after], after > end
        if nxt in ",;،、，" or (nxt in "—–-" and "\n" not in text[end:after]):
            return end
        dots = all(c in _ATERM for c in mark) or mark == "…"
        if closed and closed[1] > self.start and not self._only_opening(self.start, closed[1]):
            if _caseless(nxt) and any(c in _NO_BLANK or c in "?!" for c in mark) and not blank:
                return end  # a quotation inside a sentence of a script without blanks
        if closed and closed[0] not in ")）]】" and _attributed(text[after : after + 12]):
            return end
        if not blank and not any(c in _NO_BLANK for c in mark):
            if not self._missing_blank(mark, at, end, after):
                return end
        if nxt.islower() and not any(c in _NO_BLANK for c in mark):
            return end
        if dots and len(mark) == 1 and mark != "…" and not closed and self._abbreviation(at, after):
            return end
        if not (nxt.isalnum() or nxt in _PAIRS or nxt in "\"'‘№#@$€¿¡•*—–-" or ord(nxt) > 0x2190):
            return end
        self.cut(end)
        return end

    def _missing_blank(self, mark: str, at: int, end: int, after: int) -> bool:
        text = self.text
        nxt = text[after]
        if nxt in _PAIRS and any(c in _STERM for c in mark):
            return True
        if not nxt.isalpha() or nxt.islower():
            return False
        if _caseless(nxt):
            return bool(any(c in _STERM for c in mark)) or bool(end > at + 1) or text[at - 1 : at].isalpha()
        word = _WORD_BEFORE.search(text, max(self.start, at - _BACK), at).group()
        if "@" in word or "/" in word or word.lower().startswith("www"):
            return False
        prev = text[at - 1 : at]
        follows = text[after + 1 : after + 2]
        if mark == "." and prev.isupper() and len(word) > 1 and not word.isupper():
            return False
        if mark == "." and follows == ".":
            return len(word) > 2 and not prev.isupper()
        return bool(prev) and not prev.isspace() and (follows.isalpha() or follows.isspace() or not follows)

    def _abbreviations(self, word: str) -> tuple[frozenset, frozenset, frozenset]:
        """The lists of the language that ``word`` stands in."""
        script = _script(word)
        if script == "latin":
            if word.lower() not in _ANY_LATIN:
                return _NONE
            if self.language is None:
                self.language = _latin_language(self.text)
                if self.language == "latin":
                    self.language = _latin_language(self.whole)
            script = self.language
        return _ABBREVIATIONS[script]

    def _abbreviation(self, at: int, after: int) -> bool:
        """Does the full stop at ``at`` belong to an abbreviation, initial or number that does not end here?"""
        text = self.text
        word = _WORD_BEFORE.search(text, max(self.start, at - _BACK), at).group().strip("*_,;:-–—•")
        low = word.lower()
        nxt = text[after]
        if not word:
            return False
        leading, numbered, ending = self._abbreviations(word)
        lo = max(self.start, at - _BACK)
        before = text[lo : at - len(word)].rstrip()
        opening = lo == self.start and not before.strip("-–—•*«“\"( ")
        if low.isdigit() or re.fullmatch(r"\d+(?:\.\d+)*|[ivxlc]+", low):
            if opening:
                return True  # number of a list or heading
            if low.isdigit() and len(low) <= 2 and nxt.isupper():
                prev = _LAST_WORD.search(before)
                prev = prev.group(1).lower() if prev else ""
                follows = re.match(r"\w+", text[after:])
                return prev in _BEFORE_ORDINAL or (follows is not None and follows.group().lower() in _MONTHS)
            return False
        if len(word) == 1 and word.isalpha():
            if word.isupper():
                return nxt.isupper() or nxt.isdigit()
            if low in "дпеккп" and re.search(r"\bт\.\s*$", before):
                return low in "ек"  # «и т. д.» may end a sentence, «т. е.» may not
            if low == "г" and (re.search(r"\d\s*$", before)):
                return False
            return low in leading or low in "гв" or (low in numbered and nxt.isdigit())
        if low in leading or (low in numbered and (nxt.isdigit() or nxt in "№#")):
            return True
        if low == "al" and re.search(r"\bet\s*$", before):
            return True
        if low in ending or low.replace(" ", "") in ending:
            return False
        if "." in word and re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word):
            return nxt.isupper() and word[0].isupper()  # initials set close
        return False


def starts(text: str | None) -> list[int]:
    """0-based places where sentences begin."""
    if not text or text.isspace():
        return []
    present = frozenset(text)
    pattern = _event_pattern(present & _EVENTS, present & _QUOTES)
    thai = not present.isdisjoint(_THAI_LETTERS)
    out, at = [], 0
    for m in (_PARAGRAPH if present.isdisjoint(_OTHER_ENDS) or "\n" in present and "\r" in present and len(present & _OTHER_ENDS) == 1 else _OTHER_PARAGRAPH).finditer(text):
        out += _of_paragraph(text, at, m.start(), pattern, thai)
        at = m.end()
    return out + _of_paragraph(text, at, len(text), pattern, thai)


def _of_paragraph(text: str, a: int, b: int, pattern: re.Pattern, thai: bool) -> list[int]:
    part = text[a:b]
    return [] if not part or part.isspace() else [a + x for x in _Paragraph(part, pattern, thai, text).run()]


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``(id, start_pos from 1 [, sentence])``, one row per sentence; a narrow map, no shuffle."""

    def run(cols):
        ids, pos, units = [], [], []
        for i, text in zip(cols[id_col], cols["_text"]):
            own = starts(text)
            ids += [i] * len(own)
            pos += [x + 1 for x in own]
            if with_text:
                units += [text[a:b].rstrip() for a, b in zip(own, [*own[1:], len(text)])]
        return {id_col: ids, "start_pos": pos} | ({"sentence": units} if with_text else {})

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    return map_batches(rows, run, f"{id_col} long, start_pos int" + (", sentence string" if with_text else ""))
