"""Problem 4: freely typed headings mapped to a reference list by a prefix-filter set-similarity join.

Each distinct heading is brought to its plain words (separators, numbering,
look-alike letters and transliteration settled); a shortened word is spelt out
as each entry has it that has a word so beginning, found by a join.  Headings
and entries become sets of letter pairs within words, one to three places
apart, and of first letters, so that the order of words does not count and a slip of the pen touches
few pairs.  Pairs are ordered by global rarity, only the rare prefixes are
joined, length and positional filters cut the candidates, Jaccard similarity is
verified exactly, and the best entry is kept; 0 stands for no entry.

The reference list stays a table; nothing of it is collected.

Defined results: null and blank headings give no row; a tie goes to the smaller
``ref_id``; with an empty reference list every heading gets 0; copies of a
heading all get its entry.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .lookalike import INVISIBLE

JACCARD = 0.48
#: A pair's letters stand at most so many places apart.
APART = 3

# fixed values: transliteration of Cyrillic letters
_TRANSLIT = str.maketrans(
    dict(zip("абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye"))
    | {"ё": "yo", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}
)
# fixed values: Latin letters of the shape of a Cyrillic one, and the reverse
_TO_CYRILLIC = str.maketrans("ABCEHKMOPTXYaceopxyiuBHKMT", "АВСЕНКМОРТХУасеорхуіиВНКМТ")
_TO_LATIN = str.maketrans("АВСЕНКМОРТХУасеорхуіѕј", "ABCEHKMOPTXYaceopxyisj")
# fixed values: words that say whose value it is or that it is needed
_FILLERS = frozenset(
    """заявителя заявительницы сотрудника сотрудницы пациента пациентки клиента клиентки работника гражданина гражданки абонента
    получателя отправителя покупателя владельца держателя студента ученика ребёнка ребенка родителя представителя контрагента
    участника посетителя пользователя соискателя кандидата абитуриента лица субъекта плательщика заказчика
    обязательно обязательное необязательно при наличии required optional mandatory
    applicant employee patient client customer user holder""".split()
)
_NUMBERING = re.compile(r"^\s*(?:[*\-•–—#]+\s*)?(?:\(?\d{1,3}[.)\]:](?!\d)\s*)?")
_CAMEL = re.compile(r"(?<=[a-zа-яё])(?=[A-ZА-ЯЁ])")
_WORDS = re.compile(r"[^\W_]+\.?")
_LATIN, _CYRILLIC = re.compile("[A-Za-z]"), re.compile("[А-Яа-яЁёІіЅѕЈј]")
_DROP = dict.fromkeys(map(ord, INVISIBLE))


_C_SHAPES, _L_SHAPES = frozenset("АВСЕНКМОРТХУасеорхуіѕј"), frozenset("ABCEHKMOPTXYaceopxyi")


def _one_alphabet(word: str, heading: str) -> str:
    """A word whose letters are borrowed from the other alphabet, in the alphabet of most of its own letters, else of the heading."""
    cyr, lat = _CYRILLIC.findall(word), _LATIN.findall(word)
    only_c, only_l = sum(c not in _C_SHAPES for c in cyr), sum(c not in _L_SHAPES for c in lat)
    if only_c and only_l or (cyr and only_c and not lat) or (lat and only_l and not cyr):
        return word.translate(_TO_CYRILLIC if only_c >= only_l else _TO_LATIN) if cyr and lat else word
    if only_c or only_l:
        return word.translate(_TO_CYRILLIC if only_c else _TO_LATIN)
    # every letter could be of either
    rest_c, rest_l = (sum(c not in own for c in found) for own, found in ((_C_SHAPES, _CYRILLIC.findall(heading)), (_L_SHAPES, _LATIN.findall(heading))))
    if rest_c == rest_l:
        return word.translate(_TO_CYRILLIC) if cyr and lat else word
    return word.translate(_TO_CYRILLIC if rest_c > rest_l else _TO_LATIN)


def words_of(heading: str) -> list[str]:
    """The heading's words in lower case, each with its full stop if it is shortened."""
    text = unicodedata.normalize("NFKC", heading).translate(_DROP)
    text = _NUMBERING.sub("", text)
    out = []
    text = re.sub(r"(?<=\b[^\W\d_])/(?=[^\W\d_]\b)", "", text)  # «р/с»
    text = re.sub(r"[^\W\d_]+", lambda m: _one_alphabet(m.group(), text), text)
    if not text.isupper():
        text = _CAMEL.sub(" ", text)
    text = re.sub(r"(?<=[^\W\d_]{2})\.(?=[^\W\d_])", " ", text) if text.count(".") > 1 or not re.search(r"\.\s", text) else text
    for m in _WORDS.finditer(text):
        w = m.group().lower()
        if w.rstrip(".").isdigit():
            continue
        out.append(w)
    kept = [w for w in out if w.rstrip(".") not in _FILLERS]
    return kept or out


_DIGRAPH = re.compile("shch|ch|sh|zh|kh|ts|ya|yu|yo")
# fixed values: one sign for each transliterated letter of several, so that it counts as one letter
_ONE = {"shch": "щ", "ch": "ч", "sh": "ш", "zh": "ж", "kh": "х", "ts": "ц", "ya": "я", "yu": "ю", "yo": "e"}


def latin(text: str) -> str:
    """Letters and digits in one alphabet, whether typed in Cyrillic or transliterated."""
    plain = "".join(c for c in text.lower().translate(_TRANSLIT) if c.isalnum())
    return _DIGRAPH.sub(lambda m: _ONE[m.group()], plain)


def plain_words(heading: str) -> tuple[list[str], list[str]]:
    """The heading's words in one alphabet, in alphabetical order, and those of them that are shortened."""
    words, short = [], []
    for w in words_of(heading):
        if stem := latin(w):
            words.append(stem)
            if w.endswith(".") and len(stem) > 2:
                short.append(stem)
    return sorted(words), sorted(set(short))


def grams(words: list[str]) -> list[str]:
    """The set of letter pairs within words and of the words' first letters, repeated ones told apart by their number."""
    seen: dict[str, int] = {}
    out = []
    for word in words:
        padded = f"^{word}$"
        pairs = [a + b for k, a in enumerate(padded) for b in padded[k + 1 : k + 1 + APART]]
        for g in (*pairs, f"^{word[:2]}", f"^{word[:3]}"):
            n = seen[g] = seen.get(g, 0) + 1
            out.append(f"{g}{n}")
    return out


def _with_grams(forms: DataFrame) -> DataFrame:
    """``forms(..., words)`` with their sets of pairs."""
    keys = [c for c in forms.columns if c != "words"]

    def run(cols):
        return cols | {"grams": [grams(w) for w in cols["words"]]}

    types = dict(forms.dtypes)
    return map_batches(forms.select(*keys, "words"), run, ", ".join(f"`{c}` {types[c]}" for c in [*keys, "words"]) + ", grams array<string>")


def map_headings(headings: DataFrame, reference: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """``(field_name, ref_id)`` for every distinct value of ``headings.field_name`` that is neither null nor blank."""

    def read(cols):
        parts = [plain_words(name) for name in cols["name"]]
        return {"i": cols["i"], "name": cols["name"], "words": [p[0] for p in parts], "short": [p[1] for p in parts]}

    schema = "i int, name string, words array<string>, short array<string>"
    distinct = headings.select("field_name").where(F.col("field_name").isNotNull() & F.col("field_name").rlike(r"(?U)\S")).distinct()
    typed = map_batches(distinct.select(F.lit(0).alias("i"), F.col("field_name").alias("name")), read, schema).where(F.size("words") > 0)
    names = reference.select(F.col("ref_id").cast("int").alias("i"), F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where(F.col("name").isNotNull())
    entries = map_batches(names, read, schema).where(F.size("words") > 0).select(F.col("i").alias("ref_id"), F.col("words").alias("ref_words")).distinct()

    # a shortened word is spelt as an entry spells it: one more form for each entry that has such a word
    stems = typed.select("name", "words", F.explode("short").alias("stem"))
    full = entries.select("ref_words", F.explode("ref_words").alias("word")).distinct()
    begins = (F.substring("stem", 1, 3) == F.substring("word", 1, 3)) & F.col("word").startswith(F.col("stem"))
    spelt = (
        stems.join(full, begins)
        .groupBy("name", "words", "ref_words", "stem")
        .agg(F.min("word").alias("word"))
        .groupBy("name", "words", "ref_words")
        .agg(F.map_from_entries(F.collect_list(F.struct("stem", "word"))).alias("m"))
        .select("name", F.array_sort(F.transform("words", lambda w: F.coalesce(F.try_element_at("m", w), w))).alias("words"))
    )
    forms = typed.select("name", "words").unionByName(spelt).distinct()
    left_sets = _with_grams(forms.select("words").distinct())
    right_sets = _with_grams(entries.select("ref_id", F.col("ref_words").alias("words"))).withColumnsRenamed({"words": "ref_words", "grams": "ref_grams"})
    rarity = left_sets.select(F.explode("grams").alias("g")).unionAll(right_sets.select(F.explode("ref_grams").alias("g"))).groupBy("g").agg(F.count("*").alias("n"))

    def prefixes(sets: DataFrame, keys: list[str], col: str) -> DataFrame:
        """The rare prefix of every set: its first ``|s| - ceil(t |s|) + 1`` pairs in the order of rarity, with their places."""
        size = F.size(col)
        ranked = (
            sets.select(*keys, size.alias("size"), F.explode(col).alias("g"))
            .join(rarity, "g")
            .groupBy(*keys, "size")
            .agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("order"))
        )
        length = (F.col("size") - F.ceil(F.col("size") * jaccard) + 1).cast("int")
        return ranked.select(*keys, "size", F.posexplode(F.slice("order", F.lit(1), length)).alias("place", "x")).select(*keys, "size", "place", F.col("x.g").alias("g"))

    left = prefixes(left_sets, ["words"], "grams")
    right = prefixes(right_sets, ["ref_id", "ref_words"], "ref_grams").withColumnsRenamed({"size": "ref_size", "place": "ref_place"})
    overlap = F.lit(jaccard) / (1 + jaccard) * (F.col("size") + F.col("ref_size"))
    candidates = (
        left.join(right, "g")
        .where((F.col("ref_size") >= F.col("size") * jaccard) & (F.col("ref_size") <= F.col("size") / jaccard))
        .where(1 + F.least(F.col("size") - F.col("place") - 1, F.col("ref_size") - F.col("ref_place") - 1) >= overlap - 1e-9)
        .select("words", "ref_id", "ref_words")
        .distinct()
    )

    def verify(cols):
        out = {"words": [], "ref_id": [], "similarity": []}
        for words, i, entry in zip(cols["words"], cols["ref_id"], cols["ref_words"]):
            a, b = set(grams(words)), set(grams(entry))
            similarity = len(a & b) / len(a | b)
            if similarity >= jaccard:
                for k, v in zip(out, (words, i, similarity)):
                    out[k].append(v)
        return out

    verified = map_batches(candidates, verify, "words array<string>, ref_id int, similarity double")
    best = (
        forms.join(verified, "words")
        .groupBy(F.col("name").alias("field_name"))
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "ref_id")).alias("b"))
        .select("field_name", F.col("b.ref_id").alias("ref_id"))
    )
    return distinct.join(best, "field_name", "left").select("field_name", F.coalesce("ref_id", F.lit(0)).alias("ref_id"))


def map_rows(chunks: DataFrame, reference: DataFrame) -> DataFrame:
    """``(chunk_id, ref_id)`` of every row with a heading; hot headings are few distinct values, so one small table is joined back."""
    mapped = map_headings(chunks, reference)
    return chunks.select("chunk_id", "field_name").where(F.col("field_name").isNotNull()).join(mapped, "field_name").select("chunk_id", "ref_id")
