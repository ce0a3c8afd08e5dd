"""Special and biometric categories: keyword counts, the gate before a model, chunk choice, labels to counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from ..functions.normalize import chunks
from ..functions.spans import any_of, hits

COUNTS = "struct<" + ",".join(f"`{c}`:int" for c in vocab.DOC_CATEGORIES) + ">"
EVIDENCE_WORDS = tuple(dict.fromkeys(w for words in vocab.LABEL_EVIDENCE.values() for w in words))
TRIGGERS = tuple(dict.fromkeys(EVIDENCE_WORDS + vocab.BIOMETRIC_WORDS + vocab.SPECIAL_WORDS))


def counts(**given: Column) -> Column:
    """A struct of the five categories; those not given are zero."""
    return F.struct(*[F.coalesce(given.get(c, F.lit(0)), F.lit(0)).cast("int").alias(c) for c in vocab.DOC_CATEGORIES])


def add(*structs: Column) -> Column:
    """Category-wise sum."""
    return F.struct(*[reduce(lambda a, b: a + b, (s[c] for s in structs)).cast("int").alias(c) for c in vocab.DOC_CATEGORIES])


def keyword_counts(low: Column) -> Column:
    """How many biometric and special words a text in lower case holds."""
    return counts(биометрические=hits(low, vocab.BIOMETRIC_WORDS), специальные=hits(low, vocab.SPECIAL_WORDS))


def policy_noise(low: Column) -> Column:
    return any_of(low, vocab.POLICY_NOISE)


def label_evidence(low: Column, label: str) -> Column:
    return any_of(low, vocab.LABEL_EVIDENCE[label])


def any_evidence(low: Column) -> Column:
    return any_of(low, EVIDENCE_WORDS)


def gate(low: Column) -> Column:
    """Is a text worth the model? Judged by its beginning and end."""
    n = F.length(low)
    sample = F.when(n <= 2 * vocab.GATE_SAMPLE, low).otherwise(F.concat(F.substring(low, 1, vocab.GATE_SAMPLE), F.right(low, F.lit(vocab.GATE_SAMPLE))))
    noise = policy_noise(sample) & ~any_evidence(sample)
    persons = (n >= vocab.GATE_MIN_LENGTH) & (hits(sample, vocab.PERSON_WORDS) >= vocab.GATE_PERSON_HITS)
    return F.when(F.coalesce(n, F.lit(0)) == 0, False).when(noise, False).otherwise(any_of(sample, TRIGGERS) | persons)


def relevant_chunks(text: Column, most: int = vocab.TOP_CHUNKS) -> Column:
    """The chunks with the most trigger words, ties in their order; the first ones where none has any."""
    parts = chunks(text)

    def scored(chunk: Column, i: Column) -> Column:
        low = F.lower(chunk)
        n = hits(low, TRIGGERS)
        return F.struct((-F.when(n > 0, n).when(any_of(low, vocab.PERSON_WORDS), 1).otherwise(0)).alias("s"), i.alias("i"), chunk.alias("c"))

    ranked = F.array_sort(F.filter(F.transform(parts, scored), lambda x: x["s"] < 0))
    chosen = F.transform(F.slice(ranked, 1, most), lambda x: x["c"])
    return F.when(F.size(ranked) > 0, chosen).otherwise(F.slice(parts, 1, most))


def labels_to_counts(low: Column, labels: Column) -> Column:
    """Counts of a model's labels (``map<string,int>``), each only with evidence in the text."""

    def on(label: str) -> Column:
        return (F.coalesce(F.try_element_at(labels, F.lit(label)), F.lit(0)) != 0) & label_evidence(low, label)

    biometric = on("other") & any_of(low, vocab.BIOMETRIC_WORDS)
    special = sum((on(x).cast("int") for x in ("health", "beliefs", "race")), F.lit(0)) + (on("other") & ~any_of(low, vocab.BIOMETRIC_WORDS)).cast("int")
    open_ = gate(low) & ~(policy_noise(low) & ~any_evidence(low))
    return F.when(open_, counts(биометрические=biometric.cast("int"), специальные=special)).otherwise(counts())


def classifier_counts(low: Column, labels: Column | None = None) -> Column:
    """Zero behind a closed gate; a model's labels where it gave some, else keyword counts."""
    words = keyword_counts(low)
    if labels is not None:
        words = F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, labels_to_counts(low, labels)).otherwise(words)
    return F.when(gate(low), words).otherwise(counts())
