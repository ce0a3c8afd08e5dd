"""Places for models: recognised persons and places, and labels of special categories.

A model is given as a loader, a function without arguments that returns the
model; it is called once in each Python worker, on first use.  The loader may
return None, or fail, where the model is not installed: spans and labels are
empty then, unless ``strict``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.spans import SPANS
from .classifier import gate, relevant_chunks

#: ``(start, end, kind, normal form)`` of a recognised span; kinds are PER, LOC and ORG.
Span = tuple[int, int, str, str]
Recogniser = Callable[[list[str]], Sequence[Sequence[Span]]]
Labeller = Callable[[list[str]], Sequence[Sequence[float]]]
BOTH = f"struct<persons:{SPANS},others:{SPANS}>"

_LOADED: dict[str, object] = {}


def _model(name: str, load: Callable, strict: bool):
    """What the loader gives, once a worker; None where there is no model."""
    if name not in _LOADED:
        try:
            _LOADED[name] = load()
        except Exception:
            if strict:
                raise
            _LOADED[name] = None
        if _LOADED[name] is None and strict:
            raise RuntimeError("the model is not available")
    return _LOADED[name]


def with_spans(df: DataFrame, load: Callable[[], Recogniser | None], text: str = "text", limit: int = vocab.RECOGNISED_CHARS, strict: bool = False) -> DataFrame:
    """``df`` with ``persons`` and ``others``, arrays of ``(value, start, end)`` in the first ``limit`` characters of each text; a narrow map in Arrow batches."""
    name = uuid.uuid4().hex

    @F.pandas_udf(BOTH)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(name, load, strict)
        for texts in batches:
            cut = [(t or "")[:limit] for t in texts]
            found: Sequence[Sequence[Span]] = [()] * len(cut)
            if model is not None:
                try:
                    found = model(cut)
                except Exception:
                    if strict:
                        raise
            pick = lambda own, persons: [{"value": v, "start": a, "end": b} for a, b, kind, v in own if (kind == "PER") == persons]
            yield pd.DataFrame({"persons": [pick(own, True) for own in found], "others": [pick(own, False) for own in found]})

    both = df.withColumn("_spans", spans(F.col(text)))
    return both.withColumns({"persons": F.col("_spans.persons"), "others": F.col("_spans.others")}).drop("_spans")


def with_labels(
    df: DataFrame, load: Callable[[], Labeller | None], text: str = "text", threshold: float = vocab.LABEL_THRESHOLD, most: int = vocab.TOP_CHUNKS, names: tuple[str, ...] = tuple(vocab.LABEL_EVIDENCE), gated: bool = True, strict: bool = False
) -> DataFrame:
    """``df`` with ``labels map<string,int>``: those whose probability reaches ``threshold`` in some chosen chunk of the text.

    The model gets the chunks of a whole batch at once and returns a row of
    logits for each; the greatest over a text's chunks counts.  Texts that the
    gate turns away never reach Python.
    """
    name = uuid.uuid4().hex

    @F.pandas_udf("map<string,int>")
    def labels(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(name, load, strict)
        for lists in batches:
            own = [list(x) if x is not None else [] for x in lists]
            flat = [chunk for x in own for chunk in x]
            logits = iter(model(flat)) if model is not None and flat else iter(())
            out = []
            for x in own:
                rows = [next(logits) for _ in x] if model is not None else []
                best = [max(column) for column in zip(*rows)]
                out.append({n: 1 for n, v in zip(names, best) if 1 / (1 + math.exp(-max(-500.0, min(500.0, v)))) >= threshold})
            yield pd.Series(out)

    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    chosen = relevant_chunks(F.col(text), most)
    return df.withColumn("labels", labels(F.when(gate(low), chosen).otherwise(F.array().cast("array<string>")) if gated else chosen))


def warm_up(spark, load: Callable) -> int:
    """Call a loader once in as many tasks as there are cores; how many of them got a model."""
    n = spark.sparkContext.defaultParallelism

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            try:
                ready = load() is not None
            except Exception:  # noqa: BLE001  a missing model is an answer
                ready = False
            yield pa.RecordBatch.from_arrays([pa.array([int(ready)] * batch.num_rows, pa.int32())], names=["ready"])

    return spark.range(n, numPartitions=n).mapInArrow(run, "ready int").agg(F.sum("ready")).first()[0] or 0
