"""Extra columns with clashing names, very long texts, nulls and repeated rows, for every operator."""

import pytest
from pyspark.sql import functions as F

from sievemark.llm import charset, leaks, lookalike, mainbody, names, pii, scans, sentences, split, tokenize

LONG = "Пекари накрыли яблони к празднику, и все остались довольны. " * 4000
TEXTS = ["Пекари накрыли яблони.", "Пекари накрыли яблони.", None, "", "  ", LONG, "x" * 50_000, "Заголовок\nТекст абзаца о яблонях, который достаточно длинный, чтобы быть прозой сада."]
CLASHING = ("h", "a", "b", "shape", "look", "canonical", "rare", "_text", "words", "g", "n", "size", "place", "d", "t", "k", "restored", "stem", "name", "part", "parts", "start_pos", "ids", "line_no", "kind", "value")


def rows(spark, id_col, text_col="text"):
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1])], f"{id_col} long, {text_col} string")
    return df.withColumns({c: F.lit("чужое") for c in CLASHING if c not in (id_col, text_col)})


def recs(spark):
    return rows(spark, "rec_id").withColumn("rec_table", F.lit("t"))


REF = [(1, "Фамилия", None, None), (2, "Имя", None, ["имя", None])]
RUNS = {
    "p1": lambda s: lookalike.pairs(lookalike.classes(recs(s))).columns + lookalike.consistent(recs(s)).columns,
    "p1_rows": lambda s: lookalike.consistent(recs(s)).count(),
    "p2": lambda s: mainbody.keep_lines(rows(s, "content_id"), sample=5).count(),
    "p3": lambda s: split.split_oversized(rows(s, "content_id")).count(),
    "p4": lambda s: names.map_rows(rows(s, "chunk_id", "field_name"), s.createDataFrame(REF, "ref_id int, label string, category string, aliases array<string>").withColumns({c: F.lit(1) for c in CLASHING})).count(),
    "p5": lambda s: (scans.scan_lines(rows(s, "content_id"), rows(s, "content_id")).count(), scans.repaired(rows(s, "content_id"), rows(s, "content_id")).count()),
    "p6": lambda s: charset.garbled(recs(s), with_text=True).count(),
    "p7": lambda s: (pii.personal_information(recs(s)).count(), pii.redacted(recs(s)).count()),
    "p8": lambda s: tokenize.token_ids(rows(s, "doc_id")).count(),
    "p9": lambda s: leaks.leaked_items(rows(s, "doc_id"), rows(s, "item_id")).count(),
    "p10": lambda s: sentences.sentences(rows(s, "doc_id"), with_text=True).count(),
}


@pytest.mark.parametrize("name", RUNS)
def test_clashing_columns(spark, name):
    got = RUNS[name](spark)
    every = len(TEXTS) + 1
    expected = {"p1": ["rec_table", "id_a", "id_b", "rec_table", "rec_id", "text"], "p1_rows": every, "p4": every - 3, "p6": 0, "p8": every}
    assert got == expected.get(name, got)
    if name == "p5":
        assert got[1] == every
    if name == "p7":
        assert got == (0, every)
    if name == "p3":
        assert got > 100
    if name == "p10":
        assert got > 4000
