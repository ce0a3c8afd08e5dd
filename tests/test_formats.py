"""Legacy workbooks, PDF pages, states of files, and the places for models."""

import math
import struct
import sys
import zlib

import pytest
from pyspark import cloudpickle

import sievemark
from sievemark.config import ScanConfig
from sievemark.operators import finding as B
from sievemark.operators import recognise as M
from sievemark.plans import scan as S
from sievemark.sources import available, biff, chunks, extract, pdf

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import test modules

# --- legacy workbooks --------------------------------------------------------


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def short(text, wide_count=True):
    return struct.pack("<H" if wide_count else "<B", len(text)) + b"\x01" + text.encode("utf-16le")


def workbook(rows, title="Лист1", cut=None):
    """A workbook's stream: strings shared, numbers whole, short and in a row; ``cut`` breaks the shared strings into two records."""
    words = [v for row in rows for v in row if isinstance(v, str)]
    strings = struct.pack("<II", len(words), len(words)) + b"".join(short(w) for w in words)
    sst = record(0xFC, strings) if cut is None else record(0xFC, strings[:cut]) + record(0x3C, b"\x01" + strings[cut:])
    bof = record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    head = bof + record(0x85, struct.pack("<IBB", 0, 0, 0) + short(title, False)) + sst + record(0x0A, b"")
    cells, n = b"", 0
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            at = struct.pack("<HHH", r, c, 0)
            if isinstance(v, str):
                cells += record(0xFD, at + struct.pack("<I", n))
                n += 1
            elif isinstance(v, bool):
                cells += record(0x205, at + bytes([v, 0]))
            elif isinstance(v, int):
                cells += record(0x27E, at + struct.pack("<I", (v << 2 | 2) & 0xFFFFFFFF))
            elif isinstance(v, float):
                cells += record(0x203, at + struct.pack("<d", v))
    place = len(head)
    head = head.replace(struct.pack("<IBB", 0, 0, 0) + short(title, False), struct.pack("<IBB", place, 0, 0) + short(title, False))
    return head + bof + cells + record(0x0A, b"")


def compound(stream):
    """The stream as the only one of a compound file, in ordinary sectors."""
    stream = stream.ljust(max(len(stream), 4096), b"\0")
    count = -(-len(stream) // 512)
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, count + 2), 0xFFFFFFFE]
    entry = lambda name, kind, start, size: (name.encode("utf-16le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + struct.pack("<III", *[0xFFFFFFFF] * 3) + b"\0" * 36 + struct.pack("<IQ", start, size)
    head = biff._MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<I", 0) + struct.pack("<I", 0xFFFFFFFF) * 108
    folder = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream))).ljust(512, b"\0")
    return head + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + folder + stream.ljust(count * 512, b"\0")


ROWS = [["ФИО", "Сумма", "Готово"], ["Иванов Иван", 12, True], ["Пётр", -3.5, None], [], ["конец"]]


@pytest.mark.parametrize("raw", [workbook(ROWS), workbook(ROWS, cut=39), compound(workbook(ROWS))])
def test_workbook(raw):
    ((title, rows),) = biff.sheets(raw)
    assert title == "Лист1" and rows == [["ФИО", "Сумма", "Готово"], ["Иванов Иван", 12.0, True], ["Пётр", -3.5], [], ["конец"]]
    text, method, _, _ = extract.extract("a.xls", raw, ScanConfig("x"))
    assert method == "xls_xlrd" and text.startswith("[sheet] Лист1\nФИО | Сумма | Готово\nИванов Иван | 12.0 | True\nПётр | -3.5 |")
    got = list(chunks.xls("a.xls", raw))
    assert [(t, n) for t, _, n, _ in got] == [("Иванов Иван", "ФИО"), ("12.0", "Сумма"), ("True", "Готово"), ("Пётр", "ФИО"), ("-3.5", "Сумма"), ("конец", "ФИО")]
    assert got[1][1] == "a.xls#sheet=Лист1!R2C2" and got[1][3]["row"] == 2


def test_no_workbook():
    assert extract.extract("a.xls", b"some printable bytes", ScanConfig("x"))[1] == "spreadsheet_binary_fallback"
    with pytest.raises(biff.NotAWorkbook):
        list(biff.sheets(b"\xd0\xcf"))


# --- pages of PDF ------------------------------------------------------------


def pdf_file(texts, scanned=False):
    out = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 3 * n) for n in range(len(texts))) + b"] >> endobj\n"
    for n, t in enumerate(texts):
        packed = zlib.compress(b"BT (%s) Tj [(more) -20 ( text)] TJ ET" % t.encode() if t else b"q Q")
        held = b"/XObject << /I 5 0 R >>" if scanned else b"/Font << /F 6 0 R >>"
        k = 10 + 3 * n
        out += b"%d 0 obj << /Type /Page /Parent 2 0 R /Resources << %s >> /Contents %d 0 R >> endobj\n%d 0 obj << /Filter /FlateDecode >> stream\n%s\nendstream endobj\n" % (k, held, k + 1, k + 1, packed)
    return out + b"5 0 obj << /Subtype /Image >> stream\nx\nendstream endobj\n6 0 obj << /Type /Font >> endobj\n%%EOF"


def test_pages(monkeypatch):
    raw = pdf_file(["first \\(page\\)", "", "third"])
    assert [p.text for p in pdf.pages(raw)] == ["first (page)\nmore text", "", "third\nmore text"]
    assert [(s, m["page"]) for _, s, _, m in chunks.pdf("a.pdf", raw)] == [("a.pdf#page=1", 1), ("a.pdf#page=3", 3)]
    scan = pdf_file([""] * 30, scanned=True)
    own = list(pdf.pages(scan))
    assert len(own) == 30 and pdf.looks_scanned(own) and not pdf.looks_scanned(list(pdf.pages(raw))) and not pdf.looks_scanned([])
    asked = []
    monkeypatch.setattr(extract, "PAGE_OCR", lambda b, n: asked.append(n) or ("слово " * 20 if n % 2 else ""))
    text, method, notes, _ = extract.extract("a.pdf", scan, ScanConfig("x", enable_ocr=True))
    assert method == "pdf_ocr" and text.count("слово") == 8 * 20 and notes == ["PDF-скан из 30 страниц, OCR применен к первым 15."] and len(asked) == len(set(asked))
    assert [m["via_ocr"] for *_, m in chunks.pdf("a.pdf", scan)] == [True] * 15
    monkeypatch.setattr(extract, "PAGE_OCR", lambda b, n: asked.append(n) or "")
    asked.clear()
    assert extract.extract("a.pdf", scan, ScanConfig("x", enable_ocr=True))[1] != "pdf_ocr" and asked == pdf.sample_pages(30)


@pytest.mark.parametrize("count,pages", [(0, []), (1, [1]), (2, [1, 2]), (3, [1, 3]), (30, [1, 6, 11, 16, 21, 30]), (100, [1, 17, 33, 49, 65, 100])])
def test_sample(count, pages):
    assert pdf.sample_pages(count) == pages


# --- states of files ---------------------------------------------------------


def test_states(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / ".hidden.txt").write_text("Почта a@b.test", "utf-8")
    (tmp_path / "in" / "page.html").write_text("<p>Паспорт 4510 123456, СНИЛС 112-233-445 95</p>", "utf-8")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "old.doc").write_bytes(b"x")
    (tmp_path / "scan.png").write_bytes(b"x")
    monkeypatch.setattr(chunks, "converter", lambda: None)
    rows, found = S.scan_findings(spark, ScanConfig(str(tmp_path)))
    got = {r["filename"]: r for r in rows.collect()}
    assert {k: r["status"] for k, r in got.items()} == {".hidden.txt": "ok", "page.html": "ok", "bad.docx": "error", "old.doc": "skipped", "scan.png": "skipped"}
    assert got[".hidden.txt"]["categories"] == {"EMAIL": 1} and got["page.html"]["uz_level"] == 3 and got["bad.docx"]["notes"] and got["bad.docx"]["uz_level"] is None
    assert found.count() == 3
    assert S.scan_findings(spark, ScanConfig(str(tmp_path), include_extensions=frozenset(["zzz"])))[0].count() == 0


# --- models ------------------------------------------------------------------


def people():
    import re

    def find(texts):
        return [[(m.start(), m.end(), "PER", m.group().title()) for m in re.finditer("иван петров|и\\.", t)] + [(m.start(), m.end(), "LOC", m.group()) for m in re.finditer("тверь", t)] for t in texts]

    return find


def nothing():
    return None


def broken():
    raise ImportError("no such model")


def test_names_of_a_recogniser(spark):
    rows = [("f", 0, "пришёл иван петров и и. в тверь", "f#1", None), ("f", 1, "снова иван петров", "f#2", ""), ("f", 2, "иван петров", "f#3", "номер"), ("g", 0, None, "g#1", None), ("g", 1, " ", "g#2", None)]
    df = spark.createDataFrame(rows, "path string, chunk_seq int, text string, source string, field_name string")
    spans = M.with_spans(df, people)
    first = spans.where("path = 'f' AND chunk_seq = 0").first()
    assert [(p["value"], p["start"], p["end"]) for p in first["persons"]] == [("Иван Петров", 7, 18), ("И.", 21, 23)] and first["others"][0]["value"] == "тверь"
    got = [(r["path"], r["category"], r["masked"], r["source"]) for r in B.findings(spans, "persons").collect()]
    assert got == [("f", "FIO", "И.(4) П.(6)", "f#1")]
    for load in (nothing, broken):
        assert B.findings(M.with_spans(df, load), "persons").count() == 0
    assert B.findings(df).count() == 0
    with pytest.raises(Exception):
        M.with_spans(df, broken, strict=True).collect()


def logits():
    return lambda texts: [[4.0 if "диагноз" in t else -4.0, math.log(0.45 / 0.55) + 1e-6, -9.0, 900.0] for t in texts]


def test_labels_of_a_model(spark):
    texts = ["Пациент. " * 120 + "Его диагноз известен. " * 3, "Пациент и гражданин.", "Кино.", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {r["n"]: r["labels"] for r in M.with_labels(df, logits).collect()}
    assert got[0] == {"health": 1, "beliefs": 1, "other": 1} and got[1] == {"beliefs": 1, "other": 1} and got[2] == got[3] == got[4] == {}
    assert {len(r["labels"]) for r in M.with_labels(df, nothing).collect()} == {0}
    assert M.with_labels(df.limit(0), logits).count() == 0
    assert M.warm_up(spark, people) == spark.sparkContext.defaultParallelism and M.warm_up(spark, nothing) == 0


def test_exports():
    assert all(getattr(sievemark, name) is not None for name in sievemark.__all__) and available("json") and not available("no_such_module.at_all")
    with pytest.raises(AttributeError):
        sievemark.nothing
