"""Files to texts and chunks, scans, reports, command line and streams."""

import csv
import io
import json
import os
import zipfile
import zlib

import pytest

from sievemark import cli
from sievemark.config import ScanConfig
from sievemark.plans import report as R
from sievemark.plans import scan as S
from sievemark.sources import chunks as H
from sievemark.sources import extract as X
from sievemark.sources.decode import charset, decode, repair_mojibake
from sievemark.sources.files import list_files

C = ScanConfig("x")


def zipped(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return b.getvalue()


def docx(body):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    return zipped(word__document_dot_xml=f"<w:document {ns}><w:body>{body}</w:body></w:document>")


def xlsx(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + k)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(row) if v) + "</row>" for i, row in enumerate(rows, 1))
    return zipped(xl__workbook_dot_xml=f'<workbook {ns}><sheets><sheet name="Лист1" sheetId="1" r:id="rId1"/></sheets></workbook>', xl__worksheets__sheet1_dot_xml=f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")


def text(name, raw, c=C):
    return X.extract(name, raw, c)


def test_texts():
    t, m, _, _ = text("a.json", json.dumps({"user": {"name": "Иван Иванов", "ok": True, "n": None, "l": [1, 2.5]}}).encode())
    assert m == "json" and t == "root.user.name: Иван Иванов\nroot.user.ok: True\nroot.user.n: None\nroot.user.l[0]: 1\nroot.user.l[1]: 2.5"
    assert text("a.json", b"{bad")[1] == "json_text_fallback"
    t, m, _, _ = text("a.html", "<html><script>var x</script><body><h1>Контакты</h1><p>test@example.test &amp; co</p></body></html>".encode())
    assert m == "html_regex" and "Контакты" in t and "test@example.test & co" in t and "var x" not in t
    t, m, _, _ = text("a.docx", docx("<w:p><w:r><w:t>Паспорт 52 17 118903</w:t></w:r></w:p>"))
    assert m == "docx_zip_xml" and "Паспорт 52 17 118903" in t
    assert text("a.docx", "<html><body><p>Иван Иванов</p></body></html>".encode())[:2] == ("<html><body><p>Иван Иванов</p></body></html>", "docx_html_fallback")
    assert text("a.docx", b"broken bytes here")[1] == "docx_binary_fallback"
    assert text("a.rtf", rb"{\rtf1\ansi Hello \'cf there}")[0] == "Hello there"
    t, m, _, _ = text("a.xlsx", xlsx([["ФИО", "", "Город"], ["Иванов", "1", ""]]))
    assert m == "xlsx_openpyxl" and t == "[sheet] Лист1\nФИО | | Город\nИванов | 1"
    packed = zlib.compress(b"BT (Passport number one two three four five six seven eight nine ten) Tj ET")
    t, m, _, _ = text("a.pdf", b"%PDF-1.4\nstream\n" + packed + b"\nendstream")
    assert m == "pdf_stream_fallback" and "Passport number one" in t
    assert text("a.pdf", b"%PDF-1.4")[1] == "pdf_no_text"
    assert text("a.pdf", b"x" * 101, ScanConfig("x", max_binary_read_bytes=10))[1] == "pdf_too_large"
    assert text("a.png", b"")[1] == "image_skipped_no_ocr" and text("a.png", b"", ScanConfig("x", enable_ocr=True))[1] == "image_ocr_unavailable"
    assert text("a.doc", b"\x00\x01hello\x01w\x00o\x00r\x00l\x00d\x00")[0] == "hello\nworld"
    assert text("a.unknown", "плоский".encode())[:2] == ("плоский", "plain_text")
    assert text("a.txt", b"a" * 20, ScanConfig("x", max_text_chars=5))[::3] == ("aaaaa", True)
    assert text("a.txt", b"")[0] == ""


def test_csv():
    assert "Филипп Елизарович Воробьев" in text("a.csv", "id,customer_name\n1,Филипп Елизарович Воробьев\n".encode())[0]
    broken = "Филипп Елизарович".encode().decode("latin-1")
    assert "Филипп Елизарович" in text("a.csv", f"id,customer_name\n1,{broken}\n".encode())[0]
    assert text("a.csv", "phone,x\n1,,\n,5\n".encode())[0] == "phone | x\nтелефон: 1\n5"
    assert text("a.csv", b"a,b\n1,2\n3,4\n", ScanConfig("x", max_structured_rows=2))[2:] == ([X.CSV_LIMITED], True)
    edge = ("x" * 4095 + "я," + "y").encode()  # a sign of two bytes across a usual buffer's end
    assert "я" in text("a.csv", edge)[0]


def test_decode():
    assert charset("текст".encode("utf-16le") + b"") in ("utf-16le", "cp1251", "latin-1", "utf-8")
    assert decode(b"\xef\xbb\xbfa") == "a" and decode("я".encode("cp1251")) == "я" and decode(b"\xff\xfea\x00") .endswith("a") and decode(b"") == "" and decode(None) == ""
    assert decode("abcd".encode("utf-16le")) == "abcd"
    assert repair_mojibake("ÐÑ") == "ÐÑ" and repair_mojibake("привет".encode().decode("latin-1")) == "привет"


def test_chunks(spark, tmp_path):
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>ФИО</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>СНИЛС</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>Иванов Иван</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    got = list(H.docx("f", docx(f"<w:p><w:r><w:t>Абзац</w:t></w:r></w:p>{table}")))
    assert [(t, n) for t, _, n, _ in got] == [("Абзац", None), ("Иванов Иван", "ФИО"), ("1", "СНИЛС")]
    got = list(H.xlsx("f", xlsx([["ФИО", "Город"], ["Иванов", "Каменка"]])))
    assert [(t, s, n) for t, s, n, _ in got] == [("Иванов", "f#sheet=Лист1!R2C1", "ФИО"), ("Каменка", "f#sheet=Лист1!R2C2", "Город")]
    got = list(H.html("f", "<title>Т</title><script>x</script><p>один<p>два".encode()))
    assert [(t, n) for t, _, n, _ in got] == [("Т", "title"), ("один\nдва", None)]
    assert [t for t, *_ in H.pdf("f.pdf", b"<!doctype html><p>web</p>")] == ["web"]
    files = spark.createDataFrame([("/x/a.docx", 1, None, docx("<w:p><w:r><w:t>Абзац</w:t></w:r></w:p>")), ("/x/b.docx", 1, None, b"bad")], "path string, size long, modified timestamp, content binary")
    rows = H.chunk_files(files).collect()
    assert [(r["path"], r["chunk_seq"], r["text"], r["meta"]["paragraph"]) for r in rows] == [("/x/a.docx", 0, "Абзац", 1)]


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/one.TXT").write_text("тел. +7 910 245-63-18", encoding="utf-8")
    (tmp_path / "in/sub/_two.csv").write_text("id,name\n1,x\n", encoding="utf-8")
    (tmp_path / "in/.hidden.txt").write_text("a.petrov@firma.ru", encoding="utf-8")
    (tmp_path / "in/skip.bin").write_text("a@b.ru")
    return tmp_path


def test_scan_and_reports(spark, tree):
    root = str(tree / "in")
    assert sorted(os.path.basename(p) for p, _, _ in list_files(root, ["txt", "csv"])) == [".hidden.txt", "_two.csv", "one.TXT"]
    assert [os.path.basename(p) for p, _, _ in list_files(str(tree / "in/one.TXT"), ["txt"])] == ["one.TXT"] and list_files(str(tree / "in/one.TXT"), ["csv"]) == []
    results, extracted = S.scan_root(spark, ScanConfig(root))
    assert sorted((r["name"], r["uz"], r["findings_count"]) for r in results.collect()) == [(".hidden.txt", "УЗ-4", 1), ("one.TXT", "УЗ-4", 1)]
    assert S.results(extracted, include_empty=True).count() == 3
    assert S.slow_files(extracted, 0.0).count() == 3 and S.slow_files(extracted, 1e9).count() == 0
    for fmt in ("csv", "json", "md"):
        R.write_results(results, str(tree / f"r.{fmt}"), fmt)
    assert list(csv.reader(open(tree / "r.csv", encoding="utf-8")))[0] == ["size", "time", "name"]
    data = json.load(open(tree / "r.json", encoding="utf-8"))
    assert len(data) == 2 and list(data[0]) == list(R.RESULT_FIELDS)
    assert "Распределение по УЗ: {'УЗ-4': 2}" in (tree / "r.md").read_text(encoding="utf-8")
    R.write_results(results.where("false"), str(tree / "e.json"), "json")
    assert json.load(open(tree / "e.json")) == []
    with pytest.raises(ValueError):
        R.write_results(results, str(tree / "r.x"), "xml")


def test_failed_file(spark, tree):
    files = spark.createDataFrame([(str(tree / "gone.txt"), 1, None, None)], "path string, size long, modified timestamp, content binary")
    r = S.results(X.extract_files(files, C), include_empty=True).first()
    assert r["extractor"] == "failed" and r["warnings"] == [X.FAILED] and r["findings_count"] == 0


def test_finding_report(spark, tmp_path):
    from sievemark.operators import finding as B

    ch = spark.createDataFrame([("d/a.txt", 0, "a@b.ru, карта 4111 1111 1111 1111", "s", None), ("d/b.txt", 0, "a@b.ru", "s", None)], "path string, chunk_seq int, text string, source string, field_name string")
    st = spark.createDataFrame([("d/a.txt", "txt", "ok", False, ["n"], None), ("d/b.txt", "txt", "ok", False, [], None), ("d/c.txt", "txt", "error", None, None, "bad")], "path string, extension string, status string, via_ocr boolean, notes array<string>, error string")
    f = B.findings(ch)
    rows = R.report_rows(st, B.classify(f), B.finding_lists(f))
    assert [(r["filename"], r["uz_level"]) for r in R.ordered(rows).collect()] == [("a.txt", 2), ("b.txt", 4), ("c.txt", None)]
    s = R.summary(rows).first()
    assert (s["total_files"], s["files_with_pii"], s["status_ok"], s["status_error"], s["uz_2"], s["uz_none"]) == (3, 2, 2, 1, 1, 1)
    paths = R.write_all(rows, str(tmp_path), "root", now="2026-01-01T00:00:00")
    data = json.load(open(paths["json"], encoding="utf-8"))
    assert data["summary"]["group_totals"] == {"regular": 2, "payment": 1} and len(data["files"]) == 3
    by = {x["filename"]: x for x in data["files"]}
    assert by["a.txt"]["findings"]["EMAIL"][0]["masked"] == "a***@b.ru" and "findings" not in by["c.txt"] and by["c.txt"]["notes"] == ["bad"]
    table = list(csv.DictReader(open(paths["csv"], encoding="utf-8-sig"), delimiter=";"))
    assert table[0].keys() >= {"path", "uz_level", "groups"} and {r["filename"]: r["groups"] for r in table}["a.txt"] == "payment:1;regular:1"
    assert "| `a.txt` | txt | 2 | 2 | BANK_CARD(1), EMAIL(1) | ok |" in open(paths["md"], encoding="utf-8").read()
    assert open(paths["txt"], encoding="utf-8").read().splitlines()[6].startswith("UZ-2   payment,regular")


def test_cli():
    p = cli.build_parser()
    a = p.parse_args([])
    assert a.output == "result.csv" and a.output_format == "csv" and a.root
    assert p.parse_args(["--debug-progress"]).debug_progress is True
    c = cli.config_of(p.parse_args(["/tmp", "-o", "/tmp/x/r.json", "--include-ext", ".TXT", "--slow-threshold", "-1"]))
    assert c.include_extensions == {"txt"} and c.slow_log_path == "/tmp/x/slow_files.csv" and c.slow_threshold_seconds == 0
    with pytest.raises(SystemExit):
        cli.main(["/no/such/place"])


def test_streams(spark, tree):
    from sievemark.streaming import stream as T

    out = []
    files = T.arriving_files(spark, str(tree / "in"))
    q = T.scan_stream(files, ScanConfig("x")).select("name", "uz").writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tree / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert ("one.TXT", "УЗ-4") in {(r["name"], r["uz"]) for r in out}
    schema = "path string, chunk_seq int, text string, source string, field_name string, at timestamp"
    spark.createDataFrame([("a", 0, "a@b.ru", "s", None, None), ("a", 1, "a@b.ru 112-233-445 95", "s", None, None)], schema).write.parquet(str(tree / "chunks"))
    src = spark.readStream.schema(schema).parquet(str(tree / "chunks"))
    got = []
    q = T.running_levels(T.finding_stream(src)).writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tree / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["path"], r["regular"], r["state_ids"], r["uz_level"]) for r in got] == [("a", 1, 1, 3)]
    q = T.finding_stream(src, "at").writeStream.format("noop").option("checkpointLocation", str(tree / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination()
