"""Whole-file texts of the document profile, by format, with the standard library only.

``OCR`` is the place for a recogniser of pictures: a function of bytes to text.
Without one, pictures and scanned pages give an empty text and say so.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable
from time import perf_counter
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import vocab
from ..config import ScanConfig
from . import biff, pdf
from .decode import decode, repair_mojibake

Extracted = tuple[str, str, list[str], bool]
OCR: Callable[[bytes], str] | None = None
#: Reads one page of a scanned PDF, by its number from 1.
PAGE_OCR: Callable[[bytes, int], str] | None = None
SCHEMA = "path string, name string, size long, modified timestamp, file_format string, text string, method string, warnings array<string>, truncated boolean, status string, error string, elapsed double"

# fixed values: notes that results carry
CSV_LIMITED = "CSV ограничен по числу строк."
JSON_LIMITED = "JSON ограничен по числу элементов."
DOCX_BINARY = "DOCX не удалось прочитать как zip/xml, использован binary fallback."
PDF_TOO_LARGE = "PDF слишком большой для бинарного fallback, пропущен."
PDF_LIMITED = "PDF fallback ограничен по числу прочитанных байт."
PDF_EMPTY = "PDF не содержит извлекаемого текста."
BINARY_LIMITED = "Binary fallback ограничен по числу прочитанных байт."
XLS_BINARY = "openpyxl не смог прочитать XLSX, использован fallback."
FAILED = "Файл не удалось обработать."
OCR_OFF = "Изображение пропущено: OCR отключен."
OCR_MISSING = "OCR включен, но easyocr/pillow/системный Tesseract не доступны."


def finalize(text: str, method: str, limit: int, warnings: Iterable[str] = (), truncated: bool = False) -> Extracted:
    """Blanks squeezed, at most one empty line in a row, trimmed, cut at the limit."""
    plain = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
    return plain[:limit], method, list(warnings), truncated or len(plain) > limit


def printable(raw: bytes, least: int = 4) -> str:
    """Printable runs of bytes, then those of two-byte characters."""
    one = [m.decode("latin-1") for m in re.findall(rb"[\x20-\x7e]{%d,}" % least, raw)]
    two = [m.decode("utf-16le") for m in re.findall(rb"(?:[\x20-\x7e]\x00){%d,}" % least, raw)]
    return "\n".join(one + two)


def plain_text(raw: bytes, c: ScanConfig) -> Extracted:
    return finalize(decode(raw), "plain_text", c.max_text_chars)


def binary(raw: bytes, c: ScanConfig, method: str = "binary_strings", warnings: Iterable[str] = ()) -> Extracted:
    own = [BINARY_LIMITED] if len(raw) > c.max_binary_read_bytes else []
    return finalize(printable(raw[: c.max_binary_read_bytes]), method, c.max_text_chars, [*own, *warnings])


def _hint(heading: str) -> str:
    for pattern, word in vocab.HEADING_HINTS:
        if re.search(pattern.replace("(?iuU)", "(?i)"), heading):
            return word
    return ""


def csv_text(raw: bytes, c: ScanConfig) -> Extracted:
    """Rows as lines; cells of telling columns with the column's word before them, empty cells left out then."""
    lines: list[str] = []
    hints: list[str] = []
    cut = False
    for n, row in enumerate(csv.reader(io.StringIO(decode(raw), newline="")), 1):
        cells = [repair_mojibake(x.strip()) for x in row]
        if n == 1:
            hints = [_hint(x) for x in cells]
            lines.append(" | ".join(cells))
            continue
        if any(hints):
            named = zip(cells, hints + [""] * (len(cells) - len(hints)))
            lines.append(" | ".join(f"{h}: {x}" if h else x for x, h in named if x))
        else:
            lines.append(" | ".join(cells))
        if n >= c.max_structured_rows:
            cut = True
            break
    return finalize("\n".join(lines), "csv", c.max_text_chars, [CSV_LIMITED] if cut else [], cut)


def flatten(value, at: str = "root"):
    """Leaves of a JSON value, depth first, as ``path: value``; a stack instead of recursion, so depth has no limit."""
    stack = [(at, value)]
    while stack:
        where, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{where}.{k}", x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            stack.extend((f"{where}[{i}]", v[i]) for i in range(len(v) - 1, -1, -1))
        else:
            yield f"{where}: {v}"


@F.pandas_udf(StringType())
def json_lines(values: pd.Series) -> pd.Series:
    """Column form of ``flatten``: a line for each leaf; null for null and for what is no JSON."""

    def lines(v: str | None) -> str | None:
        try:
            return None if v is None else "\n".join(flatten(json.loads(v)))
        except (ValueError, RecursionError):
            return None

    return values.map(lines)


def json_text(raw: bytes, c: ScanConfig) -> Extracted:
    text = decode(raw)
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return finalize(text, "json_text_fallback", c.max_text_chars)
    lines, cut = [], False
    for line in flatten(value):
        if len(lines) >= c.max_structured_rows:
            cut = True
            break
        lines.append(line)
    return finalize("\n".join(lines), "json", c.max_text_chars, [JSON_LIMITED] if cut else [], cut)


def html_text(raw: bytes, c: ScanConfig) -> Extracted:
    text = re.sub(r"<(script|style).*?>.*?</\1>", " ", decode(raw), flags=re.I | re.S)
    return finalize(html.unescape(re.sub(r"<[^>]+>", " ", text)), "html_regex", c.max_text_chars)


def docx_text(raw: bytes, c: ScanConfig) -> Extracted:
    if b"<html" in raw[:256].lower():
        return finalize(decode(raw), "docx_html_fallback", c.max_text_chars)
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        return finalize(" ".join(n.text for n in root.iter() if n.text), "docx_zip_xml", c.max_text_chars)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, ValueError):
        return binary(raw, c, "docx_binary_fallback", [DOCX_BINARY])


def rtf_text(raw: bytes, c: ScanConfig) -> Extracted:
    text = decode(raw)
    for pattern in (r"\\'[0-9a-fA-F]{2}", r"\\[a-zA-Z]+\d* ?", r"[{}]"):
        text = re.sub(pattern, " ", text)
    return finalize(text, "rtf_regex", c.max_text_chars)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheets(raw: bytes):
    """``(title, rows)`` of a workbook's sheets; a row is a list of strings, as wide as its last cell."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for n, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS), 1):
            target = targets.get(s.get(_REL)) or f"worksheets/sheet{n}.xml"
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part in names:
                yield s.get("name") or f"Sheet{n}", _rows(z.open(part), shared)


def _rows(part, shared: list[str]):
    for _, row in ElementTree.iterparse(part):
        if row.tag != f"{{{_NS['m']}}}row":
            continue
        cells: list[str] = []
        for c in row.findall("m:c", _NS):
            place = re.match(r"[A-Z]+", c.get("r") or "")
            k = len(cells)
            if place:
                k = 0
                for letter in place.group():
                    k = k * 26 + ord(letter) - 64
                k -= 1
            cells += [""] * (k - len(cells))
            v = c.find("m:v", _NS)
            kind = c.get("t")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif v is None or v.text is None:
                value = ""
            elif kind == "s":
                value = shared[int(v.text)] if int(v.text) < len(shared) else ""
            elif kind == "b":
                value = "True" if v.text == "1" else "False"
            else:
                value = v.text
            cells.append(value)
        row.clear()
        yield cells


def xlsx_text(raw: bytes, c: ScanConfig) -> Extracted:
    lines: list[str] = []
    try:
        for title, rows in sheets(raw):
            lines.append(f"[sheet] {title}")
            for n, row in enumerate(rows, 1):
                lines.append(" | ".join(row))
                if n >= c.max_structured_rows:
                    lines.append("[truncated]")
                    break
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, ValueError):
        return binary(raw, c, "spreadsheet_binary_fallback", [XLS_BINARY])
    return finalize("\n".join(lines), "xlsx_openpyxl", c.max_text_chars)


def xls_text(raw: bytes, c: ScanConfig) -> Extracted:
    """Rows of a legacy workbook; printable runs where it cannot be read as one."""
    lines: list[str] = []
    try:
        for title, rows in biff.sheets(raw):
            lines.append(f"[sheet] {title}")
            width = max(map(len, rows), default=0)
            for n, row in enumerate(rows, 1):
                lines.append(" | ".join([*map(biff.shown, row), *[""] * (width - len(row))]))
                if n >= c.max_structured_rows:
                    lines.append("[truncated]")
                    break
    except (ValueError, struct.error, IndexError):
        return binary(raw, c, "spreadsheet_binary_fallback")
    return finalize("\n".join(lines), "xls_xlrd", c.max_text_chars)


def _literal(value: str) -> str:
    core = value.strip().removesuffix("Tj").strip()
    if core[:1] == "(" and core[-1:] == ")":
        core = core[1:-1]
    for a, b in ((r"\(", "("), (r"\)", ")"), (r"\n", "\n")):
        core = core.replace(a, b)
    return re.sub(r"\\\d{3}", " ", core)


def _operators(raw: bytes) -> list[str]:
    text = raw.decode("latin-1")
    string = r"\((?:\\.|[^()])*\)"
    shown = [_literal(m) for m in re.findall(string + r"\s*Tj", text)]
    return shown + [_literal(s) for m in re.findall(r"\[(.*?)\]\s*TJ", text, re.S) for s in re.findall(string, m)]


def pdf_text(raw: bytes, c: ScanConfig) -> Extracted:
    """Text of the page operators, in plain and packed streams, and printable runs."""
    if c.enable_ocr and (OCR is not None or PAGE_OCR is not None):
        own = list(pdf.pages(raw))
        if pdf.looks_scanned(own):
            text, notes = pdf.recognised(raw, len(own), PAGE_OCR, c.max_scanned_pages) if PAGE_OCR is not None else (OCR(raw), [])
            if text.strip():
                return finalize(text, "pdf_ocr", c.max_text_chars, notes)
    if len(raw) > 10 * c.max_binary_read_bytes:
        return "", "pdf_too_large", [PDF_TOO_LARGE], False
    head = raw[: c.max_binary_read_bytes]
    parts = _operators(head)
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", head, re.S):
        try:
            unpacked = zlib.decompress(m.group(1))
        except zlib.error:
            continue
        parts += [*_operators(unpacked), printable(unpacked)]
    parts.append(printable(head))
    text = "\n".join(p for p in parts if p.strip())
    if sum(ch.isalnum() for ch in text) < 50:
        return "", "pdf_no_text", [PDF_EMPTY], False
    return finalize(text, "pdf_stream_fallback", c.max_text_chars, [PDF_LIMITED] if len(raw) > c.max_binary_read_bytes else [])


def image_text(raw: bytes, c: ScanConfig) -> Extracted:
    if not c.enable_ocr:
        return "", "image_skipped_no_ocr", [OCR_OFF], False
    if OCR is None:
        return "", "image_ocr_unavailable", [OCR_MISSING], False
    text = OCR(raw)
    return finalize(text, "image_ocr", c.max_text_chars) if text.strip() else ("", "image_tesseract_empty", [], False)


EXTRACTORS: dict[str, Callable[[bytes, ScanConfig], Extracted]] = {
    "txt": plain_text, "csv": csv_text, "json": json_text, "html": html_text, "htm": html_text, "docx": docx_text, "rtf": rtf_text, "xlsx": xlsx_text,
    "xls": xls_text, "doc": binary, "pdf": pdf_text, **dict.fromkeys(vocab.IMAGES, image_text),
}


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name.lstrip(".") else ""


def extract(path: str, raw: bytes, c: ScanConfig) -> Extracted:
    """Text of one file; an unknown extension is read as plain text."""
    return EXTRACTORS.get(extension(path), plain_text)(raw, c)


def extract_files(files: DataFrame, config: ScanConfig) -> DataFrame:
    """A row with text for every row of ``files(path, size, modified, content)``; an error becomes a failed row, not a failed job."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a file a time: contents may be large
                path, size, modified, raw = (batch.column(i)[k].as_py() for i in range(4))
                began = perf_counter()
                try:
                    if raw is None:
                        with open(path, "rb") as f:
                            raw = f.read()
                    text, method, warnings, cut = extract(path, raw, config)
                    status, error = "done", None
                except Exception as e:  # noqa: BLE001  one unreadable file must not end a scan
                    text, method, warnings, cut, status, error = "", "failed", [FAILED], False, "failed", str(e)[:500]
                row = (path, path.rsplit("/", 1)[-1], size, modified, extension(path) or "unknown", text, method, warnings, cut, status, error, perf_counter() - began)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return files.select("path", "size", "modified", "content").mapInArrow(run, SCHEMA)
