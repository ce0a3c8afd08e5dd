"""Chunks of the finding profile: pages, paragraphs and cells with their places and field names."""

from __future__ import annotations

import io
import os
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import ScanConfig
from . import biff
from . import extract as X
from . import pdf as P
from .decode import decode_chunk

META = "struct<page:int,paragraph:int,table:int,row:int,col:int,sheet:string,row_id:string,via_ocr:boolean,ocr_lang:string,width:int,height:int,tag:string,converter:string>"
SCHEMA = f"path string, chunk_seq int, text string, source string, field_name string, meta {META}"
STATE = "struct<extension:string,status:string,via_ocr:boolean,notes:array<string>,error:string>"
Chunk = tuple[str, str, str | None, dict]

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _words(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def docx(path: str, raw: bytes) -> Iterator[Chunk]:
    """A chunk for each paragraph outside tables, and for each cell; a table's first row names its columns if all its cells are short and filled."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    paragraph = table = 0
    for node in list(body) if body is not None else []:
        if node.tag == f"{_W}p":
            paragraph += 1
            if text := _words(node).strip():
                yield text, f"{path}#para={paragraph}", None, {"paragraph": paragraph}
        elif node.tag == f"{_W}tbl":
            table += 1
            rows = [[_words(c).strip() for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            names = rows[0] if rows and rows[0] and all(x and len(x) <= 60 for x in rows[0]) else None
            for r, row in enumerate(rows, 1):
                if names and r == 1:
                    continue
                for k, text in enumerate(row, 1):
                    if text:
                        yield text, f"{path}#table={table}!R{r}C{k}", names[k - 1] if names and k <= len(names) else None, {"table": table, "row": r, "col": k, "row_id": f"T{table}R{r}"}


def xlsx(path: str, raw: bytes) -> Iterator[Chunk]:
    """A chunk for each filled cell; a first row of filled strings names the columns."""
    for title, rows in X.sheets(raw):
        names = None
        for r, row in enumerate(rows, 1):
            if r == 1 and row and all(x.strip() and not re.fullmatch(r"-?\d+(?:\.\d+)?(?:E[+-]?\d+)?", x) for x in row):
                names = [x.strip() for x in row]
                continue
            for k, cell in enumerate(row, 1):
                if text := cell.strip():
                    yield text, f"{path}#sheet={title}!R{r}C{k}", names[k - 1] if names and k <= len(names) else None, {"sheet": title, "row": r, "col": k, "row_id": f"{title}!R{r}"}


def rtf(path: str, raw: bytes) -> Iterator[Chunk]:
    text = X.rtf_text(raw, ScanConfig(path))[0]
    if text.strip():
        yield text.strip(), f"{path}#body", None, {}


class _Page(HTMLParser):
    """Title and visible texts of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.body, self.open = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "title"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            del self.open[self.open.index(tag) :]

    def handle_data(self, data):
        if not data.strip():
            return
        if not self.open:
            self.body.append(data.strip())
        elif self.open[-1] == "title":
            self.title.append(data.strip())


def html(path: str, raw: bytes) -> Iterator[Chunk]:
    """The title as a named chunk, the visible text as another."""
    page = _Page()
    page.feed(decode_chunk(raw))
    page.close()
    if page.title:
        yield " ".join(page.title), f"{path}#title", "title", {"tag": "title"}
    if page.body:
        yield "\n".join(page.body), f"{path}#body", None, {"tag": "body"}


def pdf(path: str, raw: bytes) -> Iterator[Chunk]:
    """Many a page is saved under this extension: told by its first bytes, and read as one."""
    if raw[:5] != b"%PDF-":
        head = raw[:1024].lstrip().lower()
        if head.startswith(b"<!doc") or b"<html" in head:
            yield from html(path, raw)
        return
    found = False
    for n, page in enumerate(P.pages(raw), 1):
        if page.text.strip():
            found = True
            yield page.text, f"{path}#page={n}", None, {"page": n, "via_ocr": False}
        elif page.scanned and X.PAGE_OCR is not None and (text := X.PAGE_OCR(raw, n)).strip():
            found = True
            yield text, f"{path}#page={n}", None, {"page": n, "via_ocr": True}
    if not found and (text := X.pdf_text(raw, ScanConfig(path))[0]).strip():  # no page tree: what the streams hold
        yield text, f"{path}#page=1", None, {"page": 1, "via_ocr": False}


def xls(path: str, raw: bytes) -> Iterator[Chunk]:
    """A chunk for each filled cell of a legacy workbook; a first row of filled strings names the columns."""
    for title, rows in biff.sheets(raw):
        names = [x.strip() for x in rows[0]] if rows and rows[0] and all(isinstance(x, str) and x.strip() for x in rows[0]) else None
        for r, row in enumerate(rows, 1):
            if names and r == 1:
                continue
            for k, cell in enumerate(row, 1):
                if text := biff.shown(cell).strip():
                    yield text, f"{path}#sheet={title}!R{r}C{k}", names[k - 1] if names and k <= len(names) else None, {"sheet": title, "row": r, "col": k, "row_id": f"{path}#sheet={title}#row={r}"}


def doc(path: str, raw: bytes) -> Iterator[Chunk]:
    """The text of a legacy document, by an office program where one is installed."""
    program = converter()
    if program is None:
        raise Skipped("no converter for this format is installed")
    with tempfile.TemporaryDirectory() as folder:  # scratch of one task, read in the same task
        source = os.path.join(folder, "in.doc")
        with open(source, "wb") as f:
            f.write(raw)
        subprocess.run([program, "--headless", "--convert-to", "txt:Text", "--outdir", folder, source], check=True, timeout=CONVERSION_SECONDS, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
        with open(os.path.join(folder, "in.txt"), "rb") as f:
            text = decode_chunk(f.read())
    if text.strip():
        yield text, f"{path}#body", None, {"converter": "libreoffice"}


def converter() -> str | None:
    return shutil.which("soffice") or shutil.which("soffice.exe")


def text_lines(path: str, raw: bytes) -> Iterator[Chunk]:
    text = decode_chunk(raw).strip()
    if text:
        yield text, f"{path}#body", None, {}


def image(path: str, raw: bytes) -> Iterator[Chunk]:
    """A chunk for each frame that a recogniser reads.

    ``FRAMES`` gives ``(text, language, width, height)`` of every frame; with
    only ``extract.OCR`` the picture is one frame.
    """
    if FRAMES is None and X.OCR is None:
        raise Skipped("no recogniser of pictures is installed")
    frames = FRAMES(raw) if FRAMES is not None else [(X.OCR(raw), None, None, None)]
    for n, (text, language, width, height) in enumerate(frames, 1):
        if text and text.strip():
            yield text, f"{path}#page={n}", None, {"page": n, "via_ocr": True, "ocr_lang": language, "width": width, "height": height}


class Skipped(Exception):
    """The file is of a kind that cannot be read here."""


#: Reads the frames of a picture: an iterable of ``(text, language, width, height)``.
FRAMES: Callable[[bytes], Iterable[tuple[str, str | None, int | None, int | None]]] | None = None
# fixed value: so long a conversion may take
CONVERSION_SECONDS = 120
EXTRACTORS = {"docx": docx, "doc": doc, "xlsx": xlsx, "xls": xls, "rtf": rtf, "html": html, "htm": html, "pdf": pdf, "txt": text_lines, **dict.fromkeys(X.vocab.IMAGES, image)}


def read_chunks(files: DataFrame) -> DataFrame:
    """Chunks of ``files(path, size, modified, content)``, and for each file a last row with ``chunk_seq`` -1 and its ``state``.

    ``state`` is ``struct<extension, status, via_ocr, notes, error>``: ok,
    skipped (no reader for the format) or error; an unreadable file ends
    nothing.  Persist the result where both chunks and states are wanted.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(f"{SCHEMA}, state {STATE}"))

    def rows(path: str, raw: bytes | None):
        kind, status, notes, error, seen = X.extension(path), "ok", [], None, False
        try:
            if raw is None:
                with open(path, "rb") as f:
                    raw = f.read()
            make = EXTRACTORS.get(kind)
            if make is None:
                raise Skipped("no reader for this format")
            for n, (text, source, name, meta) in enumerate(make(path, raw)):
                seen = seen or bool(meta.get("via_ocr"))
                yield path, n, text, source, name, meta, None
        except Skipped as e:
            status, notes = "skipped", [str(e)]
        except Exception as e:  # noqa: BLE001  one unreadable file must not end a scan
            status, error = "error", str(e)[:500]
        yield path, -1, None, None, None, {}, {"extension": kind, "status": status, "via_ocr": seen, "notes": notes, "error": error}

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                for row in rows(batch.column(0)[k].as_py(), batch.column(1)[k].as_py()):
                    out.append(row)
                    if len(out) >= 5000:
                        yield _batch(out, schema)
                        out = []
            if out:
                yield _batch(out, schema)

    return files.select("path", "content").mapInArrow(run, f"{SCHEMA}, state {STATE}")


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of ``files(path, size, modified, content)``; a file that cannot be read gives none."""
    return chunks_of(read_chunks(files))


def chunks_of(read: DataFrame) -> DataFrame:
    """The chunks among the rows of ``read_chunks``."""
    return read.where("chunk_seq >= 0").drop("state")


def states_of(read: DataFrame) -> DataFrame:
    """``(path, extension, status, via_ocr, notes, error)`` of every file among the rows of ``read_chunks``."""
    return read.where("chunk_seq < 0").select("path", "state.*")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    keys = [f.name for f in schema.field("meta").type]
    cols = list(zip(*rows))
    cols[5] = [{k: m.get(k) for k in keys} for m in cols[5]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
