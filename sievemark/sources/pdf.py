"""Pages of PDF files without a library: their texts, and whether they are scanned pictures."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_STRING = r"\((?:\\.|[^()\\])*\)"
_SHOWN = re.compile(rf"({_STRING})\s*(?:Tj|'|\")|\[((?:{_STRING}|[^\]])*)\]\s*TJ", re.S)
_ESCAPE = re.compile(r"\\(\d{1,3}|.)", re.S)
# fixed values: escaped characters of a string
_ESCAPED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


@dataclass
class Page:
    """A page's text, and what its resources hold."""

    text: str
    has_image: bool
    has_fonts: bool

    @property
    def scanned(self) -> bool:
        return self.has_image and not self.has_fonts


def literal(string: str) -> str:
    """The characters of a string in brackets."""

    def one(m: re.Match) -> str:
        c = m.group(1)
        return chr(int(c, 8) & 0xFF) if c.isdigit() and all(x in "01234567" for x in c) else _ESCAPED.get(c, "" if c == "\n" else c)

    return _ESCAPE.sub(one, string[1:-1])


def _unpacked(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"/FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(m.group(1))
        except zlib.error:
            return b""
    return m.group(1)


def _shown(content: bytes) -> str:
    parts = []
    for m in _SHOWN.finditer(content.decode("latin-1")):
        parts.append(literal(m.group(1)) if m.group(1) else "".join(literal(s) for s in re.findall(_STRING, m.group(2))))
    return "\n".join(p for p in parts if p.strip())


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in _REF.findall(m.group(1))] if m else []


def pages(raw: bytes) -> Iterator[Page]:
    """Pages in the order of the page tree; a broken page has no text.  Objects of packed object streams count too."""
    objects: dict[int, bytes] = {}
    for m in _OBJECT.finditer(raw):
        objects[int(m.group(1))] = m.group(2)
    for body in list(objects.values()):
        if b"/ObjStm" in body and (head := re.search(rb"/N\s+(\d+)", body)) and (first := re.search(rb"/First\s+(\d+)", body)):
            inside = _unpacked(body)
            places = [int(x) for x in inside[: int(first.group(1))].split()[: 2 * int(head.group(1))]]
            starts = [*places[1::2], len(inside) - int(first.group(1))]
            for number, a, b in zip(places[::2], starts, starts[1:]):
                objects.setdefault(number, inside[int(first.group(1)) + a : int(first.group(1)) + b])
    kind = lambda body: (m.group(1) if (m := re.search(rb"/Type\s*/(\w+)", body)) else b"")
    root = next((n for n, b in objects.items() if kind(b) == b"Pages" and b"/Parent" not in b), None)
    order: list[int] = []
    todo, seen = ([root] if root is not None else []), set()
    while todo:
        n = todo.pop(0)
        if n in seen or n not in objects:
            continue
        seen.add(n)
        if kind(objects[n]) == b"Page":
            order.append(n)
        else:
            todo = _refs(objects[n], b"Kids") + todo
    for n in order or [n for n, b in objects.items() if kind(b) == b"Page"]:
        body = objects[n]
        held = body + b"".join(objects.get(k, b"") for k in _refs(body, b"Resources"))
        held += b"".join(objects.get(k, b"") for k in _refs(held, b"XObject") + _refs(held, b"Font"))
        pictures = [objects.get(int(x), b"") for m in re.findall(rb"/XObject\s*<<(.*?)>>", held, re.S) for x in _REF.findall(m)]
        text = "\n".join(t for k in _refs(body, b"Contents") if (t := _shown(_unpacked(objects.get(k, b"")))))
        yield Page(text, any(re.search(rb"/Subtype\s*/Image", p.split(b"stream")[0]) for p in pictures), b"/Font" in held)


def looks_scanned(first: list[Page]) -> bool:
    """Do the first three pages hold pictures and no fonts?"""
    return bool(first) and all(p.scanned for p in first[:3])


def sample_pages(count: int) -> list[int]:
    """Numbers of the pages that are read first to see whether a scanned file has text at all: a fifth of them, two to six, the last included."""
    size = min(count, max(2, min(6, count // 5)))
    if size <= 0 or size == count:
        return list(range(1, count + 1))
    step = count // size
    return sorted({*range(1, 1 + step * (size - 1), step), count})


def recognised(raw: bytes, count: int, read: Callable[[bytes, int], str], limit: int, least: int = 30) -> tuple[str, list[str]]:
    """Text of a scanned file by ``read(raw, page number)``: the sample first, the other pages up to ``limit`` only if it has text."""
    done = {n: read(raw, n) or "" for n in sample_pages(count)}
    if not any(sum(c.isalnum() for c in t) >= least for t in done.values()):
        return "", [NO_TEXT.format(count=count, sample=len(done))] if done else []
    texts = [done[n] if n in done else read(raw, n) or "" for n in range(1, min(count, limit) + 1)]
    return "\n".join(t for t in texts if t.strip()), [ONLY_FIRST.format(count=count, limit=limit)] if count > limit else []


# fixed values: notes that results carry
NO_TEXT = "PDF-скан из {count} страниц: на сэмпле {sample} страниц текст не найден, документ пропущен."
ONLY_FIRST = "PDF-скан из {count} страниц, OCR применен к первым {limit}."
