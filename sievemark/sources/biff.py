"""Legacy workbooks (BIFF8 in a compound file) without a library: sheets, rows, cell values."""

from __future__ import annotations

import struct
from collections.abc import Iterator

_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA  # sector numbers from here on are marks, not sectors
Cell = str | float | bool | None


class NotAWorkbook(ValueError):
    """The bytes hold no workbook of this kind."""


def _chain(start: int, table: list[int]) -> Iterator[int]:
    seen = 0
    while start < _END and start < len(table) and seen <= len(table):
        yield start
        start, seen = table[start], seen + 1


def workbook_stream(raw: bytes) -> bytes:
    """The workbook's own bytes: a stream of the compound file, or the file itself if it begins with a record."""
    if raw[:2] == b"\x09\x08":
        return raw
    if raw[:8] != _MAGIC or len(raw) < 512:
        raise NotAWorkbook("no compound file")
    shift, mini_shift = struct.unpack_from("<HH", raw, 30)
    size, mini_size = 1 << shift, 1 << mini_shift
    first_dir, cutoff, first_mini = struct.unpack_from("<I", raw, 48)[0], struct.unpack_from("<I", raw, 56)[0], struct.unpack_from("<I", raw, 60)[0]
    sector = lambda n: raw[512 + n * size : 512 + (n + 1) * size]
    numbers = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))
    fat_sectors = [x for x in numbers(raw[76:512]) if x < _END]
    more, left = struct.unpack_from("<II", raw, 68)
    while more < _END and left:
        own = numbers(sector(more))
        fat_sectors += [x for x in own[:-1] if x < _END]
        more, left = own[-1], left - 1
    fat = [x for n in fat_sectors for x in numbers(sector(n))]
    read = lambda start: b"".join(sector(n) for n in _chain(start, fat))
    folder = read(first_dir)
    entries = {}
    for at in range(0, len(folder) - 127, 128):
        length = struct.unpack_from("<H", folder, at + 64)[0]
        name = folder[at : at + max(0, length - 2)].decode("utf-16le", "ignore")
        entries[name] = struct.unpack_from("<I", folder, at + 116)[0], struct.unpack_from("<I", folder, at + 120)[0]
    for name in ("Workbook", "Book"):
        if name not in entries:
            continue
        start, total = entries[name]
        if total >= cutoff:
            return read(start)[:total]
        container = read(entries.get("Root Entry", (_END, 0))[0])
        mini = numbers(read(first_mini))
        return b"".join(container[n * mini_size : (n + 1) * mini_size] for n in _chain(start, mini))[:total]
    raise NotAWorkbook("no workbook stream")


def _records(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """``(place, kind, body)`` of every record."""
    at = 0
    while at + 4 <= len(raw):
        kind, size = struct.unpack_from("<HH", raw, at)
        yield at, kind, raw[at + 4 : at + 4 + size]
        at += 4 + size


def _text(body: bytes, at: int, wide_count: bool = True) -> str:
    """A string with its length, its flag and its characters."""
    n = struct.unpack_from("<H", body, at)[0] if wide_count else body[at]
    at += 2 if wide_count else 1
    if body[at] & 1:
        return body[at + 1 : at + 1 + 2 * n].decode("utf-16le", "replace")
    return body[at + 1 : at + 1 + n].decode("latin-1")


class _Parts:
    """Bytes of a record and of those that carry it on; characters cut by a border begin anew with a flag."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.parts):
            own = self.parts[self.k][self.at : self.at + n]
            out += own
            n -= len(own)
            self.at += len(own)
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
        return out

    def characters(self, n: int, wide: int) -> str:
        out = ""
        while n and self.k < len(self.parts):
            here = self.parts[self.k]
            fit = min(n, (len(here) - self.at) // (2 if wide else 1))
            own = here[self.at : self.at + fit * (2 if wide else 1)]
            out += own.decode("utf-16le" if wide else "latin-1", "replace")
            self.at += len(own)
            n -= fit
            if self.at >= len(here) or (n and not fit):
                self.k, self.at = self.k + 1, 0
                if n and self.k < len(self.parts):
                    wide, self.at = self.parts[self.k][0] & 1, 1
        return out


def _shared(parts: list[bytes]) -> list[str]:
    p = _Parts(parts)
    count = struct.unpack("<II", p.take(8))[1]
    out = []
    for _ in range(count):
        head = p.take(3)
        if len(head) < 3:
            break
        n, flags = struct.unpack("<HB", head)
        runs = struct.unpack("<H", p.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", p.take(4))[0] if flags & 4 else 0
        out.append(p.characters(n, flags & 1))
        p.take(4 * runs + extra)
    return out


def _rk(value: int) -> float:
    """A number in its short form."""
    number = float(struct.unpack("<i", struct.pack("<I", value))[0] >> 2) if value & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", value & 0xFFFFFFFC))[0]
    return number / 100 if value & 1 else number


def sheets(raw: bytes) -> Iterator[tuple[str, list[list[Cell]]]]:
    """``(title, rows)``; a row reaches to its last filled cell, empty rows between are kept."""
    stream = workbook_stream(raw)
    titles: list[tuple[int, str]] = []
    shared: list[str] = []
    open_parts: list[bytes] | None = None
    for _, kind, body in _records(stream):
        if kind == 0x3C and open_parts is not None:
            open_parts.append(body)
            continue
        if open_parts is not None:
            shared, open_parts = _shared(open_parts), None
        if kind == 0x85:
            titles.append((struct.unpack_from("<I", body)[0], _text(body, 6, False)))
        elif kind == 0xFC:
            open_parts = [body]
        elif kind == 0x0A:
            break
    for place, title in titles:
        yield title, _rows(stream[place:], shared)


def _rows(part: bytes, shared: list[str]) -> list[list[Cell]]:
    cells: dict[tuple[int, int], Cell] = {}
    depth, waiting = 0, None
    for _, kind, body in _records(part):
        if kind == 0x809:
            depth += 1
        elif kind == 0x0A:
            depth -= 1
            if depth <= 0:
                break
        if depth > 1:
            continue
        if kind in (0xFD, 0x203, 0x27E, 0x204, 0x205, 0x06):
            row, col = struct.unpack_from("<HH", body)
        if kind == 0xFD:
            n = struct.unpack_from("<I", body, 6)[0]
            cells[row, col] = shared[n] if n < len(shared) else ""
        elif kind == 0x203:
            cells[row, col] = struct.unpack_from("<d", body, 6)[0]
        elif kind == 0x27E:
            cells[row, col] = _rk(struct.unpack_from("<I", body, 6)[0])
        elif kind == 0xBD:
            row, first = struct.unpack_from("<HH", body)
            for k in range((len(body) - 6) // 6):
                cells[row, first + k] = _rk(struct.unpack_from("<I", body, 6 + 6 * k)[0])
        elif kind == 0x204:
            cells[row, col] = _text(body, 6)
        elif kind == 0x205 and not body[7]:
            cells[row, col] = bool(body[6])
        elif kind == 0x06:
            result = body[6:14]
            if result[6:] != b"\xff\xff":
                cells[row, col] = struct.unpack("<d", result)[0]
            elif result[0] == 0:
                waiting = row, col
            elif result[0] == 1:
                cells[row, col] = bool(result[2])
        elif kind == 0x207 and waiting is not None:
            cells[waiting], waiting = _text(body, 0), None
    out: list[list[Cell]] = []
    for (row, col), value in sorted(cells.items()):
        out.extend([] for _ in range(row + 1 - len(out)))
        out[row].extend([None] * (col - len(out[row])))
        out[row].append(value)
    return out


def shown(value: Cell) -> str:
    """A cell's text."""
    return "" if value is None else str(value)
