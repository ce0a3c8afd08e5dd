"""Bytes to text."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be"))


def _two_byte(raw: bytes) -> bool:
    """More than three tenths of zero bytes on even or odd places."""
    if len(raw) < 4:
        return False
    return any(half.count(0) > 0.3 * max(1, len(half)) for half in (raw[::2], raw[1::2]))


def charset(raw: bytes) -> str:
    """The character set of a whole buffer: its mark, then two-byte text, then the first set that decodes it."""
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return name
    if _two_byte(raw):
        return "utf-16le"
    for name in ("utf-8", "cp1251"):
        try:
            raw.decode(name)
            return name
        except UnicodeDecodeError:
            pass
    return "latin-1"


def decode(raw: bytes | None) -> str:
    """Text of a buffer; bytes that fit nowhere become replacement signs, never an error."""
    if not raw:
        return ""
    return raw.decode(charset(raw), errors="replace")


def decode_chunk(raw: bytes | None) -> str:
    """Text by the order of sets of the finding profile."""
    for name in ("utf-8", "cp1251", "cp1252", "koi8-r"):
        try:
            return (raw or b"").decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


def repair_mojibake(text: str) -> str:
    """A text with three or more typical signs read once more, kept if that gives more Cyrillic letters."""
    if not text or text.count("Ð") + text.count("Ñ") < 3:
        return text
    again = text.encode("latin-1", "ignore").decode("utf-8", "ignore")

    def cyrillic(s: str) -> int:
        return sum("Ѐ" <= c <= "ӿ" for c in s)

    return again if cyrillic(again) > cyrillic(text) else text


@F.pandas_udf(StringType())
def decode_bytes(raw: pd.Series) -> pd.Series:
    """Column form of ``decode``; null stays null."""
    return raw.map(lambda b: None if b is None else decode(bytes(b)))


@F.pandas_udf(StringType())
def repair_texts(text: pd.Series) -> pd.Series:
    """Column form of ``repair_mojibake``; null stays null."""
    return text.map(lambda t: None if t is None else repair_mojibake(t))
