"""Texts packed into files of the formats that are read, so that every reader is checked over whole tables: what goes in must come out."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Signs that mean nothing to any of the formats; all others become blanks before packing.
PLAIN = "[^А-Яа-яЁёA-Za-z0-9 .,;:!?()-]"


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def docx(text: str) -> bytes:
    body = f'<w:p><w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'
    return _zip({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def xlsx(text: str) -> bytes:
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda place, value: f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{value}</t></is></c>'
    rows = f'<row r="1">{cell("A1", "ФИО")}{cell("B1", "Итог")}</row><row r="2">{cell("A2", text)}{cell("B2", "5")}</row>'
    return _zip({"xl/workbook.xml": f'<workbook {main}><sheets><sheet name="Лист1" sheetId="1" r:id="rId1"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>"})


PACKERS: dict[str, Callable[[str], bytes]] = {
    "txt": lambda t: t.encode(),
    "html": lambda t: f"<html><head><title>Титул</title><style>p {{}}</style></head><body><p>{t}</p><script>var x = 1</script></body></html>".encode(),
    "json": lambda t: json.dumps({"a": {"b": t, "n": 1}, "l": [True, None]}, ensure_ascii=False).encode(),
    "csv": lambda t: f'фио,сумма\n"{t}",5\n'.encode(),
    "rtf": lambda t: b"{\\rtf1\\ansi " + t.encode() + b"\\par }",
    "docx": docx,
    "xlsx": xlsx,
}


@F.pandas_udf(BinaryType())
def _packed(kind: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([PACKERS[k](t) for k, t in zip(kind, text)])


def files(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(path, size, modified, content)``: a file of every format for every row."""
    text: Column = F.regexp_replace(F.coalesce(text_col, F.lit("")), PLAIN, " ")
    each = rows.select(F.col(id_col).alias("id"), text.alias("t"), F.explode(F.array(*map(F.lit, PACKERS))).alias("kind"))
    content = each.select(F.concat(F.col("id").cast("string"), F.lit("."), F.col("kind")).alias("path"), _packed("kind", "t").alias("content"))
    return content.select("path", F.length("content").cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"), "content")
