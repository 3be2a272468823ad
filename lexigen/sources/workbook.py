"""Spreadsheet (xlsx) ingest: files are read by Spark's ``binaryFile`` source, so from any store
Spark reaches, and parsed one file per row with the standard library (zip + streaming XML).

Columns are found by their names in each file's first row; cells come back as text.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _col_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _sheet_part(z: zipfile.ZipFile, sheet: int | str) -> str:
    """Where a sheet is in the file: a number is a position, a text a name."""
    sheets = ET.fromstring(z.read("xl/workbook.xml")).find(f"{_NS}sheets").findall(f"{_NS}sheet")
    named = [s for i, s in enumerate(sheets) if (i if isinstance(sheet, int) else s.get("name")) == sheet]
    if not named:
        raise ValueError(f"no sheet {sheet!r}")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels if r.get("Id") == named[0].get(_REL))
    return target.lstrip("/") if target.startswith("/") else "xl/" + target


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    for _, el in ET.iterparse(z.open("xl/sharedStrings.xml")):
        if el.tag == f"{_NS}si":
            out.append("".join(t.text or "" for t in el.iter(f"{_NS}t")))
            el.clear()
    return out


def iter_rows(content: bytes, sheet: int | str = 0) -> Iterator[list[str | None]]:
    """Rows of one sheet as lists of text (None for blank cells)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = _shared(z)
        for _, el in ET.iterparse(z.open(_sheet_part(z, sheet))):
            if el.tag != f"{_NS}row":
                continue
            cells: dict[int, str | None] = {}
            for c in el.findall(f"{_NS}c"):
                t = c.get("t")
                v = c.find(f"{_NS}v")
                if t == "s" and v is not None:
                    val = shared[int(v.text)]
                elif t == "inlineStr":
                    val = "".join(x.text or "" for x in c.iter(f"{_NS}t"))
                else:
                    val = None if v is None else v.text
                cells[_col_index(c.get("r"))] = val
            el.clear()
            yield [cells.get(i) for i in range(max(cells) + 1 if cells else 0)]


def named_rows(content: bytes, columns: list[str], sheet: int | str = 0, path: str = "") -> Iterator[list[str | None]]:
    """The named columns of one sheet's rows that are not blank; a missing column is an error."""
    rows = iter_rows(content, sheet)
    header = next(rows, [])
    if lack := [c for c in columns if c not in header]:
        raise ValueError(f"no column {', '.join(lack)} in {path}")
    places = [header.index(c) for c in columns]
    for r in rows:
        if any(x not in (None, "") for x in r):
            yield [r[i] if i < len(r) else None for i in places]


def read_workbook(spark: SparkSession, path: str, columns: list[str], sheet: int | str = 0) -> DataFrame:
    """The named columns (as text) of one sheet of a file, or of every ``.xlsx`` file in a folder.
    ``sheet`` is a position (a number) or a name (a text, digits included)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame(list(named_rows(content, columns, sheet, name)), columns=columns, dtype=object)

    return files.mapInPandas(parse, ", ".join(f"`{c}` string" for c in columns))
