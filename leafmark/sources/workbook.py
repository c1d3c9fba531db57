"""Workbook sheets as pages."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text as X
from leafmark.sources.numbers import BUILT_IN, shown

ROWS_PER_RUN = 10_000
CELLS = "path string, sheet_no int, sheet_name string, row_no long, cells array<string>, error string"
UNREADABLE = "无法读取工作簿："
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def flatten_sheets(rows: DataFrame, sheet: list[str] | None = None) -> DataFrame:
    """``(sheet keys, row_no, cells)`` to one text per sheet: cells joined by tabs, rows by newlines,
    missing cells empty, blank rows left out.

    Rows are joined in runs first, so a long sheet meets in one task as a few long strings only.
    """
    keys = sheet or ["sheet"]
    line = F.array_join("cells", "\t", "")
    filled = rows.where(F.exists("cells", lambda c: c.isNotNull() & (X.strip(c) != "")))
    return (
        filled.select(*keys, "row_no", F.floor(F.col("row_no") / ROWS_PER_RUN).alias("run"), line.alias("line"))
        .groupBy(*keys, "run")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("row_no", "line")))["line"], "\n").alias("part"))
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("run", "part")))["part"], "\n").alias("text"))
    )


def sheet_texts(cells: DataFrame) -> DataFrame:
    """``(path, sheet_no, text)`` of every sheet of readable workbooks; a sheet without rows is an empty page."""
    good = cells.where("error is null")
    sheets = good.select("path", "sheet_no").distinct()
    texts = flatten_sheets(good.where("row_no is not null"), ["path", "sheet_no"])
    return sheets.join(texts, ["path", "sheet_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def sheet_outline(cells: DataFrame) -> DataFrame:
    """Every sheet is one page and one outline node of level 1."""
    return cells.select("path", "sheet_no", "sheet_name").distinct().select(
        F.col("path").alias("document_id"),
        F.col("sheet_no").cast("long").alias("seq"),
        F.col("sheet_name").alias("title"),
        F.lit(1).alias("level"),
        F.col("sheet_no").cast("long").alias("page_number"),
    )


def read_cells(files: DataFrame) -> DataFrame:
    """Cells of ``(path, content)`` workbooks: ``CELLS``. A sheet starts with a row without cells; a
    workbook that cannot be read is one row with an error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "sheet_no", "sheet_name", "row_no", "cells", "error"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = _sheet_rows(content)
                    while part := [(path, *r, None) for r in itertools.islice(rows, ROWS_PER_RUN)]:
                        yield pd.DataFrame(part, columns=columns)
                except Exception as failure:  # whatever is wrong with one file is told in its row
                    yield pd.DataFrame([(path, None, None, None, None, f"{UNREADABLE}{failure}")], columns=columns)

    return files.select("path", "content").mapInPandas(parse, CELLS)


def _sheet_rows(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in root]
        links = {
            r.get("Id"): r.get("Target").lstrip("/")
            for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        }
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        properties = root.find("m:workbookPr", _NS)
        from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        codes = _codes(ElementTree.fromstring(book.read("xl/styles.xml"))) if "xl/styles.xml" in names else []
        sheets = root.findall("m:sheets/m:sheet", _NS)
        for number, sheet in enumerate(sheets, start=1):
            target = links[sheet.get(_REL)]
            yield number, sheet.get("name"), None, None
            root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
            for row_no, row in enumerate(root.iterfind("m:sheetData/m:row", _NS)):
                yield number, sheet.get("name"), row_no, _cells(row, shared, codes, from_1904)


def _codes(styles) -> list[str]:
    """The number-format code of each cell style."""
    own = {f.get("numFmtId"): f.get("formatCode") for f in styles.iterfind("m:numFmts/m:numFmt", _NS)}
    named = [x.get("numFmtId", "0") for x in styles.iterfind("m:cellXfs/m:xf", _NS)]
    return [own.get(n) or BUILT_IN.get(int(n), "General") for n in named]


def _cells(row, shared: list[str], codes: list[str], from_1904: bool) -> list[str | None]:
    """The texts a row shows: numbers, percentages and dates under the format of their cell."""
    cells: list[str | None] = []
    for cell in row.iterfind("m:c", _NS):
        place = _column(cell.get("r")) if cell.get("r") else len(cells)
        cells += [None] * (place - len(cells))
        value = cell.find("m:v", _NS)
        kind = cell.get("t")
        if kind == "inlineStr":
            cells.append("".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t")))
        elif value is None:
            cells.append(None)
        elif kind == "s":
            cells.append(shared[int(value.text)])
        elif kind == "b":
            cells.append("TRUE" if value.text == "1" else "FALSE")
        elif kind in (None, "n") and value.text:
            style = int(cell.get("s") or 0)
            cells.append(shown(float(value.text), codes[style] if style < len(codes) else None, from_1904))
        else:
            cells.append(value.text)
    return cells


def _column(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1
