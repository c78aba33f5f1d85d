"""Spreadsheets (xlsx) as rows: a zipped set of XML parts, read by tasks, a file each."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats without a code of their own that show dates or times (fixed values of the file format).
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Rows that a task gives out at once.
ROWS = 5000


def column_number(ref: str) -> int:
    """The number of a cell's column, from 0, by its reference: A1 is in 0, AB3 in 27."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def serial_date(value: float, since_1904: bool) -> str:
    """A date serial as ISO text; the time of day only where there is one. The older calendar counts a 29th of February 1900 that never was."""
    base = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30 if value >= 60 else 31)
    at = base + datetime.timedelta(seconds=round(value * 86400))
    return at.strftime("%Y-%m-%d" if at.time() == datetime.time() else "%Y-%m-%d %H:%M:%S")


def _is_date(code: str) -> bool:
    """Whether a number format shows a date or time, apart from what it quotes."""
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower()))) and "general" not in code.lower()


def _dates(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): _is_date(f.get("formatCode", "")) for f in root.iter(f"{MAIN}numFmt")}
    used = root.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in used] if used is not None else []
    return [own.get(i, i in DATE_FORMATS) for i in ids]


def _texts(node: ElementTree.Element) -> str:
    """The text of a string, in all its runs but those of phonetic hints."""
    return "".join(t.text or "" for child in node for t in ([child] if child.tag == f"{MAIN}t" else child.iter(f"{MAIN}t") if child.tag == f"{MAIN}r" else []))


def read_sheets(content: bytes, sheet: str | None = None) -> Iterator[tuple[str, int, dict[int, str]]]:
    """(sheet, row number from 1, text by column) of each row that has a value; of a merged range the first cell has it, as in the file."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        top = ElementTree.fromstring(book.read("xl/workbook.xml"))
        since_1904 = any(p.get("date1904") in ("1", "true") for p in top.iter(f"{MAIN}workbookPr"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        strings = [_texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in book.namelist() else []
        dates = _dates(book)

        def text(cell: ElementTree.Element) -> str | None:
            kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
            if kind == "inlineStr":
                return _texts(cell.find(f"{MAIN}is"))
            if value is None or value.text is None:
                return None
            if kind == "s":
                return strings[int(value.text)]
            style = int(cell.get("s", 0))
            if kind == "n" and style < len(dates) and dates[style]:
                return serial_date(float(value.text), since_1904)
            return {"1": "TRUE", "0": "FALSE"}.get(value.text, value.text) if kind == "b" else value.text

        for s in top.iter(f"{MAIN}sheet"):
            if sheet is not None and s.get("name") != sheet:
                continue
            target = targets[s.get(LINK)]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            last = 0
            with book.open(part) as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{MAIN}row":
                        continue
                    last = int(row.get("r", last + 1))
                    cells, at = {}, -1
                    for c in row.iter(f"{MAIN}c"):
                        at = column_number(c.get("r")) if c.get("r") else at + 1
                        if (x := text(c)) is not None:
                            cells[at] = x
                    if cells:
                        yield s.get("name"), last, cells
                    row.clear()


def sheets(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Rows (file, sheet, row, cells map, corrupt) of all workbooks under ``path``: each row's texts by the names in the sheet's first row.

    Numbers are as in the file, dates ISO text, empty cells missing. A column without a name is called by its number (``column 3``). A file that can't be read
    gives one row whose ``corrupt`` says why, after the rows read before that. A workbook is read by one task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "sheet", "row", "cells", "corrupt"]
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                out: list[tuple] = []
                header: dict[int, str] = {}
                current = None
                try:
                    for title, n, cells in read_sheets(content, sheet):
                        if title != current:
                            current, header = title, cells
                            continue
                        out.append((file, title, n, {header.get(k, f"column {k + 1}"): v for k, v in cells.items()}, None))
                        if len(out) >= ROWS:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, TypeError, AttributeError, OverflowError) as e:
                    out.append((file, current, None, None, f"{type(e).__name__}: {e}"))
                if out:
                    yield pd.DataFrame(out, columns=names).astype({"row": "Int64"})

    return files.mapInPandas(run, "file string, sheet string, row int, cells map<string,string>, corrupt string")


def day_first(text: Column) -> Column:
    """A date written day first (3.1.2025, 03/01/2025, 3-1-2025) or as ISO text, with or without a time; else null."""
    parts = lambda p: [F.regexp_extract(text, p, i) for i in (1, 2, 3)]
    d, m, y = parts(r"^\s*(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?:\D.*)?$")
    year, month, day = parts(r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})(?:\D.*)?$")
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return F.when(y != "", made(y, m, d)).when(year != "", made(year, month, day))


def keeper_sheet(spark: SparkSession, path: str, date: str, columns: dict[str, str], sheet: str | None = None) -> DataFrame:
    """Rows (file, row, date, ..) of keeper logs: ``columns`` gives the new names of a sheet's columns, and a date holds for the rows below it up to the next.

    Rows of corrupt files are left out; ``sheets`` shows them.
    """
    from pyspark.sql import Window

    rows = sheets(spark, path, sheet).where("corrupt is null")
    held = F.last(F.nullif(F.trim(F.col("cells")[date]), F.lit("")), ignorenulls=True).over(Window.partitionBy("file", "sheet").orderBy("row"))
    return rows.select("file", "sheet", "row", day_first(held).alias("date"), *[F.coalesce(F.col("cells")[old], F.lit("")).alias(new) for old, new in columns.items()])
