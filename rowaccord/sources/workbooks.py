"""Folders of spreadsheets, read by one Spark job: each workbook is parsed by one task."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import lit

ROW_COLUMNS = "path string, sheet string, sheet_no int, row_no int, cells array<string>"
SHEET_COLUMNS = "path string, sheet_no int, sheet string"

# Rows handed to Spark at a time.
_BATCH = 5000

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def file_types(spark: SparkSession, path: str) -> DataFrame:
    """``path, file_type, confirmed`` per file: type by name, Excel types confirmed by first bytes."""
    files = spark.read.format("binaryFile").load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ending.isin("xlsx", "xls", "tsv"), ending).otherwise(F.lit("csv"))
    magic = F.hex(F.substring("content", 1, 4))
    confirmed = (
        F.when(kind == "xlsx", magic.startswith("504B")).when(kind == "xls", magic == "D0CF11E0").otherwise(F.lit(True))
    )
    return files.select("path", kind.alias("file_type"), confirmed.alias("confirmed"))


def _workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Content of the workbooks, spread over tasks file by file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")


def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Sheet names in workbook order with the archive member of each."""
    links = {
        r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    return [(s.get("name"), "xl/" + links[s.get(f"{_REL}id")].removeprefix("/xl/")) for s in sheets]


def _texts(node: ElementTree.Element) -> str:
    """The text of a shared or inline string; phonetic hints are no part of it."""
    runs = [t for child in node if child.tag != f"{_MAIN}rPh" for t in child.iter(f"{_MAIN}t")]
    return "".join(t.text or "" for t in runs)


def _column_number(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _cell_text(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _texts(cell.find(f"{_MAIN}is"))
    if value is None or value.text is None:
        return ""
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    return value.text


def _sheet_rows(book: zipfile.ZipFile, member: str, shared: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Rows of a sheet, read as a stream: row number from 1, cell texts with gaps as empty text."""
    with book.open(member) as stream:
        number = 0
        for _, row in ElementTree.iterparse(stream):
            if row.tag != f"{_MAIN}row":
                continue
            number = int(row.get("r", number + 1))
            cells: list[str] = []
            for cell in row.iter(f"{_MAIN}c"):
                at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                cells += [""] * (at - len(cells))
                cells.append(_cell_text(cell, shared))
            yield number, cells
            row.clear()


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "sheet", "sheet_no", "row_no", "cells"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                shared = []
                if "xl/sharedStrings.xml" in book.namelist():
                    shared = [_texts(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
                for number, (name, member) in enumerate(_sheet_parts(book)):
                    rows = []
                    for row_no, cells in _sheet_rows(book, member, shared):
                        rows.append((path, name, number, row_no, cells))
                        if len(rows) == _BATCH:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=columns)


def _list_sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                names = [(path, i, name) for i, (name, _) in enumerate(_sheet_parts(book))]
            yield pd.DataFrame(names, columns=["path", "sheet_no", "sheet"])


def list_workbook_sheets(spark: SparkSession, path: str) -> DataFrame:
    """``path, sheet_no, sheet`` of all workbooks below a path, in workbook order."""
    return _workbooks(spark, path).mapInPandas(_list_sheets, SHEET_COLUMNS)


def read_workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all sheets: ``path, sheet, sheet_no, row_no, cells``; missing cells are empty text."""
    return _workbooks(spark, path).mapInPandas(_parse, ROW_COLUMNS)


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One table from one sheet (the first by default) of every workbook below a path.

    Columns are named by the header row of the first workbook; a missing name becomes
    ``col_<i>``. All workbooks must have the same header.
    """
    rows = read_workbook_rows(spark, path)
    rows = rows.where(f"sheet = {lit(sheet)}" if sheet is not None else "sheet_no = 0")
    headers = rows.where("row_no = 1").select("cells").distinct().limit(2).collect()
    if not headers:
        raise ValueError(f"no sheet {sheet!r} with a header row in {path}" if sheet else f"no sheets found in {path}")
    if len(headers) > 1:
        raise ValueError("the workbooks have different headers; read them one by one")
    names = [h or f"col_{i}" for i, h in enumerate(headers[0].cells)]
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return rows.where("row_no > 1").select(*cells)
