"""The `.xlsx` reader: many workbooks in one job, one workbook per task row.

A workbook is a zip of XML files and cannot be split, so a task streams the first sheet of each of
its workbooks into rows of typed cells; everything after that (types, casts, profiles) is Spark's.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.types import col

# Executors need no installed copy of this module: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_ROWS = 5_000
CELLS_SCHEMA = "path string, header array<string>, cells array<struct<kind:string,text:string>>, error string"

# Fixed values of the file format: built-in number formats that show a date, a time, or both.
DATE_FORMATS = {14, 15, 16, 17}
TIME_FORMATS = {18, 19, 20, 21, 22, 45, 46, 47}


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _text(element) -> str:
    """All text runs of a string item; phonetic hints are not part of the value."""
    return "".join(t.text or "" for part in element if _tag(part) != "rPh" for t in part.iter() if _tag(t) == "t")


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    since_1904 = any(_tag(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root)
    sheet = next(e for e in root.iter() if _tag(e) == "sheet")
    link = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
    relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(e.get("Target") for e in relations if e.get("Id") == link)
    path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
    return path, since_1904


def _date_styles(book: zipfile.ZipFile) -> list[str | None]:
    """Per cell style: "d" for a date format, "t" for one with a time of day, else None."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(e.get("numFmtId")): e.get("formatCode", "") for e in root.iter() if _tag(e) == "numFmt"}

    def kind(number: int) -> str | None:
        if number in custom:
            code = re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", custom[number].lower())
            return "t" if re.search("[hs]", code) else "d" if re.search("[dy]", code) else None
        return "t" if number in TIME_FORMATS else "d" if number in DATE_FORMATS else None

    formats = next((e for e in root if _tag(e) == "cellXfs"), ())
    return [kind(int(x.get("numFmtId", 0))) for x in formats]


def _cell(element, shared: list[str], styles: list[str | None], since_1904: bool) -> tuple[str, str] | None:
    """A cell as (kind, text): i whole, f decimal, b truth, d date, t timestamp, s string; None if empty."""
    kind = element.get("t", "n")
    if kind == "inlineStr":
        text = "".join(_text(e) for e in element if _tag(e) == "is")
        return ("s", text)
    raw = next((e.text for e in element if _tag(e) == "v"), None)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return ("s", shared[int(raw)])
    if kind == "b":
        return ("b", "true" if raw == "1" else "false")
    if kind == "d":
        return ("t", raw.replace("T", " ").rstrip("Z"))
    if kind == "str":
        return ("s", raw)
    style = int(element.get("s", 0))
    date = styles[style] if style < len(styles) else None
    if date:
        days = float(raw)
        # Day 60 of the 1900 calendar is 29 February 1900, which never was.
        epoch = dt.datetime(1904, 1, 1) if since_1904 else dt.datetime(1899, 12, 31 if days < 60 else 30)
        moment = epoch + dt.timedelta(milliseconds=round(days * 86_400_000))
        if date == "d" and moment.time() == dt.time():
            return ("d", moment.date().isoformat())
        return ("t", moment.isoformat(" "))
    number = float(raw)
    if number.is_integer() and abs(number) < 2**53:
        return ("i", str(int(number)))
    return ("f", repr(number))


def _place(reference: str | None, default: int) -> int:
    """Zero-based column of a cell reference such as `AB12`."""
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return default
    place = 0
    for letter in letters.group():
        place = place * 26 + ord(letter) - 64
    return place - 1


def sheet_rows(content: bytes) -> Iterator[list[tuple[str, str] | None]]:
    """Rows of the first sheet, rows before the first filled one left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        path, since_1904 = _first_sheet(book)
        styles = _date_styles(book)
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as source:
                for _, element in ElementTree.iterparse(source):
                    if _tag(element) == "si":
                        shared.append(_text(element))
                        element.clear()
        started = False
        with book.open(path) as source:
            for _, element in ElementTree.iterparse(source):
                if _tag(element) != "row":
                    continue
                row: list[tuple[str, str] | None] = []
                for c in element:
                    place = _place(c.get("r"), len(row))
                    row += [None] * (place + 1 - len(row))
                    row[place] = _cell(c, shared, styles, since_1904)
                element.clear()
                started = started or any(row)
                if started:
                    yield row


def _header(first: list[tuple[str, str] | None]) -> tuple[int, list[str]]:
    """Where the table starts and its column names: blanks are numbered, repeats get a suffix."""
    start = next((i for i, c in enumerate(first) if c), 0)
    names: list[str] = []
    for i, c in enumerate(first[start:]):
        name = base = c[1] if c else f"__UNNAMED__{i}"
        repeat = 0
        while name in names:
            name, repeat = f"{base}_{repeat}", repeat + 1
        names.append(name)
    return start, names


def _workbook_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def frame(path, header, rows, error=None):
        return pd.DataFrame(
            {"path": [path] * len(rows), "header": [header] * len(rows), "cells": rows, "error": [error] * len(rows)}
        )

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                rows = sheet_rows(content)
                start, header = _header(next(rows, []))
                if not header:
                    raise ValueError("the first sheet is empty")
                yield frame(path, header, [None])  # one row that names the columns, even of an empty table
                out = []
                for row in rows:
                    cells = row[start : start + len(header)] + [None] * (start + len(header) - len(row))
                    if any(cells):
                        out.append([{"kind": c[0], "text": c[1]} if c else None for c in cells])
                    if len(out) == BATCH_ROWS:
                        yield frame(path, header, out)
                        out = []
                if out:
                    yield frame(path, header, out)
            except Exception as error:  # noqa: BLE001 - a broken workbook is reported with its path
                yield frame(path, None, [None], f"{type(error).__name__}: {error}")


def workbook_cells(files: DataFrame) -> DataFrame:
    """Cells of every workbook in `files` (path, content): one row per sheet row, see CELLS_SCHEMA.

    The first row of a workbook has no cells and only names its columns; a broken workbook has one
    row with an error.
    """
    return files.select("path", "content").mapInPandas(_workbook_cells, CELLS_SCHEMA)


def cell_types(width: int) -> Column:
    """Aggregate over `cells`: the Spark type of every column, from the kinds its cells have."""

    def choice(i: int) -> Column:
        kind = F.get("cells", i)["kind"]
        return (
            F.when(F.count(kind) == 0, "string")
            .when(F.count_if(kind != "i") == 0, "bigint")
            .when(F.count_if(~kind.isin("i", "f")) == 0, "double")
            .when(F.count_if(kind != "b") == 0, "boolean")
            .when(F.count_if(kind != "d") == 0, "date")
            .when(F.count_if(~kind.isin("d", "t")) == 0, "timestamp_ntz")
            .otherwise("string")
        )

    return F.array(*[choice(i) for i in range(width)])


def typed_cells(cells: DataFrame, header: list[str], types: list[str], keep: list[str] = ()) -> DataFrame:
    """Sheet rows as a table with the given column names and types."""
    values = [F.get("cells", i)["text"].cast(t).alias(c) for i, (c, t) in enumerate(zip(header, types))]
    return cells.where(F.col("cells").isNotNull()).select(*map(col, keep), *values)


def read_workbooks(files: DataFrame) -> DataFrame:
    """All workbooks of `files` (path, content) as one table; they must have the same header."""
    from larkspur.session import cut_lineage

    cells = cut_lineage(workbook_cells(files), "workbooks")  # parse every workbook once
    heads = cells.where("cells IS NULL").groupBy("header").agg(F.first("error").alias("error")).limit(2).collect()
    broken = [h["error"] for h in heads if h["error"]]
    if broken or len(heads) != 1:
        raise ValueError(broken[0] if broken else "the workbooks do not share one header" if heads else "no workbook")
    header = list(heads[0]["header"])
    types = cells.where(F.col("cells").isNotNull()).agg(cell_types(len(header))).first()[0]
    return typed_cells(cells, header, types)
