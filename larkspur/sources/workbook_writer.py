"""Minimal `.xlsx` workbooks from rows, the counterpart of the reader."""

from __future__ import annotations

import datetime as dt
import io
import sys
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The parts every workbook needs. Style 1 is a date, style 2 a date with a time.
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"'
    ' Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    ' xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships'
    ' xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"'
    ' Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/></cellXfs></styleSheet>',
}
SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'


def _cell_xml(value: object) -> str:
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (dt.datetime, pd.Timestamp)):
        days = (value - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
        return f'<c s="2"><v>{days!r}</v></c>'
    if isinstance(value, dt.date):
        return f'<c s="1"><v>{(value - dt.date(1899, 12, 30)).days}</v></c>'
    if isinstance(value, str):
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
    return f"<c><v>{value!r}</v></c>"


def workbook(header: Iterable[str], rows: Iterable[Iterable[object]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in PARTS.items():
            book.writestr(name, text)
        body = "".join("<row>" + "".join(map(_cell_xml, row)) + "</row>" for row in [list(header), *rows])
        book.writestr("xl/worksheets/sheet1.xml", SHEET + body + "</sheetData></worksheet>")
    return out.getvalue()


def as_workbooks(df: DataFrame) -> DataFrame:
    """The table as (path, content), one workbook per Arrow batch of rows."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for i, batch in enumerate(batches):
            rows = batch.astype(object).itertuples(index=False, name=None)
            yield pd.DataFrame({"path": [f"part-{i}.xlsx"], "content": [workbook(batch.columns, rows)]})

    return df.mapInPandas(build, "path string, content binary")
