"""Workbooks (.xlsx): a zip of XML, read by rows in tasks and written row by row, without other packages.

Spark's readers fetch the file, so it may lie in any store; one workbook is one task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from itertools import chain
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: numbers of built-in date formats, first days of the two calendars, rows of a sheet.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
FIRST_DAY, FIRST_DAY_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)
MOST_ROWS = 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_NOT_DATE = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.|_.')
#: Rows of a batch on their way to Spark.
BATCH = 2048


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _column(reference: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(element) -> str:
    """All text runs of a string item; phonetic hints are none."""
    return "".join(t.text or "" for child in element if _tag(child) in ("t", "r") for t in ([child] if _tag(child) == "t" else child) if _tag(t) == "t")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in root.iter(f"{{{_MAIN}}}numFmt")}
    dates = DATE_FORMATS | {k for k, code in own.items() if re.search("[dmyhs]", _NOT_DATE.sub("", code), re.IGNORECASE)}
    cells = root.find(f"{{{_MAIN}}}cellXfs")
    return set() if cells is None else {k for k, x in enumerate(cells) if int(x.get("numFmtId", 0)) in dates}


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """The first sheet's place in the zip, and whether days count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = root.find(f"{{{_MAIN}}}sheets")[0].get(f"{{{_LINKS}}}id")
    about = root.find(f"{{{_MAIN}}}workbookPr")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(x.get("Target") for x in links if x.get("Id") == sheet)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}", about is not None and about.get("date1904") in ("1", "true")


def _shown(serial: float, from_1904: bool) -> str:
    """A date's number as text; days before March 1900 are one off, as the format counts a day that was none."""
    first = FIRST_DAY_1904 if from_1904 else FIRST_DAY if serial >= 60 else FIRST_DAY + timedelta(days=1)
    at = first + timedelta(milliseconds=round(serial * 86_400_000))
    return at.strftime("%Y-%m-%d %H:%M:%S") + (f".{at.microsecond // 1000:03d}" if at.microsecond else "")


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The first sheet's rows as text, in order; rows and cells that the file leaves out are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        place, from_1904 = _first_sheet(book)
        dates, strings = _date_styles(book), []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, x in ElementTree.iterparse(f):
                    if _tag(x) == "si":
                        strings.append(_text(x))
                        x.clear()
        seen = 0
        with book.open(place) as f:
            for _, row in ElementTree.iterparse(f):
                if _tag(row) != "row":
                    continue
                number = int(row.get("r", seen + 1))
                for _ in range(seen + 1, number):
                    yield []
                seen, cells = number, []
                for cell in row:
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, parts = cell.get("t", "n"), {_tag(x): x for x in cell}
                    value = parts["v"].text if "v" in parts else None
                    if kind == "inlineStr":
                        value = _text(parts["is"]) if "is" in parts else None
                    elif value is not None and kind == "s":
                        value = strings[int(value)]
                    elif value is not None and kind == "b":
                        value = "true" if value == "1" else "false"
                    elif kind == "e":
                        value = None
                    elif value is not None and kind == "n" and int(cell.get("s", 0)) in dates:
                        value = _shown(float(value), from_1904)
                    cells[at] = value
                yield cells
                row.clear()


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet's cells as text columns _c0, _c1, ..., in the order of its rows."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[list[str | None]] = []
                for row in sheet_rows(content.as_py()):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], ["cells"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], ["cells"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "cells array<string>")
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    return rows.select(*[F.get("cells", F.lit(k)).alias(f"_c{k}") for k in range(width)])


def _name(column: int) -> str:
    out, n = "", column + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(value, at: str) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, datetime | date):
        moment = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
        return f'<c r="{at}" s="1"><v>{(moment - FIRST_DAY) / timedelta(days=1)!r}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def write_workbook(df: DataFrame, target: str, header: bool = True) -> None:
    """One sheet, written by the driver row by row; a sheet has MOST_ROWS rows at most, and more are an error."""
    n = df.limit(MOST_ROWS + 1).count()
    if n + header > MOST_ROWS:
        raise ValueError(f"a sheet has {MOST_ROWS:,} rows at most; write CSV or Parquet instead")
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:
        types = [("/xl/workbook.xml", "sheet.main"), ("/xl/worksheets/sheet1.xml", "worksheet"), ("/xl/styles.xml", "styles")]
        parts = "".join(f'<Override PartName="{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{t}+xml"/>' for p, t in types)
        book.writestr("[Content_Types].xml", f'{xml}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{parts}</Types>')
        link = lambda k, kind, to: f'<Relationship Id="rId{k}" Type="{_LINKS}/{kind}" Target="{to}"/>'
        book.writestr("_rels/.rels", f'{xml}<Relationships xmlns="{_PACKAGE}/relationships">{link(1, "officeDocument", "xl/workbook.xml")}</Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="{_PACKAGE}/relationships">{link(1, "worksheet", "worksheets/sheet1.xml")}{link(2, "styles", "styles.xml")}</Relationships>')
        book.writestr("xl/workbook.xml", f'{xml}<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/styles.xml", f'{xml}<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd\\ hh:mm:ss"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>')
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{xml}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            for k, row in enumerate(chain([df.columns] if header else [], df.toLocalIterator()), 1):
                f.write(f'<row r="{k}">{"".join(_cell(v, f"{_name(c)}{k}") for c, v in enumerate(row))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
