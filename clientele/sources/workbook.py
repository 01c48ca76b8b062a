"""Excel workbooks (.xlsx) as a Spark data source: ``spark.read.format("xlsx")``.

One input partition per workbook, so a folder of workbooks is read in parallel, and one workbook
per task on writing. Rows are streamed from the sheet's XML; a workbook is never held as a whole.
Only the standard library is needed. The path must be one that every executor can open as a file
(a shared mount).
"""

from __future__ import annotations

import glob
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage)

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# Day 0 of the 1900 date system, shifted for its non-existing 29 February 1900.
EPOCH = datetime(1899, 12, 30)
# Fixed values of the file format: rows of a sheet, number formats that stand for dates.
SHEET_ROWS = 1_048_576
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _column_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def column_name(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def _sheet_part(book: zipfile.ZipFile, sheet: str | None) -> str:
    root = ET.fromstring(book.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target")
               for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
    for s in root.iter(f"{MAIN}sheet"):
        if sheet is None or s.get("name") == sheet:
            target = targets[s.get(f"{REL}id")]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"the workbook has no sheet {sheet!r}")


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        return ["".join(t.text or "" for t in el.iter(f"{MAIN}t"))
                for _, el in ET.iterparse(f) if el.tag == f"{MAIN}si"]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt")
              if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")))}
    formats = root.find(f"{MAIN}cellXfs")
    return {i for i, xf in enumerate(formats if formats is not None else [])
            if int(xf.get("numFmtId", 0)) in DATE_FORMATS | custom}


def iter_rows(path: str, sheet: str | None = None) -> Iterator[list]:
    """Cell values of each row: text, float, bool, datetime or None."""
    with zipfile.ZipFile(path) as book:
        texts, dates = _shared_texts(book), _date_styles(book)
        with book.open(_sheet_part(book, sheet)) as f:
            for _, el in ET.iterparse(f):
                if el.tag != f"{MAIN}row":
                    continue
                row: list = []
                for cell in el.iter(f"{MAIN}c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else len(row)
                    row.extend([None] * (at + 1 - len(row)))
                    row[at] = _cell_value(cell, texts, dates)
                yield row
                el.clear()


def _cell_value(cell: ET.Element, texts: list[str], dates: set[int]):
    kind, v = cell.get("t"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return texts[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "d"):
        return v.text
    if kind == "e":
        return None
    number = float(v.text)
    if int(cell.get("s", 0)) in dates:
        return EPOCH + timedelta(microseconds=round(number * 86_400_000_000))
    return number


def convert(value, dtype: T.DataType):
    if value is None or (value == "" and not isinstance(dtype, T.StringType)):
        return None
    if isinstance(dtype, T.StringType):
        whole = isinstance(value, float) and value.is_integer()
        return str(int(value) if whole else value)
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return int(float(value))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(dtype, T.BooleanType):
        return bool(value)
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
    if isinstance(dtype, T.DateType):
        return value.date() if isinstance(value, datetime) else date.fromisoformat(str(value)[:10])
    raise TypeError(f"no workbook conversion to {dtype.simpleString()}")


def mounted_path(path: str) -> str:
    """The path as a file path; other file systems cannot be opened here."""
    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"workbooks need a mounted folder, not {path}")
    return "/" + rest.lstrip("/")


class WorkbookPart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self):
        path = mounted_path(self.options["path"])
        if os.path.isdir(path):
            path = os.path.join(path, "*.xlsx")
        return [WorkbookPart(p) for p in sorted(glob.glob(path))]

    def read(self, partition: WorkbookPart):
        rows = iter_rows(partition.path, self.options.get("sheet"))
        header = [str(h) for h in next(rows, [])]
        missing = [f.name for f in self.schema if f.name not in header]
        if missing:
            raise ValueError(f"{partition.path} has no columns {missing}")
        at = [(header.index(f.name), f.dataType) for f in self.schema]
        for row in rows:
            if any(v is not None for v in row):
                yield tuple(convert(row[i] if i < len(row) else None, t) for i, t in at)


class WorkbookCommit(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WorkbookWriter(DataSourceWriter):
    """One workbook per task, and a further one whenever a sheet is full."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def write(self, rows) -> WorkbookCommit:
        folder = mounted_path(self.options["path"])
        os.makedirs(folder, exist_ok=True)
        limit = int(self.options.get("rowspersheet", SHEET_ROWS - 1))
        paths, rows = [], iter(rows)
        row = next(rows, None)
        while row is not None:
            path = os.path.join(folder, f"part-{uuid.uuid4().hex}.xlsx.tmp")
            row = self._write_book(path, row, rows, limit)
            paths.append(path)
        return WorkbookCommit(paths)

    def _write_book(self, path: str, row, rows, limit: int):
        """Write up to ``limit`` rows; return the first row that did not fit."""
        names = self.schema.names
        sheet = escape(self.options.get("sheet", "Sheet1"), {'"': "&quot;"})
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
            for part, text in _frame_parts(sheet).items():
                book.writestr(part, text)
            with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                f.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                f.write(_row_xml(1, names).encode())
                n = 0
                while row is not None and n < limit:
                    n += 1
                    f.write(_row_xml(n + 1, row).encode())
                    row = next(rows, None)
                f.write(b"</sheetData></worksheet>")
        return row

    def commit(self, messages) -> None:
        for m in messages:
            for p in (m.paths if m else []):
                os.replace(p, p.removesuffix(".tmp"))

    def abort(self, messages) -> None:
        for m in messages:
            for p in (m.paths if m else []):
                if os.path.exists(p):
                    os.remove(p)


def _row_xml(number: int, values) -> str:
    cells = []
    for i, v in enumerate(values):
        ref = f'r="{column_name(i)}{number}"'
        if v is None:
            continue
        if isinstance(v, bool):
            cells.append(f'<c {ref} t="b"><v>{int(v)}</v></c>')
        elif isinstance(v, datetime):
            days = (v.replace(tzinfo=None) - EPOCH) / timedelta(days=1)
            cells.append(f'<c {ref} s="1"><v>{days!r}</v></c>')
        elif isinstance(v, date):
            cells.append(f'<c {ref} s="1"><v>{(datetime(v.year, v.month, v.day) - EPOCH).days}</v></c>')
        elif isinstance(v, (int, float)):
            cells.append(f"<c {ref}><v>{v!r}</v></c>")
        else:
            cells.append(f'<c {ref} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'


def _frame_parts(sheet: str) -> dict[str, str]:
    """The fixed parts every workbook needs besides its sheet."""
    types = "http://schemas.openxmlformats.org/package/2006/content-types"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    return {
        "[Content_Types].xml": (
            f'{head}<Types xmlns="{types}">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
            f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>'),
        "_rels/.rels": (
            f'{head}<Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="rId1" '
            f'Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
        "xl/workbook.xml": (
            f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets>'
            f'<sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>'),
        "xl/_rels/workbook.xml.rels": (
            f'{head}<Relationships xmlns="{PACKAGE[1:-1]}">'
            f'<Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/>'
            f'<Relationship Id="rId2" Type="{office}/styles" Target="styles.xml"/></Relationships>'),
        "xl/styles.xml": (
            f'{head}<styleSheet xmlns="{MAIN[1:-1]}"><fonts count="1"><font/></fonts>'
            '<fills count="1"><fill/></fills><borders count="1"><border/></borders>'
            '<cellStyleXfs count="1"><xf/></cellStyleXfs>'
            '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs>'
            '</styleSheet>'),
    }


class WorkbookSource(DataSource):
    """Options: ``path`` (file, folder or pattern) and ``sheet`` (default the first)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        raise ValueError("give the schema: spark.read.format('xlsx').schema(…)")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WorkbookReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(schema, dict(self.options))


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType | str,
                   sheet: str | None = None) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("xlsx").schema(schema)
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def write_workbooks(df: DataFrame, path: str, sheet: str = "Sheet1") -> str:
    df.sparkSession.dataSource.register(WorkbookSource)
    df.write.format("xlsx").option("sheet", sheet).mode("append").save(path)
    return path
