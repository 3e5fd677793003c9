"""Workbooks (.xlsx) as a Spark data source, read sheet by sheet and written a file a task.

``register(spark)`` makes the format known::

    spark.read.format("workbook").load(path)
    df.write.format("workbook").mode("overwrite").save(path)

Reading gives (file, sheet, row, cells, error): the rows that hold anything, each cell with its
kind (text, number, percent, date, time, boolean, error), its text, and its number or moment.
With the option ``fields`` (names with commas between) it gives (file, sheet, row, fields,
error): each sheet's header row is sought and columns are mapped to fields by their names;
``*`` takes every column that holds anything under its own name.
A file that can't be read, and a sheet without rows, is one row with its error.

Sheets are dealt to partitions by the size of their XML, which a workbook's directory tells:
a large sheet is a partition of its own, small ones share one (``partitionBytes``). A task
streams over a sheet and holds its workbook's shared strings and one batch of rows. Paths are
files, folders or patterns of any file system that Arrow reaches.

Dates are numbers with a date format: ids and codes of formats come from the workbook's
styles, the first day from its epoch. Sheets are found by their relationship, not by number.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from decimal import Decimal
from typing import NamedTuple
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .headers import columns_of, header_at, unique_names

FORMAT = "workbook"
PARTITION_BYTES = 32 << 20
BATCH_ROWS = 4096
#: Rows of a sheet among which the header is sought.
SCAN = 30
#: The most rows that a sheet of this format holds.
SHEET_ROWS = 1_048_576

# Ids of the built-in number formats for dates, times and percentages.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}
PERCENT_FORMATS = {9, 10}
# Texts that stand for a missing cell.
MISSING = {"", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"}

CELL = "struct<kind: string, text: string, number: double, moment: timestamp_ntz>"
CELLS_SCHEMA = f"file string, sheet string, row int, cells array<{CELL}>, error string"
RECORDS_SCHEMA = f"file string, sheet string, row int, fields map<string, {CELL}>, error string"
_CELL = pa.struct([("kind", pa.string()), ("text", pa.string()), ("number", pa.float64()), ("moment", pa.timestamp("us"))])
_FIRST = [("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32())]
_ARROW = {
    "cells": pa.schema([*_FIRST, ("cells", pa.list_(_CELL)), ("error", pa.string())]),
    "fields": pa.schema([*_FIRST, ("fields", pa.map_(pa.string(), _CELL)), ("error", pa.string())]),
}

UNREADABLE = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, NotImplementedError, OSError)


class Cell(NamedTuple):
    kind: str
    text: str | None
    number: float | None = None
    moment: dt.datetime | None = None


Row = tuple[int, list[Cell | None]]


# what a workbook says about its sheets and formats


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _named(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if _name(x.tag) == name)


def sheet_files(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, file) of each sheet in the workbook's order, by its relationship; by number where a writer left these out."""
    sheets = list(_named(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"))
    if "xl/_rels/workbook.xml.rels" not in z.namelist():
        return [(s.get("name", ""), f"xl/worksheets/sheet{k}.xml") for k, s in enumerate(sheets, 1)]
    targets = {}
    for r in _named(ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")), "Relationship"):
        if r.get("Type", "").endswith("/worksheet"):
            target = r.get("Target", "")
            targets[r.get("Id")] = target[1:] if target.startswith("/") else f"xl/{target}"
    found = []
    for s in sheets:
        # the relationship's id is the attribute ``id`` of another namespace
        link = next((v for k, v in s.attrib.items() if _name(k) == "id"), None)
        if link in targets:
            found.append((s.get("name", ""), targets[link]))
    return found


def format_kind(code: str) -> str:
    """date, percent or number, by what a format's code shows outside quotes, brackets and escapes."""
    bare = re.sub(r'"[^"]*"|\[(?!(?:h+|m+|s+)\])[^\]]*\]|[\\_*].', "", code, flags=re.IGNORECASE)
    if bare.strip().lower() == "general":
        return "number"
    return "date" if re.search("[dmyhs]", bare, re.IGNORECASE) else "percent" if "%" in bare else "number"


@dataclass
class Book:
    """What cells need from the rest of their workbook."""

    strings: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    first_day: dt.datetime = dt.datetime(1899, 12, 30)


def _text_of(node: ElementTree.Element) -> str:
    """A string's text: its own and its runs', without phonetic hints."""
    parts = [t.text or "" for child in node for t in ([child] if _name(child.tag) == "t" else child if _name(child.tag) == "r" else []) if _name(t.tag) == "t"]
    return "".join(parts)


def read_book(z: zipfile.ZipFile) -> Book:
    book, names = Book(), set(z.namelist())
    if "xl/sharedStrings.xml" in names:
        with z.open("xl/sharedStrings.xml") as f:
            for _, node in ElementTree.iterparse(f):
                if _name(node.tag) == "si":
                    book.strings.append(_text_of(node))
                    node.clear()
    if "xl/styles.xml" in names:
        styles = ElementTree.fromstring(z.read("xl/styles.xml"))
        codes = {int(n.get("numFmtId", -1)): n.get("formatCode", "") for n in _named(styles, "numFmt")}
        for group in _named(styles, "cellXfs"):
            for x in group:
                k = int(x.get("numFmtId", 0))
                book.kinds.append(format_kind(codes[k]) if k in codes else "date" if k in DATE_FORMATS else "percent" if k in PERCENT_FORMATS else "number")
    for p in _named(ElementTree.fromstring(z.read("xl/workbook.xml")), "workbookPr"):
        if p.get("date1904") in ("1", "true"):
            book.first_day = dt.datetime(1904, 1, 1)
    return book


# cells and rows


def moment_cell(serial: float, first_day: dt.datetime) -> Cell:
    """A day count as a date, or as a time of day below one; days before March 1900 count a leap day that wasn't."""
    days, part = divmod(serial, 1)
    since = dt.timedelta(milliseconds=round(part * 86_400_000))
    if days == 0 and not since.days:
        return Cell("time", str((dt.datetime.min + since).time()), serial)
    if 0 < serial < 60 and first_day.year < 1900:
        days += 1
    try:
        moment = first_day + dt.timedelta(days=days) + since
    except OverflowError:
        return Cell("error", None, serial)
    return Cell("date", str(moment), serial, moment)


def _cell(node: ElementTree.Element, book: Book) -> Cell | None:
    kind, value, inline = node.get("t", "n"), None, None
    for child in node:
        if _name(child.tag) == "v":
            value = child.text
        elif _name(child.tag) == "is":
            inline = _text_of(child)
    if kind == "inlineStr":
        value = inline
    elif kind == "s" and value is not None:
        value = book.strings[int(value)]
    if value is None or (kind in ("s", "str", "inlineStr") and value in MISSING):
        return None
    if kind in ("s", "str", "inlineStr"):
        text = value.strip()
        return Cell("text", text) if text else None
    if kind == "b":
        return Cell("boolean", "True" if value.strip() in ("1", "true") else "False", float(value.strip() in ("1", "true")))
    if kind == "e":
        return Cell("error", None)
    if kind == "d":
        moment = dt.datetime.fromisoformat(value.strip().replace("Z", ""))
        return Cell("date", str(moment), None, moment)
    style = int(node.get("s", 0))
    shown, number = book.kinds[style] if style < len(book.kinds) else "number", float(value)
    return moment_cell(number, book.first_day) if shown == "date" else Cell(shown, value.strip(), number)


def _column(reference: str) -> int:
    at = 0
    for x in reference:
        if not x.isalpha():
            break
        at = at * 26 + ord(x.upper()) - 64
    return at - 1


def sheet_rows(z: zipfile.ZipFile, file: str, book: Book) -> Iterator[Row]:
    """(row number, cells) of the rows of a sheet that hold anything; one row is held at a time."""
    with z.open(file) as f:
        held, number = None, 0
        for event, node in ElementTree.iterparse(f, ("start", "end")):
            name = _name(node.tag)
            if event == "start":
                held = node if name == "sheetData" else held
                continue
            if name != "row":
                continue
            number = int(node.get("r", number + 1))
            cells: list[Cell | None] = []
            for c in node:
                if _name(c.tag) == "c":
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _cell(c, book)
            if any(c and c.text is not None for c in cells):
                yield number, cells
            held.clear()


# headers and records


def sheet_records(rows: Callable[[], Iterator[Row]], fields: list[str]) -> Iterator[tuple[int, dict[str, Cell]]]:
    """(row, fields) of the rows below the header; a first pass finds the header and the columns that hold anything."""
    first: list[list[Cell | None]] = []
    last: dict[int, int] = {}
    for k, (_, cells) in enumerate(rows()):
        if k < SCAN:
            first.append(cells)
        for at, c in enumerate(cells):
            if c and c.text is not None:
                last[at] = k
    if not first:
        return
    head = header_at(first)
    places = sorted(last)
    names = unique_names([first[head][at] if at < len(first[head]) else None for at in places])
    below = {n: at for n, at in zip(names, places, strict=True) if last[at] > head}
    column = {f: below[n] for f, n in columns_of(list(below), fields).items()}
    for k, (number, cells) in enumerate(rows()):
        if k > head:
            yield number, {f: cells[at] for f, at in column.items() if at < len(cells) and cells[at] and cells[at].text is not None}


# files


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if re.match(r"[a-zA-Z][\w+.-]+:", path):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def _address(path: str, inner: str) -> str:
    """A file below ``path`` as a name with its file system."""
    if path.startswith("file:") or not re.match(r"[a-zA-Z][\w+.-]+:", path):
        return f"file:{inner}"
    _, own = opened(path)
    return path[: len(path) - len(own)] + inner if path.endswith(own) else path


def listed(path: str) -> list[str]:
    """The files that a path names: itself, those of a folder, or those that fit a pattern."""
    system, inner = opened(path)
    pattern = re.search(r"[*?\[]", inner)
    if pattern:
        folder = inner[: pattern.start()].rsplit("/", 1)[0]
        infos = [i for i in system.get_file_info(arrow_fs.FileSelector(folder, recursive=True)) if fnmatch.fnmatchcase(i.path, inner)]
    else:
        (info,) = system.get_file_info([inner])
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = [info] if info.is_file else system.get_file_info(arrow_fs.FileSelector(inner))
    names = sorted(i.path for i in infos if i.is_file and not i.base_name.startswith((".", "_", "~$")))
    return [_address(path, n) for n in names]


@dataclass
class Sheet:
    """A sheet of a workbook, or a file that can't be read."""

    file: str
    name: str | None = None
    target: str | None = None
    size: int = 0
    error: str | None = None


def sheets_of(file: str) -> list[Sheet]:
    """A workbook's sheets from its directory; little of the file is read."""
    if not file.lower().endswith(".xlsx"):
        return [Sheet(file, error="unsupported_file_type")]
    try:
        system, path = opened(file)
        with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            found = [Sheet(file, name, target, z.getinfo(target).file_size) for name, target in sheet_files(z)]
    except UNREADABLE as e:
        return [Sheet(file, error=f"file_normalization_failed: {e}")]
    return found or [Sheet(file, error="no_rows")]


@dataclass
class Sheets(InputPartition):
    held: list[Sheet]


def dealt(sheets: list[Sheet], size: int) -> list[Sheets]:
    """Sheets in their order, as many in a partition as ``size`` bytes of XML allow, one at least."""
    out: list[Sheets] = []
    room = -1
    for s in sheets:
        if s.size > room:
            out.append(Sheets([]))
            room = size
        out[-1].held.append(s)
        room -= max(s.size, 1)
    return out


class WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.fields = [f.strip() for f in options.get("fields", "").split(",") if f.strip()]
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Sheets]:
        with ThreadPoolExecutor(16) as pool:
            found = [s for sheets in pool.map(sheets_of, listed(self.path)) for s in sheets]
        return dealt(found, self.size)

    def _rows(self, z: zipfile.ZipFile, sheet: Sheet, book: Book) -> Iterator[tuple]:
        rows = lambda: sheet_rows(z, sheet.target, book)
        if not self.fields:
            yield from rows()
            return
        yield from ((number, list(record.items())) for number, record in sheet_records(rows, self.fields))

    def _found(self, partition: Sheets) -> Iterator[tuple]:
        file = z = book = None
        for sheet in partition.held:
            if sheet.error:
                yield sheet.file, sheet.name, None, None, sheet.error
                continue
            n = 0
            try:
                if sheet.file != file:
                    system, path = opened(sheet.file)
                    z = zipfile.ZipFile(io.BufferedReader(system.open_input_file(path), 1 << 20))
                    file, book = sheet.file, read_book(z)
                for number, held in self._rows(z, sheet, book):
                    n += 1
                    yield sheet.file, sheet.name, number, held, None
                error = None if n else "no_rows"
            except UNREADABLE as e:
                error = f"file_normalization_failed: {e}"
            if error:
                yield sheet.file, sheet.name, None, None, error

    def read(self, partition: Sheets) -> Iterator[pa.RecordBatch]:
        schema = _ARROW["fields" if self.fields else "cells"]
        batch: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*batch, strict=True))
            as_cell = lambda c: c and c._asdict()
            if self.fields:
                columns[3] = [r and [(f, as_cell(c)) for f, c in r] if r is not None else None for r in columns[3]]
            else:
                columns[3] = [r and [as_cell(c) for c in r] for r in columns[3]]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

        for row in self._found(partition):
            batch.append(row)
            if len(batch) == BATCH_ROWS:
                yield packed()
                batch.clear()
        if batch:
            yield packed()


# writing

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_STYLES = f'<styleSheet xmlns="{_NS}"><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/></cellXfs></styleSheet>'
_FIRST_DAY = dt.datetime(1899, 12, 30)
#: Control characters that XML can't hold.
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _cell_xml(v) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int | Decimal) or isinstance(v, float) and v == v and abs(v) != float("inf"):
        return f"<c><v>{v!r}</v></c>" if isinstance(v, float) else f"<c><v>{v}</v></c>"
    if isinstance(v, dt.datetime):
        # the calendar of serials has a 29 February 1900, so earlier days are text
        since = v.replace(tzinfo=None) - _FIRST_DAY
        if since.days > 60:
            return f'<c s="2"><v>{since / dt.timedelta(days=1)!r}</v></c>'
    elif isinstance(v, dt.date):
        since = dt.datetime(v.year, v.month, v.day) - _FIRST_DAY
        if since.days > 60:
            return f'<c s="1"><v>{since.days}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(v)))}</t></is></c>'


def write_book(out, columns: list[str], rows: Iterator[tuple], sheet: str) -> int:
    """A workbook of typed rows below a header; rows beyond a sheet's limit go on to further sheets. Returns the rows."""
    head = "<row>" + "".join(map(_cell_xml, columns)) + "</row>"
    begin, end = f'<worksheet xmlns="{_NS}"><sheetData>{head}', "</sheetData></worksheet>"
    n = sheets = 0
    left = next(rows, None)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        while left is not None or not sheets:
            sheets += 1
            with z.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as f:
                f.write(begin.encode())
                for _ in range(SHEET_ROWS - 1):
                    if left is None:
                        break
                    f.write(("<row>" + "".join(map(_cell_xml, left)) + "</row>").encode())
                    n += 1
                    left = next(rows, None)
                f.write(end.encode())
        ids = range(1, sheets + 1)
        names = [sheet if k == 1 else f"{sheet}_{k}" for k in ids]
        z.writestr("xl/styles.xml", _STYLES)
        listed_ = "".join(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>' for k, name in zip(ids, names, strict=True))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets>{listed_}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in ids)
        links += f'<Relationship Id="rId{sheets + 1}" Type="{_REL}/styles" Target="styles.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = [("workbook.xml", "sheet.main"), ("styles.xml", "styles"), *((f"worksheets/sheet{k}.xml", "worksheet") for k in ids)]
        overrides = "".join(f'<Override PartName="/xl/{p}" ContentType="{_TYPE}.{t}+xml"/>' for p, t in parts)
        rels = f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{overrides}'
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types">{rels}</Types>')
    return n


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class WorkbookWriter(DataSourceArrowWriter):
    """Tasks write below ``_temporary``; the commit moves what finished tasks wrote, so a failed write leaves no part."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.sheet = options.get("sheetName", "Sheet1")
        self.job = uuid.uuid4().hex

    @property
    def _own(self) -> str:
        return f"{self.path}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        iterator = iter(iterator)
        first = next(iterator, None)
        if first is None:
            return Written(None, 0)

        def rows() -> Iterator[tuple]:
            batch = first
            while batch is not None:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
                batch = next(iterator, None)

        system, folder = opened(self._own)
        system.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.xlsx"
        with system.open_output_stream(f"{folder}/{name}") as out:
            n = write_book(out, first.schema.names, rows(), self.sheet)
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        _, own = opened(self._own)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(arrow_fs.FileSelector(folder)):
                if old.is_file and old.path.endswith(".xlsx"):
                    system.delete_file(old.path)
        for m in messages:
            if m and m.name:
                system.move(f"{own}/{m.name}", f"{folder}/{m.name}")
        self._clean(system, own)

    def abort(self, messages: list[Written | None]) -> None:
        system, own = opened(self._own)
        self._clean(system, own)

    @staticmethod
    def _clean(system: arrow_fs.FileSystem, own: str) -> None:
        if system.get_file_info([own])[0].type == arrow_fs.FileType.Directory:
            system.delete_dir(own)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RECORDS_SCHEMA if self.options.get("fields") else CELLS_SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
