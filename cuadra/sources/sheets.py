"""Spreadsheets as a data source: ``spark.read.format("sheets")``, a task for each group of files or sheet and range of rows.

Workbooks (.xlsx) are read here; other formats by a reader that the caller gives. Files are opened in the tasks, in any file system
that Arrow knows.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

SCHEMA = "file string, sheet_name string, row_no int, cells array<string>, nums array<double>"
FORMAT = pa.schema([("file", pa.string()), ("sheet_name", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("nums", pa.list_(pa.float64()))])
#: A task takes files of so many bytes together, and no more than its share where there are fewer tasks than cores; a larger workbook is cut into so many rows of a sheet. Rows of a batch.
TASK_BYTES, TASK_ROWS, BATCH = 32 << 20, 100_000, 2048
#: Fixed: where a statement's header is looked for, what it has, and the window around it that is read.
PROBE_ROWS, PROBE_CELLS, BEFORE, AFTER, MOST_ROWS, MOST_CELLS = 120, 8, 6, 5500, 12_000, 12
#: Fixed: so many blank rows in a row end a sheet, past so many rows.
BLANKS, PAST = 120, 100

#: From the bytes of a file: (sheet, row number from 1, cells), by sheet and row; rows that are left out are blank.
Reader = Callable[[bytes], Iterable[tuple[str, int, list]]]
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class Workbook:
    """The sheets of an .xlsx file: numbers as they are stored, all else as text."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = {s.get("name"): posixpath.normpath(posixpath.join("/xl", links[s.get(_LINK)]))[1:] for s in book.iter(f"{_MAIN}sheet")}
        self._texts: list[str] | None = None

    def _shared(self, k: int) -> str:
        if self._texts is None:
            found = ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml"))
            self._texts = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in found]
        return self._texts[k]

    def last_row(self, sheet: str) -> int:
        """The last row by the sheet's own word, 0 where it doesn't say."""
        with self.zip.open(self.sheets[sheet]) as f:
            found = re.search(rb'<dimension ref="(?:[A-Z]+\d+:)?[A-Z]+(\d+)"', f.read(4096))
        return int(found[1]) if found else 0

    def rows(self, sheet: str) -> Iterator[tuple[int, list]]:
        """(row number, cells) in order; rows and cells that were never written are left out, or None."""
        n = 0
        with self.zip.open(self.sheets[sheet]) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                n = int(row.get("r") or n + 1)
                cells: list = []
                for c in row.iter(f"{_MAIN}c"):
                    at = self._column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells)) + [self._value(c)]
                row.clear()
                yield n, cells

    @staticmethod
    def _column(place: str) -> int:
        k = 0
        for c in place:
            if not c.isalpha():
                break
            k = 26 * k + ord(c.upper()) - 64
        return k - 1

    def _value(self, c):
        kind, value = c.get("t"), c.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        if value is None or value.text is None:
            return None
        if kind == "s":
            return self._shared(int(value.text))
        if kind in ("str", "e", "d"):
            return value.text
        if kind == "b":
            return "True" if value.text == "1" else "False"
        return float(value.text)


@dataclass
class Part(ds.InputPartition):
    """Files to read, or the rows from ``first`` to ``last`` of one sheet of a file."""

    paths: list[str]
    sheet: str | None = None
    first: int = 1
    last: int | None = None


def _text(value) -> str:
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return "" if value is None else str(value).strip()


def _windowed(rows: Iterator[tuple[int, list]]) -> Iterator[tuple[int, list]]:
    """The rows around the header, until a streak of blanks; rows that were left out are given as blank ones."""
    rows, head, header = iter(rows), [], 1
    for n, cells in rows:
        head.append((n, cells))
        said = " | ".join(_text(c).upper() for c in cells[:PROBE_CELLS])
        if n <= PROBE_ROWS and "FECHA" in said and ("CONCEPTO" in said or "DESCRIP" in said):
            header = n
            break
        if n >= PROBE_ROWS:
            break
    first = max(1, header - BEFORE)
    last = min(MOST_ROWS, header + AFTER)

    def every():
        yield from head
        yield from rows

    at, streak = first, 0
    for n, cells in every():
        if n < first:
            continue
        for k in range(at, min(n, last + 1)):  # left out
            streak += 1
            yield k, []
            if streak >= BLANKS and k - first + 1 > PAST:
                return
        if n > last:
            return
        streak = 0 if any(_text(c) for c in cells) else streak + 1
        yield n, cells[:MOST_CELLS]
        if streak >= BLANKS and n - first + 1 > PAST:
            return
        at = n + 1


class SheetReader(ds.DataSourceReader):
    def __init__(self, options: dict, read: Reader | None):
        self.path, self.read_rows = options["path"], read
        self.window = str(options.get("window", "false")).lower() == "true"
        self.first_sheet = options.get("sheets", "all") == "first" or self.window
        self.cells = int(options["cells"]) if options.get("cells") else None
        self.tasks = int(options.get("tasks", 1))
        self.names: set[str] | None = None
        self.rows = [1, None]

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Files by name, and ranges of rows; Spark tests the rest."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("file",) and isinstance(f, ds.EqualTo):
                self.names = {f.value} if self.names is None else self.names & {f.value}
            elif column == ("row_no",) and isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
                self.rows[0] = max(self.rows[0], f.value + isinstance(f, ds.GreaterThan))
            elif column == ("row_no",) and isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
                last = f.value - isinstance(f, ds.LessThan)
                self.rows[1] = last if self.rows[1] is None else min(self.rows[1], last)
            else:
                yield f

    def partitions(self) -> list[Part]:
        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
        files = sorted((f for f in files if f.is_file and not f.base_name.startswith((".", "_")) and (self.names is None or f.base_name in self.names)), key=lambda f: f.path)
        parts, held, size = [], [], 0
        most = min(TASK_BYTES, sum(f.size for f in files) // self.tasks + 1)
        for f in files:
            if f.size > TASK_BYTES and self.read_rows is None and not self.window:
                with store.open_input_file(f.path) as data:
                    book = Workbook(data.read())
                for sheet in list(book.sheets)[: 1 if self.first_sheet else None]:
                    rows = book.last_row(sheet)
                    starts = range(1, max(rows, 1) + 1, TASK_ROWS)
                    parts += [Part([f.path], sheet, k, k + TASK_ROWS - 1 if k != starts[-1] else None) for k in starts]
                continue
            if held and size + f.size > most:
                parts, held, size = [*parts, Part(held)], [], 0
            held, size = [*held, f.path], size + f.size
        return [*parts, *([Part(held)] if held else [])]

    def _sheets(self, data: bytes, only: str | None) -> Iterator[tuple[str, Iterator[tuple[int, list]]]]:
        if self.read_rows is None:
            book = Workbook(data)
            for name in [only] if only else list(book.sheets)[: 1 if self.first_sheet else None]:
                yield name, book.rows(name)
            return
        from itertools import groupby

        for k, (name, rows) in enumerate(groupby(self.read_rows(data), key=lambda r: r[0])):
            if k and self.first_sheet:
                return
            yield name, ((n, list(cells)) for _, n, cells in rows)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        first = max(part.first, self.rows[0])
        last = min((x for x in (part.last, self.rows[1]) if x is not None), default=None)
        out: list[tuple] = []
        for path in part.paths:
            with store.open_input_file(path) as f:
                data = f.read()
            for sheet, rows in self._sheets(data, part.sheet):
                for n, cells in _windowed(rows) if self.window else rows:
                    if last is not None and n > last:
                        break
                    if n >= first:
                        cells = cells[: self.cells]
                        nums = [float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None for v in cells]
                        out.append((posixpath.basename(path), sheet, n, [_text(v) for v in cells], nums))
                        if len(out) == BATCH:
                            yield self._batch(out)
                            out = []
        if out:
            yield self._batch(out)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FORMAT.types, strict=True)], schema=FORMAT)


def register_sheets(spark: SparkSession, read: Reader | None = None) -> None:
    """Make the format ``sheets`` known to the session, for .xlsx files or for what ``read`` reads."""

    class Sheets(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return "sheets"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> SheetReader:
            return SheetReader(dict(self.options), read)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Sheets)


def sheet_rows(spark: SparkSession, path: str, window: bool = False, sheets: str = "all", cells: int | None = None, read: Reader | None = None) -> DataFrame:
    """file, sheet_name, row_no (from 1), cells (text) and nums (the numbers among them) of the spreadsheets at ``path``.

    All rows and cells of ``all`` sheets, or of the ``first``; of the first ``cells`` cells of a row, where that is given. With
    ``window``, as statements are read: the first sheet's first 12 cells from 6 rows above the header (a row among the first 120 that
    has FECHA, and CONCEPTO or DESCRIP; else the first row) to 5,500 below it and row 12,000 at most, until 120 blank rows follow each
    other past the window's 100th. Filters on ``file`` and ``row_no`` reach the tasks. A file that can't be read fails its task.
    """
    register_sheets(spark, read)
    options = {"window": str(window), "sheets": sheets, "tasks": str(spark.sparkContext.defaultParallelism)} | ({"cells": str(cells)} if cells else {})
    return spark.read.format("sheets").options(**options).load(path)


def xlsx(sheets: dict[str, list[tuple[int, list]]]) -> bytes:
    """A workbook of (row number, cells) by sheet, with texts and numbers; the smallest that spreadsheet programs open."""
    from xml.sax.saxutils import escape, quoteattr

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        return f"<c><v>{v:.17g}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    main, office = _MAIN[1:-1], _LINK[1:-3]
    types = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = [f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(len(sheets))]
        z.writestr("[Content_Types].xml", f'<Types xmlns="{types}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{"".join(parts)}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{types}/relationships"><Relationship Id="r" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{"".join(f"<sheet name={quoteattr(n)} sheetId={quoteattr(str(k + 1))} r:id={quoteattr(f'r{k}')}/>" for k, n in enumerate(sheets))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{types}/relationships">{"".join(f"<Relationship Id={quoteattr(f'r{k}')} Type={quoteattr(f'{office}/worksheet')} Target={quoteattr(f'worksheets/sheet{k}.xml')}/>" for k in range(len(sheets)))}</Relationships>')
        for k, rows in enumerate(sheets.values()):
            last = max((n for n, _ in rows), default=1)
            body = "".join(f'<row r="{n}">{"".join(map(cell, cells))}</row>' for n, cells in rows)
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><dimension ref="A1:L{last}"/><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
