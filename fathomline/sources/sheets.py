"""Spreadsheets in and out: workbooks are zip archives of XML parts, read and written with the standard library.

Reading goes through Spark's binary files, so any store will do: a first pass takes
each workbook apart into one row for each sheet, still compressed, and these rows are
dealt out, so that a task parses a sheet, not a file. Writing is a Python data source:
each task writes its workbooks aside, and all are moved into place when all are there.
Sheets are unpacked, parsed and packed piece by piece: memory holds a workbook as it is
stored, never the text or the tree of a sheet.
"""

from __future__ import annotations

import datetime as dt
import io
import os
import re
import shutil
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Day 0 of serial dates (fixed value of the format: dates from March 1900 on).
DAY_ZERO = dt.datetime(1899, 12, 30)
#: Rows of a sheet, at most (fixed value of the format).
MOST_ROWS = 1_048_576
#: Rows that are handed on at once.
ROWS_AT_ONCE = 4096
#: Bytes of a sheet's text that are in hand at once.
PIECE = 1 << 18
#: Bytes of workbooks for each task that parses sheets, about.
TASK_BYTES = 32 << 20
#: What can't be in XML.
UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def column_number(letters: str) -> int:
    """A is 1, Z 26, AA 27."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(number: int) -> str:
    out = ""
    while number:
        number, k = divmod(number - 1, 26)
        out = chr(65 + k) + out
    return out


def column_range(text: str | None) -> tuple[int, int]:
    """First and last column of a range like A:Y; all columns for None."""
    if text is None:
        return 1, 1 << 30
    a, _, b = text.partition(":")
    return column_number(a), column_number(b or a)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def sheet_parts(data: bytes | pa.Buffer) -> list[tuple[str, str]]:
    """(name, part) of the sheets of a workbook, in its order. ValueError if it isn't one."""
    try:
        with zipfile.ZipFile(pa.BufferReader(data)) as z:
            links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            out = []
            for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
                if _local(e.tag) == "sheet":
                    target = links[next(v for k, v in e.attrib.items() if _local(k) == "id" and k != "id")]
                    part = target[1:] if target.startswith("/") else f"xl/{target}"
                    z.getinfo(part)
                    out.append((e.get("name"), part))
            return out
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, zlib.error, EOFError, NotImplementedError, OSError) as e:
        raise ValueError(f"no workbook: {type(e).__name__} {e}") from e


def shared_strings(data: bytes) -> list[str]:
    """The strings that cells refer to by number; phonetic readings don't count."""
    out = []
    for e in ElementTree.fromstring(data):
        skip = {id(t) for p in e.iter() if _local(p.tag) == "rPh" for t in p.iter()}
        out.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t" and id(t) not in skip))
    return out


def sheet_rows(xml: io.BufferedIOBase, shared: list[str], first: int, last: int) -> Iterator[tuple[int, dict[int, str]]]:
    """(row, {column: text}) of a sheet's rows with a cell in the columns first to last, as it is read; errors and empty cells are left out.

    Numbers and serial dates are text as they stand; truth values are true or false.
    """
    row, before, cells, outer = 0, 0, {}, None
    for event, e in ElementTree.iterparse(xml, events=("start", "end")):
        tag = _local(e.tag)
        if event == "start":
            if tag == "row":
                row, before, cells = int(e.get("r") or row + 1), 0, {}
            elif tag == "sheetData":
                outer = e
        elif tag == "c":
            ref = re.match(r"[A-Za-z]+", e.get("r") or "")
            column = column_number(ref[0]) if ref else before + 1
            before = column
            if first <= column <= last:
                kind = e.get("t") or "n"
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")
                else:
                    text = next((v.text for v in e if _local(v.tag) == "v"), None)
                    text = {"s": lambda v: shared[int(v)], "b": lambda v: "true" if v == "1" else "false", "e": lambda v: None}.get(kind, lambda v: v)(text) if text is not None else None
                if text is not None:
                    cells[column] = text
        elif tag == "row":
            if cells:
                yield row, cells
            e.clear()
            if outer is not None:
                del outer[:]  # rows that are done, which it would keep to the sheet's end


def as_type(text: Column, kind: T.DataType) -> Column:
    """A cell's text as a type: dates and times also from serial numbers, to the millisecond that these hold; null where it isn't one."""
    number = text.try_cast("double")
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        moment = F.timestamp_millis(F.round((number - 25569.0) * 86_400_000.0).cast("long"))
        return F.coalesce(F.when(number.between(-600_000.0, 2_958_466.0), moment), text.try_cast("timestamp")).cast(kind)
    if isinstance(kind, T.IntegralType):
        return F.coalesce(text.try_cast(kind), F.when(number == F.floor(number), number).try_cast(kind))
    return text.try_cast(kind)


def typed_cells(schema: T.StructType, cells: str = "_cells") -> list[Column]:
    """The columns of a schema out of a map of cells by header, null where there is none or it isn't of the type, and the map _rest of all other cells. Headers match in any case."""
    def cell(field: T.StructField) -> Column:
        own = F.filter(F.map_entries(cells), lambda e: F.lower(e["key"]) == field.name.strip().lower())
        return as_type(F.try_element_at(own, F.lit(1))["value"], field.dataType).alias(field.name)

    known = F.array(*[F.lit(f.name.strip().lower()) for f in schema]) if len(schema) else F.array().cast("array<string>")
    return [*[cell(f) for f in schema], F.map_filter(cells, lambda k, v: ~F.array_contains(known, F.lower(k))).alias("_rest")]


def read_sheets(spark: SparkSession, path: str, schema: str | T.StructType, sheet: str | None = None, columns: str | None = None, skip: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows of all workbooks at a path (folders and patterns too), and what can't be read.

    sheet: a regular expression that the whole name of a sheet must match (None: any).
    columns: a range like A:Y. skip: rows before the header. The header's texts are
    matched with the names of the schema, case and outer blanks aside; the first of
    equal headers counts.

    Returns (rows, broken). rows: _path, _sheet, _row, the columns of the schema (null
    where the header lacks one or a cell isn't of its type), and _rest, a map of the
    cells under other headers. A row without a cell in the range isn't there. broken:
    (_path, _sheet, error) of files that are no workbooks and sheets that aren't sound;
    a broken sheet gives no rows. An empty folder is an error of Spark's reader, as is
    an empty path; files of no bytes are passed over; a sheet without rows has none.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    low, high = column_range(columns)
    wanted = re.compile(sheet) if sheet is not None else None

    def one(row: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string()))], ["path", "sheet", "data", "shared", "error"])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                data, parts, error = data.as_buffer(), [], None
                try:
                    parts = [x for x in sheet_parts(data) if wanted is None or wanted.fullmatch(x[0])]
                    with zipfile.ZipFile(pa.BufferReader(data)) as z:
                        for _, part in parts:  # a file counts only if all of these can be unpacked
                            for _ in _pieces(z, part):
                                pass
                        shared = z.read("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in z.namelist() else None
                        shared = None if shared is None else zlib.compress(shared)
                except (ValueError, zipfile.BadZipFile, zlib.error, EOFError, OSError) as e:
                    error = str(e)
                if error is not None:
                    yield one((path, None, None, None, error))
                    continue
                with zipfile.ZipFile(pa.BufferReader(data)) as z:
                    for name, part in parts:  # a sheet at a time
                        yield one((path, name, _taken(z, part), shared, None))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, name, _, shared, error = (b.column(k)[i].as_py() if k != 2 else None for k in range(5))
                data = b.column(2)[i].as_buffer()
                if error is None:
                    try:
                        for _ in _cells(data, shared, low, high):  # a sheet counts only if it is sound to its end
                            pass
                    except (ValueError, ElementTree.ParseError, IndexError, zlib.error) as e:
                        error = f"no sheet: {type(e).__name__} {e}"
                if error is not None:
                    yield _sheet_batch([(path, name, None, None, error)])
                    continue
                rows, header = [], None
                for row, cells in _cells(data, shared, low, high):
                    if row <= skip:
                        continue
                    if header is None:
                        header = {c: t.strip() for c, t in cells.items()}
                        continue
                    named: dict[str, str] = {}
                    for c, t in cells.items():
                        if header.get(c):
                            named.setdefault(header[c], t)
                    rows.append((path, name, row, list(named.items()), None))
                    if len(rows) == ROWS_AT_ONCE:
                        yield _sheet_batch(rows)
                        rows = []
                if rows:
                    yield _sheet_batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    sheets = files.mapInArrow(apart, "path string, sheet string, data binary, shared binary, error string")
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]  # of the list of files alone
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, size // TASK_BYTES)
    found = sheets.repartition(parts, "path", "sheet").mapInArrow(parsed, "_path string, _sheet string, _row long, _cells map<string,string>, error string")
    rows = found.where("error is null").select("_path", "_sheet", "_row", *typed_cells(schema))
    return rows, found.where("error is not null").select("_path", "_sheet", "error")


def _pieces(z: zipfile.ZipFile, part: str) -> Iterator[bytes]:
    with z.open(part) as f:
        while piece := f.read(PIECE):
            yield piece


def _taken(z: zipfile.ZipFile, part: str) -> bytes:
    packer = zlib.compressobj(1)
    return b"".join([*(packer.compress(x) for x in _pieces(z, part)), packer.flush()])


class Unpacked(io.RawIOBase):
    """Compressed bytes, read as what they stand for without being unpacked as a whole."""

    def __init__(self, data: bytes | pa.Buffer):
        self.data, self.at, self.packer = memoryview(data), 0, zlib.decompressobj()

    def read(self, size: int = -1) -> bytes:
        out = b""
        while not out and not self.packer.eof:
            rest = self.packer.unconsumed_tail
            if not rest:
                rest = self.data[self.at : self.at + PIECE]
                self.at += PIECE
            if not len(rest):
                raise zlib.error("the sheet is cut off")
            out = self.packer.decompress(rest, max(size, 0) or PIECE)
        return out


def _cells(data: bytes | pa.Buffer, shared: bytes | None, low: int, high: int) -> Iterator[tuple[int, dict[int, str]]]:
    return sheet_rows(Unpacked(data), [] if shared is None else shared_strings(zlib.decompress(shared)), low, high)


def _sheet_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["_path", "_sheet", "_row", "_cells", "error"])


def _cell(ref: str, x: object) -> str:
    """XML of a cell; nothing for null and for what isn't a finite number."""
    if x is None:
        return ""
    if isinstance(x, bool):
        return f'<c r="{ref}" t="b"><v>{int(x)}</v></c>'
    if isinstance(x, dt.datetime):
        days = (x.replace(tzinfo=None) - DAY_ZERO) / dt.timedelta(days=1)
        return f'<c r="{ref}" s="2"><v>{days!r}</v></c>'
    if isinstance(x, dt.date):
        return f'<c r="{ref}" s="1"><v>{(dt.datetime(x.year, x.month, x.day) - DAY_ZERO).days}</v></c>'
    if isinstance(x, int):
        return f'<c r="{ref}"><v>{x}</v></c>' if abs(x) < 1 << 53 else f'<c r="{ref}" t="inlineStr"><is><t>{x}</t></is></c>'
    if isinstance(x, float):
        return f'<c r="{ref}"><v>{x!r}</v></c>' if abs(x) < float("inf") else ""
    text = escape(UNFIT.sub("", str(x)))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


class WorkbookFile:
    """A workbook that is written sheet by sheet and row by row; a sheet that is full goes on in another one, named with a number behind."""

    def __init__(self, path: str, header: list[str]):
        self.zip, self.header, self.names, self.part = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1), header, [], None
        self.rows = self.sheet = None

    def _open(self, name: str) -> None:
        self._shut()
        self.names.append(name)
        self.part = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
        self.part.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
        self.rows = 0
        self._row(self.header)

    def _shut(self) -> None:
        if self.part is not None:
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()
            self.part = None

    def _row(self, values: list) -> None:
        self.rows += 1
        cells = "".join(_cell(f"{column_letters(k)}{self.rows}", x) for k, x in enumerate(values, 1))
        self.part.write(f'<row r="{self.rows}">{cells}</row>'.encode())

    def add(self, sheet: str, values: list) -> None:
        if sheet != self.sheet:
            self.sheet, self.again = sheet, 1
            self._open(sheet)
        elif self.rows == MOST_ROWS:
            self.again += 1
            self._open(f"{sheet} {self.again}")
        self._row(values)

    def close(self) -> None:
        if not self.names:
            self._open("Sheet1")
        self._shut()
        kind, place = "application/vnd.openxmlformats-officedocument.spreadsheetml", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package, head, n = "http://schemas.openxmlformats.org/package/2006", '<?xml version="1.0" encoding="UTF-8"?>', len(self.names)
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        sheets = "".join(f'<sheet name="{escape(UNFIT.sub("", x), {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, x in enumerate(self.names, 1))
        links = "".join(f'<Relationship Id="rId{k}" Type="{place}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, n + 1))
        formats = "".join(f'<xf numFmtId="{f}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for f in (0, 14, 22))
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, n + 1)) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{place}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{place}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">{links}<Relationship Id="rId{n + 1}" Type="{place}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3">{formats}</cellXfs></styleSheet>',
        }
        for name, text in parts.items():
            self.zip.writestr(name, head + text)
        self.zip.close()


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has written aside; none where it had no rows."""

    paths: list[str]


class SheetWriter(DataSourceWriter):
    """The workbooks of each task, written aside; moved into the folder when all tasks are done, deleted if any fails."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.folder = re.sub(r"^file:(//)?(?=/)", "", options["path"])
        self.sheet, self.overwrite = options.get("sheet"), overwrite
        self.names = [f.name for f in schema]
        self.aside = os.path.join(self.folder, f"_temporary-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.aside, exist_ok=True)
        kept = [k for k, n in enumerate(self.names) if n != self.sheet]
        at = self.names.index(self.sheet) if self.sheet else None
        paths, book = [], None
        for row in iterator:
            if book is not None and at is None and book.rows >= MOST_ROWS:
                book.close()
                book = None
            if book is None:
                paths.append(os.path.join(self.aside, f"part-{uuid.uuid4().hex}.xlsx"))
                book = WorkbookFile(paths[-1], [self.names[k] for k in kept])
            book.add("Sheet1" if at is None else str(row[at]), [row[k] for k in kept])
        if book is not None:
            book.close()
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        old = [x for x in os.listdir(self.folder) if x.endswith(".xlsx")] if self.overwrite else []
        for m in messages:
            for x in m.paths if m is not None else []:
                os.replace(x, os.path.join(self.folder, os.path.basename(x)))
        for x in old:
            os.remove(os.path.join(self.folder, x))
        shutil.rmtree(self.aside, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class SheetSink(DataSource):
    """Format "sheets": workbooks in a folder that driver and executors share. Option sheet: the column that names a row's sheet."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def writer(self, schema: T.StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(dict(self.options), schema, overwrite)


def write_sheets(df: DataFrame, path: str, sheet: str | None = None, mode: str = "append") -> None:
    """Write df as workbooks into a folder that driver and executors share: one file for each task, and another whenever its sheet is full, whole or not at all.

    sheet: the column whose text names each row's sheet; the rows of a sheet are
    brought together then, and a file holds whole sheets. Without it rows stay where
    they are. Dates and times (of the session's zone) are serial numbers with a date
    format, whole numbers beyond 2**53 text; nulls and numbers that aren't finite are
    empty cells, characters that XML has no place for are left out, and a row of nulls
    is a row without cells. No rows give no files.
    """
    df.sparkSession.dataSource.register(SheetSink)
    out = df if sheet is None else df.repartition(sheet).sortWithinPartitions(sheet)
    writer = out.write.format("sheets").mode(mode)
    (writer if sheet is None else writer.option("sheet", sheet)).save(path)
