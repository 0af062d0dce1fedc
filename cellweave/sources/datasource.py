"""Workbooks as data sources of Spark: cells of any format, and typed rows of dBase tables.

    register(spark)
    spark.read.format("cellweave").load("/data/books").where("sheet_idx = 0 and row_idx < 100")
    spark.read.format("cellweave_dbf").load("/data/table.dbf")
    rows.write.format("cellweave").mode("append").save("/data/out")          # name, content: a file each
    cells.write.format("cellweave").option("as", "json").mode("append").save("/data/out")

Small files share partitions up to a number of bytes; an archive or compound file of more is read by sheet, a dBase table by ranges of
records. Filters on path, sheet, row and column are the source's own: files and sheets that they exclude are not opened, a sheet is read
up to the last row that they admit. A schema given to the reader prunes: where no text is asked for, string tables are not read.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    CaseInsensitiveDict, DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from cellweave.sources import streams
from cellweave.sources.compound import Compound
from cellweave.sources.encodings import detect, detect_dif
from cellweave.sources.files import listed, opened, resolve
from cellweave.sources.model import ROWS

CELLS = "workbook_id string, sheet_idx int, row_idx int, col_idx int, v_type string, v_str string, v_num double, v_bool boolean, formula string"
KINDS = dict(c.split() for c in CELLS.split(", "))
TEXT = {"csv", "tsv", "tab", "txt", "dif", "slk", "sylk", "xml", "html", "htm"}
BOOKS = {"xlsx", "ods", "xls", "dbf", "wks", "wk1", "wk3", "wk4", "123"}
#: Bytes of a partition, and what opening a file counts for.
PARTITION, OPENING = 32 << 20, 64 << 10


def kind_of(path: str) -> str:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


# filters


def _compare(f: Filter) -> Callable | None:
    """What a filter asks of a value; None for other kinds of filters."""
    if isinstance(f, IsNotNull):
        return lambda x: x is not None
    if isinstance(f, In):
        return lambda x, own=frozenset(f.value): x in own
    ways = {
        EqualTo: lambda x, v: x == v, EqualNullSafe: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
        StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
    }
    way = ways.get(type(f))
    return None if way is None or f.value is None else lambda x: way(x, f.value)


@dataclass
class Wanted:
    """What is asked of path, sheet, row and column; none of them is ever null."""

    filters: dict[str, list[Filter]]

    def take(self, f: Filter) -> bool:
        """Take over a filter, if it is about a place."""
        if len(f.attribute) != 1 or f.attribute[0] not in ("workbook_id", "sheet_idx", "row_idx", "col_idx") or _compare(f) is None:
            return False
        self.filters.setdefault(f.attribute[0], []).append(f)
        return True

    def test(self, name: str) -> Callable:
        some = [_compare(f) for f in self.filters.get(name, ())]
        return lambda x: all(one(x) for one in some)

    def last(self, name: str) -> int | None:
        """The largest value that can pass."""
        ends = []
        for f in self.filters.get(name, ()):
            if isinstance(f, (EqualTo, EqualNullSafe, LessThanOrEqual)):
                ends.append(f.value)
            elif isinstance(f, LessThan):
                ends.append(f.value - 1)
            elif isinstance(f, In):
                ends.append(max((v for v in f.value if v is not None), default=-1))
        return min(ends, default=None)


# cells


class Piece(InputPartition):
    """Whole files, or one sheet of one file."""

    def __init__(self, paths: list[str], sheet: int | None = None):
        super().__init__((paths, sheet))
        self.paths, self.sheet = paths, sheet


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema = CaseInsensitiveDict(options), schema
        self.wanted = Wanted({})
        if wrong := [f.name for f in schema if KINDS.get(f.name) != f.dataType.simpleString()]:
            raise ValueError(f"Columns of another name or type than those of cells: {', '.join(wrong)}")
        self.texts = bool({"v_str", "v_type", "formula"} & set(schema.names))
        #: Parts and streams that this reader has opened, for tests.
        self.seen: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        if index := self.options.get("worksheetIndex"):
            self.wanted.take(EqualTo(("sheet_idx",), int(index)))
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Piece]:
        if (index := self.options.get("worksheetIndex")) and "sheet_idx" not in self.wanted.filters:
            self.wanted.take(EqualTo(("sheet_idx",), int(index)))
        most, by_sheet = int(self.options.get("partitionBytes", PARTITION)), self.options.get("perSheet", "false").lower() == "true"
        path_ok, sheet_ok = self.wanted.test("workbook_id"), self.wanted.test("sheet_idx")
        out, held, size = [], [], 0
        for path, n in listed(self.options["path"]):
            kind = self.kind(path)
            if kind not in TEXT | BOOKS or not path_ok(path):
                continue
            if kind in ("xlsx", "xls", "ods") and (by_sheet or n > most and kind != "ods"):
                out += [Piece([path], i) for i in range(self.sheets(path, kind)) if sheet_ok(i)]
                continue
            if held and size + n + OPENING > most:
                out.append(Piece(held))
                held, size = [], 0
            held.append(path)
            size += n + OPENING
        return out + [Piece(held)] if held else out

    def kind(self, path: str) -> str:
        return self.options.get("as") or kind_of(path)

    def sheets(self, path: str, kind: str) -> int:
        """How many sheets a file has, by its list of sheets; a damaged one has none. Tables of OpenDocument have no list and are counted."""
        try:
            with opened(path) as f:
                if kind == "xls":
                    return len(streams.xls_sheets(self.book(f)))
                with zipfile.ZipFile(f) as z:
                    if kind == "xlsx":
                        return len(streams.xlsx_parts_of(z))
                    with z.open("content.xml") as x:
                        return sum(1 for _ in streams.stream_nodes(x, {"table-row"}, {"table"}) if _.name == "table")
        except (*streams.DAMAGE, KeyError):
            if self.options.get("mode", "").upper() == "FAILFAST":
                raise
            return 0

    def book(self, f) -> bytes:
        c = Compound(f)
        entry = c.find("Workbook", "Book")
        if entry is None:
            raise ValueError("No workbook stream")
        return c.read(entry)

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        names = list(KINDS)
        take, kinds = [names.index(n) for n in self.schema.names], [f.dataType for f in self.schema]
        tests = [(i, self.wanted.test(n)) for i, n in enumerate(("sheet_idx", "row_idx", "col_idx")) if self.wanted.filters.get(n)]
        held: list[list] = [[] for _ in take]
        arrow = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, arrow[k.simpleString()]) for c, k in zip(held, kinds, strict=True)], self.schema.names)
            for c in held:
                c.clear()
            return out

        n = 0
        for path in piece.paths:
            for cell in self.sound(path, piece.sheet):
                if all(ok(cell[i]) for i, ok in tests):
                    row = (path, *cell)
                    for c, i in zip(held, take, strict=True):
                        c.append(row[i])
                    n += 1
                    if n % ROWS == 0:
                        yield batch()
        if n % ROWS:
            yield batch()

    def sound(self, path: str, sheet: int | None) -> Iterator[streams.Cell]:
        """Cells of a file. One that is damaged has none, or with mode FAILFAST ends the job."""
        try:
            yield from self.cells(path, sheet)
        except (*streams.DAMAGE, KeyError) as e:
            if self.options.get("mode", "").upper() == "FAILFAST":
                raise ValueError(f"{path}: {e}") from e

    def cells(self, path: str, sheet: int | None) -> Iterator[streams.Cell]:
        kind, o = self.kind(path), self.options
        sheet_ok, last, last_sheet = self.wanted.test("sheet_idx"), self.wanted.last("row_idx"), self.wanted.last("sheet_idx")
        with opened(path) as f:
            self.seen.append(path)
            if kind in TEXT:
                data = f.read()
                name = o.get("encoding") or (detect_dif(data) if kind == "dif" else detect(data))
                text = data.decode(name, "replace").removeprefix("﻿")
                if kind in ("csv", "tsv", "tab", "txt"):
                    yield from streams.csv_cells(text, o.get("delimiter", ",") if kind == "csv" else "\t")
                elif kind == "dif":
                    yield from streams.dif_cells(text)
                elif kind in ("slk", "sylk"):
                    yield from streams.sylk_cells(text)
                elif kind == "xml":
                    if wrong := streams.fault(io.BytesIO(text.encode("utf-8", "replace")), encoding="utf-8"):
                        raise ValueError(wrong)
                    yield from (cell for _, cell in streams.spreadsheetml(text))
                else:
                    table = o.get("tableIndex", "0")
                    yield from streams.html_cells(text, None if table == "all" else int(table), o.get("firstRowAsHeader", "true").lower() != "false")
            elif kind == "dbf":
                yield from streams.dbf_cells(f)
            elif kind == "xls":
                book = self.book(f)
                strings = streams.xls_strings(book) if self.texts else []
                for i, at in enumerate(streams.xls_sheets(book)):
                    if sheet in (None, i) and sheet_ok(i):
                        self.seen.append(f"{path}#{i}")
                        yield from streams.xls_cells(book, i, at, strings, last)
            elif kind in ("xlsx", "ods"):
                with zipfile.ZipFile(f) as z:
                    if kind == "ods":
                        if sheet is None and last_sheet is not None and 0 <= last_sheet < 1 << 12:
                            some = [i for i in range(last_sheet + 1) if sheet_ok(i)]
                            sheet = some[0] if len(some) == 1 else None
                        yield from self.ods(z, sheet, last)
                        return
                    wanted = {i for i, _ in enumerate(streams.xlsx_parts_of(z)) if sheet in (None, i) and sheet_ok(i)}
                    if wrong := streams.archive_fault(z, kind, wanted):
                        raise ValueError(wrong)
                    strings = streams.xlsx_strings_of(z) if self.texts and wanted else []
                    for i, part in enumerate(streams.xlsx_parts_of(z)):
                        if i in wanted:
                            self.seen.append(part)
                            yield from (streams.xlsx_cell(*one) for one in streams.xlsx_stored(z, i, part, strings, last))
            else:
                yield from streams.lotus_cells(f)

    def ods(self, z: zipfile.ZipFile, sheet: int | None, last: int | None) -> Iterator[streams.Cell]:
        if wrong := streams.archive_fault(z, "ods"):
            raise ValueError(wrong)
        self.seen.append("content.xml")
        with z.open("content.xml") as f:
            yield from (cell for _, cell in streams.ods_cells(f, sheet, last))


class WorkbookSource(DataSource):
    """Options: path, as (a format, whatever the extension), delimiter, encoding, tableIndex (a number or all), firstRowAsHeader,
    worksheetIndex, perSheet, partitionBytes, mode (FAILFAST: a damaged file ends the job)."""

    @classmethod
    def name(cls) -> str:
        return "cellweave"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WorkbookReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return (JsonWriter if self.options.get("as", "files") == "json" else FileWriter)(self.options["path"], schema, overwrite)


# tables of dBase


class Records(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        super().__init__((path, first, count))
        self.path, self.first, self.count = path, first, count


def dbf_type(kind: str, length: int, decimals: int) -> T.DataType:
    """The type of a field's column."""
    if kind == "N":
        return T.DecimalType(min(max(length, decimals + 1), 38), decimals) if decimals or length > 18 else T.LongType()
    fixed = {"F": T.DoubleType(), "B": T.DoubleType(), "O": T.DoubleType(), "I": T.IntegerType(), "+": T.IntegerType(), "Y": T.DecimalType(19, 4), "L": T.BooleanType(), "D": T.DateType(), "T": T.TimestampType(), "G": T.BinaryType(), "P": T.BinaryType()}
    return fixed.get(kind, T.StringType())


def dbf_column(kind: str, raw: np.ndarray, type_: T.DataType) -> list:
    """Values of a field over many records; raw: records by bytes. What can't be read is null."""
    from datetime import date, datetime, timedelta

    cells = [bytes(r) for r in raw]
    if kind in "NF":
        texts = [c.decode("latin-1").strip(" \0") for c in cells]
        ok = [streams.whole_number(t) is not None for t in texts]
        if isinstance(type_, T.DoubleType):
            return [float(t) if k else None for t, k in zip(texts, ok, strict=True)]
        if isinstance(type_, T.LongType):
            return [int(Decimal(t)) if k else None for t, k in zip(texts, ok, strict=True)]
        grain = Decimal(1).scaleb(-type_.scale)
        return [Decimal(t).quantize(grain) if k else None for t, k in zip(texts, ok, strict=True)]
    if kind in "I+":
        return np.ascontiguousarray(raw[:, :4]).view("<i4").ravel().tolist() if raw.shape[1] >= 4 else [None] * len(cells)
    if kind == "Y":
        return [Decimal(x).scaleb(-4) for x in np.ascontiguousarray(raw[:, :8]).view("<i8").ravel().tolist()] if raw.shape[1] >= 8 else [None] * len(cells)
    if kind in "BO":
        return np.ascontiguousarray(raw).view("<f8").ravel().tolist() if raw.shape[1] == 8 else [None] * len(cells)
    if kind == "L":
        return [True if c in (b"T", b"t", b"Y", b"y") else False if c in (b"F", b"f", b"N", b"n") else None for c in cells]
    if kind == "D":

        def day(c: bytes):
            try:
                return date(int(c[:4]), int(c[4:6]), int(c[6:8]))
            except ValueError:
                return None

        return [day(c) for c in cells]
    if kind == "T":
        begin = datetime(1970, 1, 1)
        parts = np.ascontiguousarray(raw[:, :8]).view("<u4") if raw.shape[1] >= 8 else np.zeros((len(cells), 2), np.uint32)
        return [begin + timedelta(days=d - 2440588, milliseconds=m) if 0 < d < 5373485 else None for d, m in parts.tolist()]
    if kind in "GP":
        return cells
    return [t or None for t in (c.decode("latin-1").strip(" ").replace("\0", "") for c in cells)]


class TableReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema = CaseInsensitiveDict(options), schema

    def partitions(self) -> list[Records]:
        """Ranges of whole records, by the header of each file."""
        most, out = int(self.options.get("partitionBytes", PARTITION)), []
        for path, length in listed(self.options["path"]):
            if (self.options.get("as") or kind_of(path)) != "dbf":
                continue
            n, head, size, _ = table_header(path)
            n = min(n, -(-max(0, length - head) // size) if size else 0)
            step = max(1, most // max(size, 1))
            out += [Records(path, i, min(step, n - i)) for i in range(0, n, step)]
        return out

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        _, head, size, fields = table_header(part.path)
        place = {unique: f for unique, f in zip(unique_names(fields), fields, strict=True)}
        with opened(part.path) as f:
            for first in range(part.first, part.first + part.count, ROWS):
                n = min(ROWS, part.first + part.count - first)
                f.seek(head + first * size)
                data = f.read(n * size)
                n = len(data) // size  # a cut-off record is left out
                raw = np.frombuffer(data, np.uint8, n * size).reshape(n, size)
                live = raw[:, 0] != ord("*")
                if self.options.get("deleted", "false").lower() != "true":
                    keep = np.flatnonzero(live)
                else:
                    keep = np.arange(n)
                own = {"_file": [part.path] * len(keep), "_record": (first + keep).tolist(), "_deleted": (~live[keep]).tolist()}
                columns = []
                for c in self.schema:
                    if c.name in place:
                        _, kind, length, _, at = place[c.name]
                        own[c.name] = dbf_column(kind, raw[keep, at : at + length], c.dataType)
                    columns.append(pa.array(own.get(c.name, [None] * len(keep)), _arrow_type(c.dataType)))
                yield pa.RecordBatch.from_arrays(columns, self.schema.names)


def _arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.DecimalType):
        return pa.decimal128(t.precision, t.scale)
    fixed = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "date": pa.date32(), "timestamp": pa.timestamp("us", "UTC"), "binary": pa.binary()}
    return fixed.get(t.simpleString(), pa.string())


def table_header(path: str) -> tuple:
    with opened(path) as f:
        lead = f.read(32)
        if len(lead) < 32:
            raise ValueError(f"{path}: too short for a table header")
        return streams.dbf_header(lead + f.read(max(0, struct.unpack_from("<H", lead, 8)[0] - 32)))


def unique_names(fields: list[tuple]) -> list[str]:
    """Names of columns: a repeated one (in any case) gets its number, one without letters too."""
    out: list[str] = []
    for i, (name, *_) in enumerate(fields):
        taken = {n.lower() for n in out}
        out.append(name if name and name.lower() not in taken else f"{name}_{i}")
    return out


class TableSource(DataSource):
    """Options: path, as, partitionBytes, deleted (true: deleted records too). The schema is that of the first file; files of others give
    null for columns that they lack. _file, _record and _deleted are there beside the table's own columns."""

    @classmethod
    def name(cls) -> str:
        return "cellweave_dbf"

    def schema(self) -> T.StructType:
        path = next((p for p, _ in listed(self.options["path"]) if (self.options.get("as") or kind_of(p)) == "dbf"), None)
        if path is None:
            raise FileNotFoundError(f"No table under {self.options['path']}")
        *_, fields = table_header(path)
        own = [T.StructField(n, dbf_type(*f[1:4])) for n, f in zip(unique_names(fields), fields, strict=True)]
        return T.StructType([*own, T.StructField("_file", T.StringType()), T.StructField("_record", T.LongType()), T.StructField("_deleted", T.BooleanType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TableReader(dict(self.options), schema)


# sinks


@dataclass
class Written(WriterCommitMessage):
    """What one task has written, under names that don't count yet."""

    files: list[tuple[str, str]]


class _Folder(DataSourceWriter):
    """Files of tasks are written beside their place and take it on commit; an aborted job leaves none."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path.rstrip("/"), schema, overwrite
        self.held = f"_uncommitted-{uuid.uuid4().hex}"  # of this job

    def put(self, name: str, data: bytes | Iterator[bytes | pa.Buffer]) -> tuple[str, str]:
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"A name that leads out of the folder: {name}")
        fs, inner = resolve(self.path)
        held, place = f"{inner}/{self.held}/{uuid.uuid4().hex}", f"{inner}/{name}"
        fs.create_dir(f"{inner}/{self.held}", recursive=True)
        with fs.open_output_stream(held) as out:
            for piece in (data,) if isinstance(data, bytes) else data:
                out.write(piece)
        return held, place

    def commit(self, messages: list[Written | None]) -> None:
        fs, inner = resolve(self.path)
        fs.create_dir(inner, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(inner)):
                if not old.base_name.startswith("_"):
                    (fs.delete_file if old.is_file else fs.delete_dir)(old.path)
        for m in messages:
            for held, place in m.files if m else ():
                fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                fs.move(held, place)
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        fs, inner = resolve(self.path)
        if fs.get_file_info(f"{inner}/{self.held}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{inner}/{self.held}")


class FileWriter(_Folder, DataSourceArrowWriter):
    """Rows (name, content): a file each, written from the batch it came in."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files = []
        for b in batches:
            for name, content in zip(b.column("name"), b.column("content"), strict=True):
                files.append(self.put(name.as_py(), iter([content.as_buffer()] if content.is_valid else [])))
        return Written(files)


class JsonWriter(_Folder):
    """Lines of workbooks (workbook_id, sheet_idx, part, row_idx, item), sorted by these, as a JSON file a workbook.

    A workbook's file is written line by line while its rows come; see operators.workbooks.write_workbooks, which sorts them."""

    def write(self, rows: Iterator[T.Row]) -> Written:
        return Written([self.put(f"{name_of(key)}.json", json_pieces(some)) for key, some in groupby(rows, lambda r: r["workbook_id"])])


def name_of(key: object) -> str:
    """A file's name for a workbook: its own without folders, other signs as underscores."""
    return "".join(c if c.isalnum() or c in "-_." else "_" for c in str(key).rsplit("/", 1)[-1])


def json_pieces(rows: Iterator[T.Row]) -> Iterator[bytes]:
    """{"worksheets": [{part: [item, ...], ...}, ...]}: sheets and parts in the order in which they come."""
    yield b'{"worksheets": ['
    for i, (_, sheet) in enumerate(groupby(rows, lambda r: r["sheet_idx"])):
        yield b", {" if i else b"{"
        for j, (part, items) in enumerate(groupby(sheet, lambda r: r["part"])):
            yield ((", " if j else "") + json.dumps(part) + ": [").encode()
            for k, r in enumerate(items):
                yield ((",\n" if k else "") + r["item"]).encode()
            yield b"]"
        yield b"}"
    yield b"]}\n"


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, and let Spark hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(TableSource)


def write_files(files: DataFrame, path: str) -> None:
    """Files (name, content) under a folder."""
    register(files.sparkSession)
    files.select("name", "content").write.format("cellweave").mode("append").save(path)
