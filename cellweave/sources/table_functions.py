"""Scans as table functions of SQL.

    register(spark)
    SELECT d.doc_id, c.row_idx, c.v_str FROM documents d, LATERAL scan_cells(d.text, 'csv') c
    SELECT p.page_id, c.* FROM pages p, LATERAL scan_cells(p.html, 'html', columns => 'row_idx, v_str, title') c
    SELECT * FROM sheet_rows(TABLE(SELECT workbook_id, sheet_idx, row_idx, col_idx, v_str FROM cells) PARTITION BY (workbook_id, sheet_idx) ORDER BY (row_idx, col_idx))
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from cellweave.sources import streams
from cellweave.sources.compound import Compound
from cellweave.sources.encodings import detect, detect_dif

_KINDS = {"int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
#: Columns of every format, and those that markup has besides.
COLUMNS = {"sheet_idx": "int", "row_idx": "int", "col_idx": "int", "v_type": "string", "v_str": "string", "v_num": "double", "v_bool": "boolean", "formula": "string"}
MORE = {"title": "string", "colspan": "int", "rowspan": "int", "css": "string", "comment": "string"}
TEXTS = {"csv", "tsv", "dif", "slk", "xml", "html"}
#: Format of each extension.
EXTENSIONS = {**{f: f for f in ("csv", "tsv", "dif", "slk", "xml", "html", "dbf", "xls", "xlsx", "ods")}, "tab": "tsv", "txt": "tsv", "sylk": "slk", "htm": "html", **dict.fromkeys(("wks", "wk1", "wk3", "wk4", "123"), "lotus")}
FORMATS = TEXTS | {"dbf", "lotus", "xls", "xlsx", "ods"}


def _constant(arg: AnalyzeArgument | None, name: str, default: str | None = None) -> str:
    if arg is None and default is not None:
        return default
    if arg is None or not isinstance(arg.value, str):
        raise ValueError(f"scan_cells: {name} must be a constant string")
    return arg.value


def sound_cells(content: str | bytes, form: str, delimiter: str = ",") -> Iterator[tuple]:
    """Cells of one value, those of markup with the further columns. An error of streams.DAMAGE where it is damaged, archives before any cell."""
    if form in TEXTS and not isinstance(content, str):
        content = bytes(content).decode((detect_dif if form == "dif" else detect)(bytes(content)), "replace").removeprefix("\ufeff")
    if form in ("csv", "tsv"):
        yield from streams.csv_cells(content, "\t" if form == "tsv" else delimiter)
    elif form == "dif":
        yield from streams.dif_cells(content)
    elif form == "slk":
        yield from streams.sylk_cells(content)
    elif form == "html":
        yield from html_rows(content)
    elif form == "xml":
        if wrong := streams.fault(io.BytesIO(content.encode("utf-8", "replace")), encoding="utf-8"):
            raise ValueError(wrong)
        yield from (cell for _, cell in streams.spreadsheetml(content))
    elif form == "dbf":
        if len(content) < 32:
            raise ValueError("Too short for a table header")
        yield from streams.dbf_cells(io.BytesIO(content))
    elif form == "lotus":
        if bytes(content[:2]) != b"\0\0":
            raise ValueError("Not a worksheet of this kind")
        yield from streams.lotus_cells(io.BytesIO(content))
    elif form == "xls":
        book = Compound(io.BytesIO(content))
        entry = book.find("Workbook", "Book")
        if entry is None:
            raise ValueError("No workbook stream")
        data = book.read(entry)
        strings = streams.xls_strings(data)
        for i, at in enumerate(streams.xls_sheets(data)):
            yield from streams.xls_cells(data, i, at, strings)
    else:
        if wrong := streams.archive_damage(content, form):
            raise ValueError(wrong)
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if form == "ods":
                with z.open("content.xml") as f:
                    yield from (cell for _, cell in streams.ods_cells(f))
                return
            strings = streams.xlsx_strings_of(z)
            for i, part in enumerate(streams.xlsx_parts_of(z)):
                yield from (streams.xlsx_cell(*one) for one in streams.xlsx_stored(z, i, part, strings))


def cells_of(content: str | bytes, form: str, delimiter: str = ",") -> Iterator[tuple]:
    """sound_cells up to the damage, if there is any."""
    try:
        yield from sound_cells(content, form, delimiter)
    except streams.DAMAGE:
        return


def html_rows(text: str) -> Iterator[tuple]:
    """Cells of all tables; the sheet is the table. The first row gives the titles and is no row of its own."""
    from cellweave.sources.markup import laid_out

    for table, placed in laid_out(text):
        head = {col: streams.with_equals(c[7]) or c[6].strip() or None for c, row, col in placed if row == 0}
        for c, row, col in placed:
            if row > 0:
                v, f = c[6].strip(), streams.with_equals(c[7])
                yield table, row - 1, col, "formula" if f else "string" if v else "empty", v, None, None, f, head.get(col), *c[8:12]


@udtf
class ScanCells:
    """scan_cells(content, form, columns, delimiter): the cells of one value, as text or bytes. form and columns are constants, and the
    result has the columns named, of those that the format has; none named: all of them. A null value has no cells."""

    @staticmethod
    def analyze(content: AnalyzeArgument, form: AnalyzeArgument, columns: AnalyzeArgument | None = None, delimiter: AnalyzeArgument | None = None) -> AnalyzeResult:
        kind = _constant(form, "form")
        if kind not in FORMATS:
            raise ValueError(f"scan_cells: no format {kind!r}; there are {', '.join(sorted(FORMATS))}")
        known = COLUMNS | (MORE if kind == "html" else {})
        names = [c.strip() for c in _constant(columns, "columns", ",".join(known)).split(",")]
        if wrong := [n for n in names if n not in known]:
            raise ValueError(f"scan_cells: {kind} has no column {', '.join(wrong)}")
        if not isinstance(content.dataType, (T.StringType, T.BinaryType)) or kind not in TEXTS and not isinstance(content.dataType, T.BinaryType):
            raise ValueError(f"scan_cells: {kind} can't be read from {content.dataType.simpleString()}")
        return AnalyzeResult(T.StructType([T.StructField(n, _KINDS[known[n]]) for n in names]))

    def eval(self, content, form, columns=None, delimiter=","):
        if content is None:
            return
        known = [*COLUMNS, *(MORE if form == "html" else ())]
        take = [known.index(c.strip()) for c in columns.split(",")] if columns else range(len(known))
        for cell in cells_of(content, form, delimiter or ","):
            yield tuple(cell[i] for i in take)


@udtf
class SheetRows:
    """sheet_rows(TABLE(cells) PARTITION BY (workbook_id, sheet_idx) ORDER BY (row_idx, col_idx)): each sheet's rows as arrays, holes as ''.

    cells has the columns workbook_id, sheet_idx, row_idx, col_idx and one value. Rows are given as they end; only one is held."""

    @staticmethod
    def analyze(cells: AnalyzeArgument) -> AnalyzeResult:
        names = [f.name for f in cells.dataType] if cells.isTable else []
        if names[:4] != ["workbook_id", "sheet_idx", "row_idx", "col_idx"] or len(names) != 5:
            raise ValueError("sheet_rows: a table of workbook_id, sheet_idx, row_idx, col_idx and a value is wanted")
        own = [T.StructField(n, cells.dataType[n].dataType) for n in names[:3]]
        return AnalyzeResult(T.StructType([*own, T.StructField("cells", T.ArrayType(T.StringType()))]))

    def __init__(self):
        self.key, self.row = None, []

    def eval(self, cells):
        key = (cells[0], cells[1], cells[2])
        if self.key is not None and key != self.key:
            yield *self.key, self.row
            self.row = []
        self.key = key
        self.row += [""] * (cells[3] + 1 - len(self.row))
        self.row[cells[3]] = "" if cells[4] is None else str(cells[4])

    def terminate(self):
        if self.key is not None:
            yield *self.key, self.row


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    spark.udtf.register("scan_cells", ScanCells)
    spark.udtf.register("sheet_rows", SheetRows)
