"""Zipped XML workbooks: Excel 2007+ and OpenDocument. Parts are unzipped in tasks and parsed by from_xml; cells of Excel sheets row by row."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.refs import range_coords
from cellweave.functions.text import clean_formula, stable_guid, with_equals
from cellweave.functions.units import length_px, width_px
from cellweave.sources.model import by_text, cells, streamed
from cellweave.sources.streams import DAMAGE, archive_damage, ods_cells, ods_rows, xlsx_parts_of, xlsx_stored, xlsx_strings_of
from cellweave.sources.xmlstream import Node, stream_nodes
from cellweave.sources.xmltext import bare_names

# Built-in number formats.
NUMBER_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy",
    15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)",
    38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
# Names of validation types and operators, and CSS of border lines.
VALIDATION_TYPES = {"whole": "number", "decimal": "number", "list": "list", "date": "date", "time": "time", "textLength": "textLength", "custom": "formula"}
OPERATORS = {"between": "between", "notBetween": "not between", "equal": "=", "notEqual": "!=", "greaterThan": ">", "lessThan": "<", "greaterThanOrEqual": ">=", "lessThanOrEqual": "<="}
BORDERS = {"thin": "1px solid", "medium": "2px solid", "thick": "3px solid", "dotted": "1px dotted", "dashed": "1px dashed", "double": "3px double", "mediumDashed": "2px dashed"}


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for p in values.items() for x in p))


def decoded(data: bytes) -> str:
    """A part's text by its byte-order mark; without one it is UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    return data.decode("utf-8", "replace")


def parts(docs: DataFrame, pattern: str, key: str = "doc_id", content: str = "content", only: tuple[str, set[str]] | None = None) -> DataFrame:
    """(workbook_id, part, xml): the parts of each archive whose name matches; prefixes of names are dropped.

    Only matching parts are unzipped. What is no archive has no parts. only: a root's name and elements; a part is then read as a stream
    and has these elements alone, so that a sheet's cells are not held for what stands beside them."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = re.compile(pattern)
        for b in batches:
            for k, data in zip(b["k"], b["c"], strict=True):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        for name in z.namelist():
                            if wanted.fullmatch(name) and only is not None:
                                with z.open(name) as f:
                                    out.append((k, name, f"<{only[0]}>{''.join(n.xml() for n in stream_nodes(f, only[1]))}</{only[0]}>"))
                            elif wanted.fullmatch(name):
                                out.append((k, name, bare_names(decoded(z.read(name)))))
                except DAMAGE:
                    pass
                yield pd.DataFrame(out, columns=["workbook_id", "part", "xml"])

    return docs.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(run, f"workbook_id {kind}, part string, xml string")


def parsed(p: DataFrame, tag: str, schema: str) -> DataFrame:
    return p.select("workbook_id", "part", F.from_xml("xml", schema, {"rowTag": tag, "ignoreSurroundingSpaces": "false"}).alias("x"))


# Excel 2007+

_T = "array<struct<t:string>>"


def text_of(item: str) -> Column:
    """Text of a string item: its own or that of its runs."""
    runs = F.array_join(F.transform(F.col(f"{item}.r"), lambda r: F.coalesce(r["t"], F.lit(""))), "")
    return F.coalesce(F.col(f"{item}.t"), runs)


def archived(docs: DataFrame, key: str, content: str, schema: str, read: Callable[[zipfile.ZipFile], Iterator[tuple]]) -> DataFrame:
    """(workbook_id, *schema): what read gives of each archive, in one pass; a damaged archive gives nothing."""

    def rows(data: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                out = list(read(z))
        except (*DAMAGE, KeyError):
            return
        yield from out

    return streamed(docs, key, content, schema, rows)


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple[int, str | None, str, str]]:
    """(place, name, state, part) of each sheet."""
    with z.open("xl/workbook.xml") as f:
        stored = list(stream_nodes(f, set(), {"sheet"}))
    for i, (node, part) in enumerate(zip(stored, xlsx_parts_of(z), strict=True)):
        yield i, node.attrib.get("name"), node.attrib.get("state", "visible"), part


def xlsx_worksheets(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, sheet_name, state, part): sheets by their relationship, not by their position."""
    return archived(docs, key, content, "sheet_idx int, sheet_name string, state string, part string", _sheets)


def xlsx_strings(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sst, text) of shared strings."""
    return archived(docs, key, content, "sst int, text string", lambda z: enumerate(xlsx_strings_of(z)))


#: What stands beside the cells of a sheet.
_BESIDE = {"cols", "mergeCells", "hyperlinks", "dimension", "sheetViews", "sheetProtection", "protectedRanges", "dataValidations", "conditionalFormatting"}
_SHEET = """cols struct<col:array<struct<_min:int,_max:int,_width:double,_hidden:string>>>,
mergeCells struct<mergeCell:array<struct<_ref:string>>>, hyperlinks struct<hyperlink:array<struct<_ref:string,_id:string,_location:string>>>,
dimension struct<_ref:string>, sheetViews struct<sheetView:array<struct<_showGridLines:string,_topLeftCell:string,pane:struct<_xSplit:double,_ySplit:double,_state:string>>>>, sheetProtection struct<_sheet:string>, protectedRanges struct<protectedRange:array<struct<_sqref:string,_name:string>>>,
dataValidations struct<dataValidation:array<struct<_type:string,_operator:string,_sqref:string,_allowBlank:string,_errorStyle:string,_prompt:string,formula1:string,formula2:string>>>,
conditionalFormatting array<struct<_sqref:string,cfRule:array<struct<_type:string,_operator:string,_text:string,_dxfId:int,_priority:int,formula:array<string>>>>>"""


def xlsx_sheets(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, sheet_name, state, part, x): what stands beside the cells of each sheet, as a nested value.

    One pass over each archive, without a shuffle; rows are passed over as they are read."""

    def sheets(z: zipfile.ZipFile) -> Iterator[tuple]:
        for i, name, state, part in _sheets(z):
            if part in z.namelist():
                with z.open(part) as f:
                    yield i, name, state, part, f"<worksheet>{''.join(n.xml() for n in stream_nodes(f, _BESIDE))}</worksheet>"

    s = archived(docs, key, content, "sheet_idx int, sheet_name string, state string, part string, xml string", sheets)
    return s.withColumn("x", F.from_xml("xml", _SHEET, {"rowTag": "worksheet", "ignoreSurroundingSpaces": "false"})).drop("xml")


_RAW = "sheet_idx int, row_idx int, col_idx int, xf int, t string, v string, f string, text string"


def xlsx_raw_cells(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, row_idx, col_idx, xf, t, v, f, text): cells as stored, with the text of their string.

    Each archive is first gone through without keeping anything; a damaged one has no cells, and reader.file_errors says why. Then its
    strings and its sheets are read row by row."""

    def cells_of(data: bytes) -> Iterator[tuple]:
        if archive_damage(data, "xlsx") is None:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                strings = xlsx_strings_of(z)
                for sheet, part in enumerate(xlsx_parts_of(z)):
                    yield from xlsx_stored(z, sheet, part, strings)

    return streamed(docs, key, content, _RAW, cells_of)


def scan_xlsx(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Cells of Excel 2007+ sheets with xf (style index). A formula's stored value stays beside it.

    Cells without a reference follow the one before; 0 is a number, inline strings are read, dates stay ISO text."""
    c = xlsx_raw_cells(docs, key, content)
    raw, t = F.col("v"), F.col("t")
    num = F.when(t == "n", raw.try_cast("double"))
    flag = F.when(t == "b", raw == "1")
    f = with_equals(clean_formula(F.col("f")))
    string = F.when(t.isin("s", "inlineStr"), F.col("text")).when(t.isin("str", "d", "e") | ((t == "n") & num.isNull()), raw)
    v_type = F.when(f.isNotNull(), "formula").when(num.isNotNull(), "number").when(flag.isNotNull(), "boolean").when(t == "e", "error").otherwise(by_text(string))
    return cells(c, "xf", kind=v_type, text=string, num=num, flag=flag, formula=f)


def xlsx_merges(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    m = xlsx_sheets(docs, key, content).select("workbook_id", "sheet_idx", F.explode("x.mergeCells.mergeCell._ref").alias("ref"))
    r = range_coords("ref")
    return m.select("workbook_id", "sheet_idx", F.substring_index("ref", ":", 1).alias("address"), r["y1"].alias("row_idx"), r["x1"].alias("col_idx"), (r["x2"] - r["x1"] + 1).alias("colspan"), (r["y2"] - r["y1"] + 1).alias("rowspan"))


def xlsx_columns(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, col_idx, width_px, visible): one row a column of each stored range."""
    c = xlsx_sheets(docs, key, content).select("workbook_id", "sheet_idx", F.explode("x.cols.col").alias("c"))
    c = c.select("workbook_id", "sheet_idx", "c", F.explode(F.sequence(F.col("c._min") - 1, F.col("c._max") - 1)).alias("col_idx"))
    return c.select("workbook_id", "sheet_idx", "col_idx", width_px(F.col("c._width"), F.lit("char")).alias("width_px"), (F.coalesce("c._hidden", F.lit("0")) != "1").alias("visible"))


def xlsx_views(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, gridlines, freeze_rows, freeze_cols, locked)."""
    v = F.col("x.sheetViews.sheetView")[0]
    frozen = v["pane"]["_state"].startswith("frozen")
    return xlsx_sheets(docs, key, content).select("workbook_id", "sheet_idx", (F.coalesce(v["_showGridLines"], F.lit("1")) != "0").alias("gridlines"), F.when(frozen, v["pane"]["_ySplit"].cast("int")).alias("freeze_rows"), F.when(frozen, v["pane"]["_xSplit"].cast("int")).alias("freeze_cols"), (F.coalesce("x.sheetProtection._sheet", F.lit("0")) == "1").alias("locked"))


def xlsx_protected(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, row_idx, col_idx): every cell of the protected ranges."""
    p = xlsx_sheets(docs, key, content).select("workbook_id", "sheet_idx", F.explode("x.protectedRanges.protectedRange._sqref").alias("refs"))
    r = range_coords("ref")
    p = p.select("workbook_id", "sheet_idx", F.explode(F.split("refs", " ")).alias("ref")).select("workbook_id", "sheet_idx", r.alias("r"))
    p = p.select("workbook_id", "sheet_idx", "r", F.explode(F.sequence("r.y1", "r.y2")).alias("row_idx"))
    return p.select("workbook_id", "sheet_idx", "row_idx", F.explode(F.sequence("r.x1", "r.x2")).alias("col_idx")).distinct()


def xlsx_validations(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, range, type, action, criteria, value, allow_blank): data validations; xlsx_parts has the conditional formats."""
    s = xlsx_sheets(docs, key, content)
    sheet = F.col("sheet_name")
    d = s.select("workbook_id", "sheet_name", F.explode("x.dataValidations.dataValidation").alias("d"))
    listed = F.transform(F.split(F.regexp_replace("d.formula1", '^"|"$', ""), ","), lambda v: F.trim(v))
    values = F.when((F.col("d._type") == "list") & F.col("d.formula1").startswith('"'), listed).otherwise(F.filter(F.array("d.formula1", "d.formula2"), lambda v: v.isNotNull()))
    d = d.select("workbook_id", F.concat(sheet, F.lit("!"), F.col("d._sqref")).alias("range"), F.element_at(literal_map(VALIDATION_TYPES), F.col("d._type")).alias("type"), F.when(F.col("d._errorStyle") == "warning", "warning").otherwise("reject").alias("action"), F.when(F.col("d._type").isin("list", "custom"), None).otherwise(F.element_at(literal_map(OPERATORS), F.coalesce("d._operator", F.lit("between")))).alias("criteria"), values.alias("value"), (F.coalesce("d._allowBlank", F.lit("0")) == "1").alias("allow_blank"))
    return d


def xlsx_names(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, name, refers_to) of defined names."""
    p = parsed(parts(docs, r"xl/workbook\.xml", key, content), "workbook", "definedNames struct<definedName:array<struct<_name:string,_VALUE:string>>>")
    n = p.select("workbook_id", F.explode("x.definedNames.definedName").alias("n"))
    return n.select("workbook_id", F.regexp_replace("n._name", r"^_\d*(xlnm|xleta|xlfn|xll|xlws|xlpm)\.", "").alias("name"), F.col("n._VALUE").alias("refers_to"))


# OpenDocument

_STORED = "sheet_idx int, row_idx int, col_idx int, v_type string, v_str string, v_num double, v_bool boolean, formula string, colspan int, rowspan int, style_name string, url string, comment string"


def scan_ods(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Cells of OpenDocument sheets, with colspan, rowspan, style_name, url and comment.

    Repeats move places on whatever their number, but only cells with content are given; a row or cell that repeats
    with content is given as often as stored. One pass, a row in memory at a time; a damaged archive has no cells."""

    def cells_of(data: bytes) -> Iterator[tuple]:
        if archive_damage(data, "ods") is None:
            with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("content.xml") as f:
                for c, cell in ods_cells(f):
                    link = next((a.attrib.get("href") for p in itertools.islice(c.all("p"), 1) for a in p.all("a")), None)
                    note = c.first("annotation")
                    comment = "\n".join(p.text() for p in note.all("p")) if note is not None else None
                    yield *cell, c.number("number-columns-spanned") or 1, c.number("number-rows-spanned") or 1, c.attrib.get("style-name"), link, comment

    return streamed(docs, key, content, _STORED, cells_of)


def ods_columns(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, col_idx, width_px): repeats laid out up to the last column that has a style or a cell, widths by style."""

    def columns(z: zipfile.ZipFile) -> Iterator[tuple]:
        widths, sheet, at = {}, -1, 0
        with z.open("content.xml") as f:
            for n in stream_nodes(f, {"style"}, {"table", "table-column"}):
                if n.name == "style":
                    own = n.first("table-column-properties")
                    widths[n.attrib.get("name")] = own.attrib.get("column-width") if own is not None else None
                elif n.name == "table":
                    sheet, at = sheet + 1, 0
                else:
                    times = n.number("number-columns-repeated") or 1
                    yield sheet, at, times, widths.get(n.attrib.get("style-name"))
                    at += times

    c = archived(docs, key, content, "sheet_idx int, first int, times int, width string", columns)
    c = c.withColumn("col_idx", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("times") - 1)))
    return c.select("workbook_id", "sheet_idx", "col_idx", F.coalesce(length_px(F.col("width")), F.lit(100.0)).alias("width_px"))


def ods_worksheets(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, sheet_name, state): hidden where the table's style isn't displayed."""

    def tables(z: zipfile.ZipFile) -> Iterator[tuple]:
        off, sheet = set(), 0
        with z.open("content.xml") as f:
            for n in stream_nodes(f, {"style"}, {"table"}):
                if n.name == "style":
                    own = n.first("table-properties")
                    if own is not None and own.attrib.get("display") == "false":
                        off.add(n.attrib.get("name"))
                else:
                    yield sheet, n.attrib.get("name", "Sheet1"), "hidden" if n.attrib.get("style-name") in off else "visible"
                    sheet += 1

    return archived(docs, key, content, "sheet_idx int, sheet_name string, state string", tables)


def ods_names(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, name, refers_to) of named ranges."""

    def names(z: zipfile.ZipFile) -> Iterator[tuple]:
        with z.open("content.xml") as f:
            for n in stream_nodes(f, set(), {"named-range"}):
                yield n.attrib.get("name"), n.attrib.get("cell-range-address")

    return archived(docs, key, content, "name string, refers_to string", names)


def _inside(node: Node, name: str) -> Node | None:
    """The first element of a name at any depth."""
    for x in node.content:
        if isinstance(x, Node):
            found = x if x.name == name else _inside(x, name)
            if found is not None:
                return found
    return None


def _ods_content(z: zipfile.ZipFile, name: str) -> Iterator[tuple[int, int, int, Node]]:
    """(sheet, row, column, element) of the elements of a name right in a cell, at the cell's first place."""
    with z.open("content.xml") as f:
        for sheet, row, _, node in ods_rows(f):
            col = 0
            for c in node.content:
                if isinstance(c, Node) and c.name in ("table-cell", "covered-table-cell"):
                    yield from ((sheet, row, col, x) for x in c.all(name))
                    col += c.number("number-columns-repeated") or 1


def ods_media(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, row_idx, col_idx, nth, kind, href, left, top, width, height, z_index, id): images and charts in frames, with the
    cell that they are anchored to; id is the same whenever it is computed. Lengths are in pixels, 0 where none is stored."""

    def media(z: zipfile.ZipFile) -> Iterator[tuple]:
        for nth, (sheet, row, col, frame) in enumerate(_ods_content(z, "frame")):
            for kind, name in (("chart", "object"), ("image", "image")):  # an image beside a chart is the chart's own picture
                found = _inside(frame, name)
                if found is not None:
                    yield sheet, row, col, nth, kind, found.attrib.get("href"), *(frame.attrib.get(a, "0") for a in ("x", "y", "width", "height")), frame.number("z-index") or 0
                    break

    schema = "sheet_idx int, row_idx int, col_idx int, nth int, kind string, href string, x string, y string, w string, h string, z_index int"
    m = archived(docs, key, content, schema, media)
    sizes = [F.coalesce(length_px(F.col(c)), F.lit(0.0)).alias(name) for c, name in zip("xywh", ("left", "top", "width", "height"), strict=True)]
    return m.select("workbook_id", "sheet_idx", "row_idx", "col_idx", "nth", "kind", "href", *sizes, "z_index", stable_guid(F.col("workbook_id"), F.col("sheet_idx"), F.col("nth")).alias("id"))


def ods_comments(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, row_idx, col_idx, author, date, text, visible) of annotations; author and date by attribute or element."""

    def comments(z: zipfile.ZipFile) -> Iterator[tuple]:
        for sheet, row, col, a in _ods_content(z, "annotation"):
            author, date = a.first("creator"), a.first("date")
            text = "\n".join(p.text() for p in a.all("p"))
            yield sheet, row, col, a.attrib.get("author") or (author.text() if author else ""), a.attrib.get("date") or (date.text() if date else ""), text, a.attrib.get("display") == "true"

    return archived(docs, key, content, "sheet_idx int, row_idx int, col_idx int, author string, date string, text string, visible boolean", comments)
