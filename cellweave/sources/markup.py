"""Markup: HTML tables and SpreadsheetML 2003."""

from __future__ import annotations

import io
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.functions.refs import cell_name
from cellweave.functions.text import with_equals
from cellweave.operators.relational import style_dictionary
from cellweave.sources.model import by_text, cells, streamed
from cellweave.sources.streams import spreadsheetml
from cellweave.sources.xmlstream import Node, fault, stream_nodes

_TAGS = "table_idx int, row_idx int, col_idx int, value string, formula string, colspan int, rowspan int, css string, comment string, head_value string, head_formula string"


class _Tables(HTMLParser):
    """Collects the cells of all tables of a text, with the place that each has in the markup."""

    SECTIONS = {"thead": 0, "tbody": 1, "tfoot": 2}

    def __init__(self) -> None:
        super().__init__()
        self.out, self.open, self.n, self.mute = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.mute += 1
        elif tag == "table":
            self.open.append({"i": self.n, "s": 1, "part": 0, "parts": {}, "tr": -1, "cell": None, "pos": 0})
            self.n += 1
        elif self.open:
            t = self.open[-1]
            if tag in self.SECTIONS:
                t["s"] = self.SECTIONS[tag]
                t["part"] = t["parts"].get(tag, 0)
                t["parts"][tag] = t["part"] + 1
            elif tag == "tr":
                t["tr"] += 1
            elif tag in ("td", "th"):
                span = [max(1, int(v)) if (v := a.get(k) or "1").isascii() and v.isdigit() else 1 for k in ("colspan", "rowspan")]
                t["cell"] = [t["i"], t["s"], t["part"], max(t["tr"], 0), int(tag == "td"), t["pos"], "", a.get("data-formula"), *span, a.get("style"), a.get("title")]
                t["pos"] += 1
                self.out.append(t["cell"])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th") and self.open:
            self.open[-1]["cell"] = None
        elif tag in ("thead", "tfoot") and self.open:
            self.open[-1]["s"], self.open[-1]["part"] = 1, 0

    def handle_data(self, data):
        for t in self.open if not self.mute else ():
            if t["cell"] is not None:
                t["cell"][6] += data


class Skyline:
    """Down to which row each column is taken by spans from above: disjoint intervals of columns, in order, each with its first free row.

    An interval stands for all its columns, so that a span costs what it borders on, not the slots it covers."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, int]] = []  # first column, column after the last, first free row

    def free(self, row: int, col: int) -> int:
        """The first column from this one on that is free in a row."""
        k = max(bisect_right(self.starts, col) - 1, 0)
        while k < len(self.spans) and self.spans[k][0] <= col:
            _, end, until = self.spans[k]
            if col < end and until > row:
                col = end
            k += 1
        return col

    def raise_to(self, start: int, end: int, until: int, row: int) -> None:
        """Take the columns from start up to end until a row; where they are taken for longer that stays. Spans over before this row go."""
        a = max(bisect_right(self.starts, start) - 1, 0)
        z = bisect_left(self.starts, end)
        laid, at = [], start
        for lo, hi, old in self.spans[a:z]:
            if hi <= start:
                if old > row:
                    laid.append((lo, hi, old))
                continue
            if lo < start:
                laid.append((lo, start, old))
            if lo > at:
                laid.append((at, lo, until))
            laid.append((max(lo, start), min(hi, end), max(old, until)))
            if hi > end:
                laid.append((end, hi, old))
            at = min(hi, end)
        if at < end:
            laid.append((at, end, until))
        self.spans[a:z] = laid
        self.starts[a:z] = [x[0] for x in laid]


def _placed(cells: list[list]) -> Iterator[tuple[list, int, int]]:
    """Each cell of a table with its row and column: past slots that spans of earlier rows take; a row's th stand before its td."""
    at = {key: i for i, key in enumerate(sorted({(c[1], c[3]) for c in cells}))}
    above, row, col = Skyline(), -1, 0
    for c in sorted(cells, key=lambda c: (c[1], c[3], c[4], c[5])):
        if at[c[1], c[3]] != row:
            row, col = at[c[1], c[3]], 0
        col = above.free(row, col)
        yield c, row, col
        if c[9] > 1:
            above.raise_to(col, col + c[8], row + c[9], row)
        col += c[8]


def laid_out(text: str | None) -> Iterator[tuple[int, list[tuple[list, int, int]]]]:
    """(table, its cells in their places) of each table of a document: the head, the first body and the foot."""
    reader = _Tables()
    reader.feed(text or "")
    tables: dict[int, list] = {}
    for c in reader.out:
        if c[2] == 0:
            tables.setdefault(c[0], []).append(c)
    for table, cells in tables.items():
        yield table, list(_placed(cells))


def html_cells(docs: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(workbook_id, table_idx, row_idx, col_idx, ...) of every cell in its place, with the value and formula of the first row's cell there.

    Rows of the head come first, then those of the first body, then those of the foot; other bodies are left out.
    A document is read and laid out in one pass, without a shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b["k"], b["h"], strict=True):
                for _, placed in laid_out(text):
                    head = {col: (c[6], c[7]) for c, row, col in placed if row == 0}
                    rows += [(k, c[0], row, col, *c[6:], *head.get(col, (None, None))) for c, row, col in placed]
            yield pd.DataFrame(rows, columns=["workbook_id", *(c.split()[0] for c in _TAGS.split(", "))])

    return docs.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"workbook_id {kind}, {_TAGS}")


def scan_html(docs: DataFrame, key: str = "doc_id", html: str = "html", table_index: int | None = 0, first_row_as_header: bool = True) -> DataFrame:
    """Cells of one table of each document, or of all (table_index None; the sheet is then the table).

    Columns beside the cell model: title (of the column, from the first row), colspan, rowspan, css, comment.
    With a header, its row is left out and the others move up. A document without that table has no rows."""
    t = html_cells(docs, key, html)
    if table_index is not None:
        t = t.where(F.col("table_idx") == table_index)
    t = t.withColumn("sheet_idx", F.col("table_idx") if table_index is None else F.lit(0))

    def bare(value: str) -> Column:
        return F.trim(F.regexp_replace(value, r"^\s+|\s+$", ""))

    t = t.withColumn("v", bare("value")).withColumn("f", with_equals(F.col("formula")))
    title = F.nullif(F.coalesce(with_equals(F.col("head_formula")), bare("head_value")), F.lit(""))
    if first_row_as_header:
        t = t.where("row_idx > 0").withColumn("row_idx", F.col("row_idx") - 1).withColumn("title", title)
    else:
        t = t.withColumn("title", F.lit(None).cast("string"))
    kind = F.when(F.col("f").isNotNull(), "formula").otherwise(by_text(F.col("v")))
    return cells(t, "title", "colspan", "rowspan", "css", "comment", kind=kind, text=F.col("v"), formula=F.col("f"))


def merges(t: DataFrame) -> DataFrame:
    """(workbook_id, sheet_idx, address, row_idx, col_idx, colspan, rowspan) of cells that span more than one slot."""
    return t.where("colspan > 1 or rowspan > 1").select("workbook_id", "sheet_idx", cell_name("col_idx", "row_idx").alias("address"), "row_idx", "col_idx", "colspan", "rowspan")


def spanned_slots(t: DataFrame) -> DataFrame:
    """(workbook_id, sheet_idx, row_idx, col_idx, of_row, of_col): the slots that spans cover beside their own cell, also below the last row."""
    m = t.where("colspan > 1 or rowspan > 1").select("workbook_id", "sheet_idx", F.col("row_idx").alias("of_row"), F.col("col_idx").alias("of_col"), "colspan", "rowspan")
    m = m.withColumn("row_idx", F.explode(F.sequence("of_row", F.col("of_row") + F.col("rowspan") - 1)))
    m = m.withColumn("col_idx", F.explode(F.sequence("of_col", F.col("of_col") + F.col("colspan") - 1)))
    return m.where("row_idx > of_row or col_idx > of_col").select("workbook_id", "sheet_idx", "row_idx", "col_idx", "of_row", "of_col")


_TABLE = "struct<_DefaultColumnWidth:double,_DefaultRowHeight:double,Column:array<struct<_Index:int,_Width:double,_Span:int,_Hidden:string>>,Row:array<struct<_Index:int,_Height:double,_Hidden:string>>>"
_OPTIONS = "struct<FreezePanes:string,SplitHorizontal:int,SplitVertical:int,DoNotDisplayGridlines:string,Visible:string,ProtectObjects:string,ProtectScenarios:string,EnableSelection:string>"
_STYLE = "struct<_ID:string,_Name:string,Alignment:struct<_Horizontal:string,_Vertical:string,_WrapText:string>,Borders:struct<Border:array<struct<_Position:string,_LineStyle:string,_Weight:string,_Color:string>>>,Font:struct<_FontName:string,_Size:double,_Bold:string,_Italic:string,_Underline:string,_Color:string>,Interior:struct<_Color:string,_Pattern:string>,NumberFormat:struct<_Format:string>>"
_NAMES = "struct<NamedRange:array<struct<_Name:string,_RefersTo:string>>>"
_BOOK = f"Styles struct<Style:array<{_STYLE}>>, Names {_NAMES}, Worksheet array<struct<_Name:string,_Visible:string,Table:{_TABLE},WorksheetOptions:{_OPTIONS}>>"


def _without_cells(text: str) -> Iterator[tuple[str]]:
    """A workbook's text with local names only, rows without cells; nothing if it isn't well formed."""
    if fault(io.BytesIO(text.encode("utf-8", "replace")), encoding="utf-8"):
        return
    head, sheets = [], []
    for n in stream_nodes(text, {"Styles", "Names", "Column", "WorksheetOptions"}, {"Worksheet", "Table", "Row"}):
        if n.name == "Worksheet":
            sheets.append((n, Node("Table", {})))
        elif not sheets:
            head.append(n)
        elif n.name == "Table":
            sheets[-1][1].attrib.update(n.attrib)
        else:
            (sheets[-1][0] if n.name == "WorksheetOptions" else sheets[-1][1]).content.append(n)
    for sheet, own in sheets:
        sheet.content.append(own)
    yield (f"<Workbook>{''.join(n.xml() for n in (*head, *(s for s, _ in sheets)))}</Workbook>",)


def xml_books(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(workbook_id, b): what each SpreadsheetML text has beside its cells, as a nested value."""
    t = streamed(docs, key, xml, "xml string", _without_cells)
    return t.select("workbook_id", F.from_xml("xml", _BOOK, {"rowTag": "Workbook", "ignoreSurroundingSpaces": "false"}).alias("b"))


def _placed_by_index(df: DataFrame, keys: list[str], order: str, index: str, out: str, width: str | None = None) -> DataFrame:
    """0-based places of elements that follow one another, or jump to a 1-based index; width: places an element takes."""
    over = W.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_step", F.count(index).over(over.rowsBetween(W.unboundedPreceding, 0)))
    group = W.partitionBy(*keys, "_step").orderBy(order)
    size = F.lit(1) if width is None else F.col(width)
    gone = F.coalesce(F.sum(size).over(group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn(out, (F.coalesce(F.first(index, True).over(group.rowsBetween(W.unboundedPreceding, 0)), F.lit(1)) - 1 + gone).cast("int")).drop("_step")


_STORED = "sheet_idx int, row_idx int, col_idx int, v_type string, v_str string, v_num double, v_bool boolean, formula string, style_id string, colspan int, rowspan int, comment string"


def scan_xml2003(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """Cells of SpreadsheetML 2003, with style_id, colspan, rowspan and comment. Index attributes jump ahead.

    One pass over the text, a row in memory at a time. Text that isn't well formed has no cells."""

    def cells_of(text: str) -> Iterator[tuple]:
        if fault(io.BytesIO(text.encode("utf-8", "replace")), encoding="utf-8"):
            return
        for c, cell in spreadsheetml(text):
            note = c.first("Comment")
            data = note.first("Data") if note is not None else None
            yield *cell, c.attrib.get("StyleID"), (c.number("MergeAcross") or 0) + 1, (c.number("MergeDown") or 0) + 1, data.text() if data is not None else None

    return streamed(docs, key, xml, _STORED, cells_of)


def xml_worksheets(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(workbook_id, sheet_idx, sheet_name, state, freeze_rows, freeze_cols, gridlines, default_width, default_height)."""
    s = xml_books(docs, key, xml).select("workbook_id", F.posexplode("b.Worksheet").alias("sheet_idx", "w"))
    o, frozen = "w.WorksheetOptions", F.col("w.WorksheetOptions.FreezePanes").isNotNull()
    state = F.when((F.col("w._Visible") == "0") | (F.col(f"{o}.Visible") == "SheetHidden"), "hidden").when(F.col(f"{o}.Visible") == "SheetVeryHidden", "veryHidden").otherwise("visible")
    return s.select(
        "workbook_id", "sheet_idx", F.coalesce("w._Name", F.lit("Sheet1")).alias("sheet_name"), state.alias("state"), F.when(frozen, F.col(f"{o}.SplitHorizontal")).alias("freeze_rows"), F.when(frozen, F.col(f"{o}.SplitVertical")).alias("freeze_cols"),
        F.col(f"{o}.DoNotDisplayGridlines").isNull().alias("gridlines"), F.col("w.Table._DefaultColumnWidth").alias("default_width"), F.col("w.Table._DefaultRowHeight").alias("default_height"),
        (F.lower(f"{o}.ProtectObjects") == "true").alias("protect_objects"), (F.lower(f"{o}.ProtectScenarios") == "true").alias("protect_scenarios"), F.col(f"{o}.EnableSelection").alias("enable_selection"),
    )


def xml_columns(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(workbook_id, sheet_idx, col_idx, width, visible): an index jumps ahead, a span repeats; columns between have no row here."""
    c = xml_books(docs, key, xml).select("workbook_id", F.posexplode("b.Worksheet").alias("sheet_idx", "w")).select("workbook_id", "sheet_idx", F.posexplode("w.Table.Column").alias("p", "c"))
    c = c.withColumn("i", F.col("c._Index")).withColumn("times", F.coalesce("c._Span", F.lit(0)) + 1)
    c = _placed_by_index(c, ["workbook_id", "sheet_idx"], "p", "i", "first", "times")
    c = c.withColumn("col_idx", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("times") - 1)))
    return c.select("workbook_id", "sheet_idx", F.col("col_idx").cast("int").alias("col_idx"), F.coalesce("c._Width", F.lit(100.0)).alias("width"), (F.coalesce("c._Hidden", F.lit("0")) != "1").alias("visible"))


def xml_rows(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(workbook_id, sheet_idx, row_idx, height, visible) of stored rows; height is null where none is stored."""
    r = xml_books(docs, key, xml).select("workbook_id", F.posexplode("b.Worksheet").alias("sheet_idx", "w")).select("workbook_id", "sheet_idx", F.posexplode("w.Table.Row").alias("p", "r"))
    r = _placed_by_index(r.withColumn("i", F.col("r._Index")), ["workbook_id", "sheet_idx"], "p", "i", "row_idx")
    return r.select("workbook_id", "sheet_idx", "row_idx", F.col("r._Height").alias("height"), (F.coalesce("r._Hidden", F.lit("0")) != "1").alias("visible"))


# Formats that have a mask of their own, and CSS lines of border styles.
MASKS = {
    "yyyy-mm-dd": "YYYY-MM-DD", "dd/mm/yyyy": "DD/MM/YYYY", "mm/dd/yyyy": "MM/DD/YYYY", "dd-mmm-yy": "DD-MMM-YY", "dddd, mmmm dd, yyyy": "dddd, MMMM DD, YYYY",
}
LINES = {"Continuous": "solid", "Dash": "dashed", "Dot": "dotted", "DashDot": "dashed", "DashDotDot": "dashed", "SlantDashDot": "dashed", "Double": "double"}


def format_mask(stored: Column) -> Column:
    """A number format as a mask: dates by MASKS, else without currency codes, escapes and quotes; scientific ones in upper case."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(stored, r"\[\$[^\]]+\]", ""), "_;", ""), r"[\\\"]", "")
    bare = F.nullif(F.trim(bare), F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in MASKS.items() for x in p)), stored), F.when(bare.rlike(r"(?i)^0\.0+E\+00$"), F.upper(bare)).otherwise(bare))


def xml_names(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(workbook_id, name, refers_to) of named ranges, without internal prefixes and equals signs."""
    n = xml_books(docs, key, xml).select("workbook_id", F.explode("b.Names.NamedRange").alias("n"))
    return n.select("workbook_id", F.regexp_replace("n._Name", r"^_\d*(xlnm|xleta|xlfn|xll|xlws|xlpm)\.", "").alias("name"), F.regexp_replace("n._RefersTo", "^=", "").alias("refers_to"))


def xml_styles(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(workbook_id, style_id, css, mask) of the styles; a border of weight 0 is a pixel wide, one of style None isn't drawn."""
    s = xml_books(docs, key, xml).select("workbook_id", F.explode("b.Styles.Style").alias("s"))

    def prop(name: str, value) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value))

    font, at = "s.Font", "s.Alignment"

    def edge(position: str) -> Column:
        b = F.get(F.filter("s.Borders.Border", lambda x: F.lower(x["_Position"]) == position), F.lit(0))
        line = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in LINES.items() for x in p)), b["_LineStyle"]), F.lit("solid"))
        width = F.greatest(F.coalesce(b["_Weight"].try_cast("int"), F.lit(1)), F.lit(1))
        return F.when(b.isNotNull() & (F.coalesce(b["_LineStyle"], F.lit("")) != "None"), F.concat(F.lit(f"border-{position}: "), width, F.lit("px "), line, F.lit(" "), F.coalesce(b["_Color"], F.lit("#000000"))))

    upright = F.lower(f"{at}._Vertical")
    parts = [
        prop("font-family", F.col(f"{font}._FontName")), prop("font-size", F.concat(F.regexp_replace(F.col(f"{font}._Size").cast("string"), r"\.0$", ""), F.lit("pt"))),
        F.when(F.col(f"{font}._Bold") == "1", F.lit("font-weight: bold")), F.when(F.col(f"{font}._Italic") == "1", F.lit("font-style: italic")),
        F.when(F.col(f"{font}._Underline").isNotNull(), F.lit("text-decoration: underline")), prop("color", F.col(f"{font}._Color")), prop("background-color", F.col("s.Interior._Color")), *(edge(p) for p in ("left", "right", "top", "bottom", "diagonal")),
        prop("text-align", F.lower(f"{at}._Horizontal")), prop("vertical-align", F.when(upright.isin("top", "bottom"), upright).when(upright.isNotNull(), "middle")), F.when(F.col(f"{at}._WrapText") == "1", F.lit("white-space: pre-wrap")),
    ]
    return s.select("workbook_id", F.col("s._ID").alias("style_id"), F.concat_ws("; ", *parts).alias("css"), format_mask(F.col("s.NumberFormat._Format")).alias("mask"))


def xml_styled_cells(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(styles, cells): cells with css, mask and style_idx, styles numbered by first appearance."""
    cells = scan_xml2003(docs, key, xml).join(xml_styles(docs, key, xml), ["workbook_id", "style_id"], "left")
    return style_dictionary(cells.withColumn("css", F.nullif("css", F.lit(""))))
