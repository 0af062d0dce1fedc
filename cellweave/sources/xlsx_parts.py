"""What an Excel 2007+ sheet has beside its cells: relationships, comments, links, rows, styles, rules and drawings."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.functions.palettes import scheme_color, sheet_color
from cellweave.functions.refs import cell_name, range_coords
from cellweave.functions.text import clean_formula
from cellweave.functions.units import emu_px, half_up, number_prefix
from cellweave.operators.relational import bounding_box, bounds, styled, validation_union
from cellweave.sources.streams import whole_number, xlsx_parts_of
from cellweave.sources.xmlstream import stream_nodes
from cellweave.sources.zipped import BORDERS, NUMBER_FORMATS, OPERATORS, archived, literal_map, parsed, parts, scan_xlsx, text_of, xlsx_merges, xlsx_sheets, xlsx_worksheets

SHEET = ["workbook_id", "sheet_idx"]
# Kinds of images by extension, names of drawn shapes, text rules, chart kinds and places of legends.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml"}
SHAPES = {
    "rect": "rectangle", "roundRect": "rounded-rectangle", "triangle": "triangle", "rtTriangle": "right-triangle", "ellipse": "ellipse", "diamond": "diamond",
    "trapezoid": "trapezium", "pentagon": "pentagon", "hexagon": "hexagon", "octagon": "octagon", "parallelogram": "parallelogram", "rightArrow": "right-arrow",
    "leftArrow": "left-arrow", "upArrow": "up-arrow", "downArrow": "down-arrow", "star5": "star", "heart": "heart", "cloud": "cloud", "line": "line",
    "plus": "cross", "leftRightArrow": "left-right-arrow", "upDownArrow": "up-down-arrow", "smileyFace": "smiley-face",
}
TEXT_RULES = {"containsText": "contains", "notContainsText": "not contains", "beginsWith": "begins with", "endsWith": "ends with"}
SIMPLE_RULES = {"containsBlanks": "empty", "notContainsBlanks": "notEmpty"}
CHARTS = ("bar", "line", "pie", "doughnut", "area", "scatter", "radar")
LEGENDS = {"r": "right", "l": "left", "t": "top", "b": "bottom", "tr": "top"}
#: Pixels of a column and a row where an anchor gives cells only; the height of a row that stores none.
CELL_WIDTH, CELL_HEIGHT, ROW_HEIGHT = 64, 20, 21


def xlsx_rels(docs: DataFrame, folder: str, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, part, rid, kind, target) of the relationships of the parts in a folder; targets are whole part names."""
    p = parsed(parts(docs, rf"{folder}/_rels/[^/]+\.rels", key, content), "Relationships", "Relationship array<struct<_Id:string,_Type:string,_Target:string,_TargetMode:string>>")
    r = p.select("workbook_id", F.regexp_replace("part", r"_rels/([^/]+)\.rels$", "$1").alias("part"), F.explode("x.Relationship").alias("r"))
    inside = F.concat(F.regexp_replace("part", "[^/]+$", ""), F.col("r._Target"))
    inside = F.regexp_replace(F.regexp_replace(inside, r"[^/]+/\.\./", ""), r"[^/]+/\.\./", "")
    target = F.when(F.col("r._TargetMode") == "External", F.col("r._Target")).when(F.col("r._Target").startswith("/"), F.substring("r._Target", 2, 1 << 10)).otherwise(inside)
    return r.select("workbook_id", "part", F.col("r._Id").alias("rid"), F.substring_index("r._Type", "/", -1).alias("kind"), target.alias("target"))


def xlsx_sheet_comments(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, address, text) of comments that hold text, on the sheet whose relationships name their part."""
    p = parsed(parts(docs, r"xl/(?:.*/)?comments[^/]*\.xml", key, content), "comments", "commentList struct<comment:array<struct<_ref:string,text:struct<t:string,r:array<struct<t:string>>>>>>")
    c = p.select("workbook_id", F.col("part").alias("target"), F.explode("x.commentList.comment").alias("c"))
    r = xlsx_rels(docs, "xl/worksheets", key, content).join(xlsx_worksheets(docs, key, content).select(*SHEET, "part"), ["workbook_id", "part"])
    return c.join(r, ["workbook_id", "target"]).select(*SHEET, F.col("c._ref").alias("address"), text_of("c.text").alias("text")).where("text <> ''")


def xlsx_hyperlinks(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, address, url): the target of a link's relationship, or its place in the workbook."""
    h = xlsx_sheets(docs, key, content).select(*SHEET, "part", F.explode("x.hyperlinks.hyperlink").alias("h"))
    h = h.select(*SHEET, "part", F.col("h._ref").alias("address"), F.col("h._id").alias("rid"), F.col("h._location").alias("location"))
    h = h.join(xlsx_rels(docs, "xl/worksheets", key, content).drop("kind"), ["workbook_id", "part", "rid"], "left")
    return h.select(*SHEET, "address", F.when(F.col("rid").isNotNull(), F.col("target")).otherwise(F.col("location")).alias("url")).where("url is not null and address is not null")


def xlsx_rows(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, row_idx, height, visible) of stored rows; their cells are passed over."""

    def rows(z: zipfile.ZipFile) -> Iterator[tuple]:
        for sheet, part in enumerate(xlsx_parts_of(z)):
            if part in z.namelist():
                with z.open(part) as f:
                    for p, r in enumerate(stream_nodes(f, set(), {"row"})):
                        yield sheet, (r.number("r") or p + 1) - 1, whole_number(r.attrib.get("ht")), r.attrib.get("hidden", "0") not in ("1", "true")

    r = archived(docs, key, content, "sheet_idx int, row_idx int, height double, visible boolean", rows)
    return r.select(*SHEET, "row_idx", F.coalesce("height", F.lit(float(ROW_HEIGHT))).alias("height"), "visible")


def xlsx_dimensions(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, max_row, max_col): the end of each sheet's stated dimension."""
    d = xlsx_sheets(docs, key, content).where("x.dimension._ref is not null").select(*SHEET, range_coords("x.dimension._ref").alias("r"))
    return d.select(*SHEET, F.col("r.y2").alias("max_row"), F.col("r.x2").alias("max_col"))


def xlsx_bounds(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, max_row, max_col): how far a sheet reaches by its cells, its merged ranges and its stated dimension."""
    merged = xlsx_merges(docs, key, content)
    reach = bounds(scan_xlsx(docs, key, content), merged).unionByName(xlsx_dimensions(docs, key, content))
    return reach.groupBy(*SHEET).agg(F.max("max_row").cast("int").alias("max_row"), F.max("max_col").cast("int").alias("max_col"))


def xlsx_rules(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_name, range, kind, type, action): the rules of all sheets together, validations and conditional formats; a range
    names its sheet."""
    names = xlsx_sheets(docs, key, content)
    cond = names.select("workbook_id", "sheet_name", F.explode("x.conditionalFormatting").alias("f"))
    cond = cond.select("workbook_id", "sheet_name", F.col("f._sqref").alias("range"), F.explode("f.cfRule").alias("r"))
    cond = cond.select("workbook_id", "sheet_name", "range", F.lit("format").alias("kind"), F.col("r._type").alias("type"), F.lit("format").alias("action"))
    valid = names.select("workbook_id", "sheet_name", F.explode("x.dataValidations.dataValidation").alias("d"))
    action = F.when(F.col("d._errorStyle") == "warning", "warning").otherwise("reject")
    valid = valid.select("workbook_id", "sheet_name", F.col("d._sqref").alias("range"), F.lit("validation").alias("kind"), F.col("d._type").alias("type"), action.alias("action"))
    return validation_union(valid, cond)


def xlsx_frozen(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, rows, cols): indexes of the frozen rows and columns, counted from the view's first visible cell."""
    view = F.col("x.sheetViews.sheetView")[0]
    s = xlsx_sheets(docs, key, content).select(*SHEET, view["pane"].alias("pane"), range_coords(view["_topLeftCell"]).alias("at")).where("pane._state in ('frozen', 'frozenSplit')")

    def counted(split: Column, first: Column) -> Column:
        return F.when(split >= 1, F.sequence(first, first + split.cast("int") - 1))

    return s.select(*SHEET, counted(F.col("pane._ySplit"), F.col("at.y1")).alias("rows"), counted(F.col("pane._xSplit"), F.col("at.x1")).alias("cols"))


# styles

_COLOR = "struct<_rgb:string,_theme:int,_indexed:int,_tint:double>"
_SIDE = f"struct<_style:string,color:{_COLOR}>"
_EDGES = f"struct<left:{_SIDE},right:{_SIDE},top:{_SIDE},bottom:{_SIDE}>"
_VAL = "struct<_val:string>"
_FONT = f"struct<b:array<{_VAL}>,i:array<{_VAL}>,u:array<{_VAL}>,strike:array<{_VAL}>,sz:{_VAL},name:{_VAL},color:{_COLOR}>"
_FILL = f"struct<patternFill:struct<_patternType:string,fgColor:{_COLOR},bgColor:{_COLOR}>>"
_STYLES = f"""numFmts struct<numFmt:array<struct<_numFmtId:int,_formatCode:string>>>, fonts struct<font:array<{_FONT}>>, fills struct<fill:array<{_FILL}>>, borders struct<border:array<{_EDGES}>>,
cellXfs struct<xf:array<struct<_numFmtId:int,_fontId:int,_fillId:int,_borderId:int,alignment:struct<_horizontal:string,_vertical:string,_wrapText:string>>>>,
dxfs struct<dxf:array<struct<font:{_FONT},fill:{_FILL},border:{_EDGES}>>>"""


def _books(docs: DataFrame, key: str, content: str) -> DataFrame:
    return parsed(parts(docs, r"xl/styles\.xml", key, content), "styleSheet", _STYLES)


def _prop(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value))


def _on(flags: Column) -> Column:
    """Whether an element that may state `val` is there and on."""
    return (F.size(flags) > 0) & ~F.coalesce(F.get(flags, F.lit(0))["_val"], F.lit("1")).isin("0", "false", "none")


def _font_css(font: Column) -> list[Column]:
    return [F.when(_on(font["b"]), F.lit("font-weight: bold")), F.when(_on(font["i"]), F.lit("font-style: italic"))]


def _edges_css(border: Column) -> list[Column]:
    def line(side: str) -> Column:
        e = border[side]
        text = F.concat_ws(" ", F.coalesce(F.element_at(literal_map(BORDERS), e["_style"]), F.lit(BORDERS["thin"])), F.coalesce(sheet_color(e["color"]), F.lit("#000")))
        return F.when(e["_style"].isNotNull(), F.concat(F.lit(f"border-{side}: "), text))

    return [line(side) for side in ("left", "right", "top", "bottom")]


def xlsx_styles(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, xf, css, number_format, align, wrap): each style index looked up in fonts, fills and borders; 0 has no CSS."""
    s = _books(docs, key, content).select("workbook_id", "x", F.posexplode("x.cellXfs.xf").alias("xf", "s"))
    font, fill, border = (F.get(F.col(f"x.{a}.{b}"), F.nullif(F.coalesce(F.col(f"s._{b}Id"), F.lit(0)), F.lit(0))) for a, b in (("fonts", "font"), ("fills", "fill"), ("borders", "border")))
    custom = F.filter("x.numFmts.numFmt", lambda n: n["_numFmtId"] == F.col("s._numFmtId"))
    wrap = F.coalesce("s.alignment._wrapText", F.lit("0")).isin("1", "true")
    upright = F.when(F.col("s.alignment._vertical").isin("top", "bottom"), F.col("s.alignment._vertical")).when(F.col("s.alignment._vertical").isNotNull(), "middle")
    css = [
        _prop("font-family", font["name"]["_val"]), _prop("font-size", F.concat(font["sz"]["_val"], F.lit("pt"))), *_font_css(font), F.when(_on(font["u"]), F.lit("text-decoration: underline")),
        F.when(_on(font["strike"]), F.lit("text-decoration: line-through")), _prop("color", sheet_color(font["color"])),
        F.when(fill["patternFill"]["_patternType"] != "none", _prop("background-color", sheet_color(fill["patternFill"]["fgColor"]))), *_edges_css(border),
        _prop("text-align", F.col("s.alignment._horizontal")), _prop("vertical-align", upright), F.when(wrap, F.lit("white-space: pre-wrap")),
    ]
    number_format = F.coalesce(F.get(custom, F.lit(0))["_formatCode"], F.element_at(literal_map(NUMBER_FORMATS), F.col("s._numFmtId")))
    return s.select("workbook_id", "xf", F.when(F.col("xf") == 0, F.lit("")).otherwise(F.concat_ws("; ", *css)).alias("css"), number_format.alias("number_format"), F.col("s.alignment._horizontal").alias("align"), wrap.alias("wrap"))


def xlsx_rule_styles(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, dxf, css) of the differential styles that conditional formats name."""
    d = _books(docs, key, content).select("workbook_id", F.posexplode("x.dxfs.dxf").alias("dxf", "d"))
    back = F.coalesce(sheet_color(F.col("d.fill.patternFill.bgColor")), sheet_color(F.col("d.fill.patternFill.fgColor")))
    css = [_prop("color", sheet_color(F.col("d.font.color"))), _prop("background-color", back), *_font_css(F.col("d.font")), *_edges_css(F.col("d.border"))]
    return d.select("workbook_id", "dxf", F.concat_ws("; ", *css).alias("css"))


def xlsx_styled_cells(docs: DataFrame, key: str = "doc_id", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(styles, cells): cells with css and style_idx, borders that meet drawn once, styles numbered by first appearance."""
    cells = scan_xlsx(docs, key, content)
    # styles: at most 65,490 to a workbook
    cells = cells.join(xlsx_styles(docs, key, content), ["workbook_id", "xf"], "left")
    return styled(cells)


def xlsx_conditional_formats(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, range, nth, type, criteria, value, format): rules by sheet, with the CSS of their style as a map.

    Blank rules, four kinds of text rules, eight comparisons, formulas, data bars, colour scales and icon sets; others
    are left out. A comparison with a quoted text is a text rule."""
    s = xlsx_sheets(docs, key, content).select("workbook_id", "sheet_idx", "sheet_name", F.posexplode("x.conditionalFormatting").alias("f_nth", "f"))
    r = s.select("workbook_id", "sheet_idx", "sheet_name", "f_nth", F.col("f._sqref").alias("sqref"), F.posexplode("f.cfRule").alias("r_nth", "r")).where("sqref is not null")
    kind, first = F.col("r._type"), F.get("r.formula", F.lit(0))
    quoted = F.exists("r.formula", lambda f: f.rlike('^".*"$'))
    operator = F.element_at(literal_map(OPERATORS), F.col("r._operator"))
    numbers = F.transform(F.col("r.formula"), lambda f: F.when(f.rlike('^".*"$'), F.regexp_replace(f, '^"|"$', "")).when(number_prefix(f).isNotNull(), F.regexp_replace(number_prefix(f).cast("string"), r"\.0$", "")))
    typed = (
        F.when(kind.isin(*SIMPLE_RULES), F.element_at(literal_map(SIMPLE_RULES), kind)).when(kind.isin(*TEXT_RULES), F.lit("text"))
        .when((kind == "cellIs") & operator.isNotNull(), F.when(quoted, "text").otherwise("number")).when((kind == "expression") & (first != ""), F.lit("formula")).when(kind.isin("dataBar", "colorScale", "iconSet"), kind)
    )
    criteria = F.when(kind.isin(*TEXT_RULES), F.element_at(literal_map(TEXT_RULES), kind)).when(kind == "cellIs", operator)
    value = (
        F.when(kind.isin(*TEXT_RULES) & F.col("r._text").isNotNull(), F.array("r._text")).when(kind == "cellIs", F.filter(numbers, lambda x: x.isNotNull()))
        .when(kind == "expression", F.array(F.concat(F.lit("="), clean_formula(first))))
    )
    order = W.partitionBy("workbook_id").orderBy("sheet_idx", "f_nth", "r_nth")
    out = r.withColumn("type", typed).withColumn("criteria", criteria).withColumn("value", value).where("type is not null").withColumn("nth", F.row_number().over(order) - 1)
    out = out.withColumn("dxf", F.col("r._dxfId")).join(xlsx_rule_styles(docs, key, content), ["workbook_id", "dxf"], "left")
    css = F.when(F.coalesce("css", F.lit("")) != "", F.map_from_entries(F.transform(F.split("css", "; "), lambda p: F.struct(F.substring_index(p, ": ", 1), F.regexp_replace(p, "^[^:]*: ", "")))))
    return out.select("workbook_id", F.concat("sheet_name", F.lit("!"), "sqref").alias("range"), "nth", "type", "criteria", "value", css.alias("format"))


# drawings

_FILL_OF = "struct<srgbClr:struct<_val:string>,schemeClr:struct<_val:string>>"
_XFRM = "struct<off:struct<_x:long,_y:long>,ext:struct<_cx:long,_cy:long>>"
_POINT = "struct<col:int,colOff:long,row:int,rowOff:long>"
_SPPR = f"struct<prstGeom:struct<_prst:string>,solidFill:{_FILL_OF},noFill:array<string>,ln:struct<_w:long,solidFill:{_FILL_OF},noFill:array<string>>>"
_RUNS = "array<struct<r:array<struct<rPr:struct<solidFill:" + _FILL_OF + ">,t:string>>>>"
_ANCHOR = f"""array<struct<from:{_POINT},to:{_POINT},pic:struct<blipFill:struct<blip:struct<_embed:string>>>,sp:struct<spPr:{_SPPR},txBody:struct<p:{_RUNS}>>,
graphicFrame:struct<xfrm:{_XFRM},graphic:struct<graphicData:struct<chart:struct<_id:string>>>>>>"""
_DRAWING = ", ".join(f"{kind} {_ANCHOR}" for kind in ("twoCellAnchor", "oneCellAnchor", "absoluteAnchor"))


def drawing_color(fill: Column) -> Column:
    """`#RRGGBB` of a drawn fill; a scheme name that is not known is black."""
    scheme = F.when(fill["schemeClr"]["_val"].isNotNull(), F.coalesce(scheme_color(fill["schemeClr"]["_val"]), F.lit("000000")))
    return F.concat(F.lit("#"), F.coalesce(fill["srgbClr"]["_val"], scheme))


def blobs(docs: DataFrame, pattern: str, key: str, content: str) -> DataFrame:
    """(workbook_id, part, data): the bytes of the parts of each archive whose name matches."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, data in zip(b["k"], b["c"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        out = [(k, n, z.read(n)) for n in z.namelist() if re.fullmatch(pattern, n)]
                except zipfile.BadZipFile:
                    out = []
                yield pd.DataFrame(out, columns=["workbook_id", "part", "data"])

    return docs.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(run, f"workbook_id {kind}, part string, data binary")


def xlsx_anchors(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, part, nth, anchor, kind, a, left, top, width, height, cell): everything drawn on sheets, in stored order.

    A frame's own place counts where it isn't 0; otherwise the cells it is anchored to, of a usual size."""
    p = parsed(parts(docs, r"xl/drawings/[^/]+\.xml", key, content), "wsDr", _DRAWING)

    def of_kind(anchor: str) -> Column:
        return F.transform(F.coalesce(F.col(f"x.{anchor}"), F.array().cast(_ANCHOR)), lambda a: F.struct(F.lit(anchor).alias("anchor"), a.alias("a")))

    each = F.concat(*map(of_kind, ("twoCellAnchor", "oneCellAnchor", "absoluteAnchor")))
    a = p.select("workbook_id", F.col("part").alias("target"), F.posexplode(each).alias("nth", "e")).select("workbook_id", "target", "nth", "e.*")
    on = xlsx_rels(docs, "xl/worksheets", key, content).where("kind = 'drawing'").join(xlsx_worksheets(docs, key, content).select(*SHEET, "part"), ["workbook_id", "part"])
    a = a.join(on.select(*SHEET, "target"), ["workbook_id", "target"])
    kind = F.when(F.col("a.pic").isNotNull(), "image").when(F.col("a.sp").isNotNull(), "shape").when(F.col("a.graphicFrame").isNotNull(), "chart")
    own, start, end = F.col("a.graphicFrame.xfrm"), F.col("a.from"), F.col("a.to")
    placed = (F.coalesce(own["off"]["_x"], F.lit(0)) != 0) | (F.coalesce(own["off"]["_y"], F.lit(0)) != 0)

    def far(x: str, size: int) -> tuple[Column, Column]:
        at = start[x] * size + emu_px(start[f"{x}Off"])
        return at, (end[x] - start[x]) * size + emu_px(end[f"{x}Off"] - start[f"{x}Off"])

    (left, width), (top, height) = far("col", CELL_WIDTH), far("row", CELL_HEIGHT)
    both = {"left": (own["off"]["_x"], left), "top": (own["off"]["_y"], top), "width": (own["ext"]["_cx"], width), "height": (own["ext"]["_cy"], height)}
    places = [F.when(placed, emu_px(mine)).otherwise(cells).alias(name) for name, (mine, cells) in both.items()]
    return a.select(*SHEET, F.col("target").alias("part"), "nth", "anchor", kind.alias("kind"), "a", *places, cell_name(start["col"], start["row"]).alias("cell")).where("kind is not null")


def xlsx_images(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, nth, left, top, width, height, cell, src): pictures as data URIs; those without a file are left out."""
    a = xlsx_anchors(docs, key, content).where("kind = 'image'").withColumn("rid", F.col("a.pic.blipFill.blip._embed"))
    a = a.join(xlsx_rels(docs, "xl/drawings", key, content).drop("kind"), ["workbook_id", "part", "rid"])
    files = blobs(docs, r"xl/media/.*", key, content).withColumnRenamed("part", "target")
    ext = F.lower(F.substring_index("target", ".", -1))
    src = F.concat(F.lit("data:"), F.coalesce(F.element_at(literal_map(IMAGE_TYPES), ext), F.lit("image/png")), F.lit(";base64,"), F.regexp_replace(F.base64("data"), r"\s", ""))
    return a.join(files, ["workbook_id", "target"]).select(*SHEET, "nth", "left", "top", "width", "height", "cell", src.alias("src"))


def xlsx_shapes(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, nth, left, top, width, height, cell, type, background, border_color, border_width, text, font_color)."""
    a = xlsx_anchors(docs, key, content).where("kind = 'shape'")
    p, runs = F.col("a.sp.spPr"), F.col("a.sp.txBody.p")
    lines = F.filter(F.transform(runs, lambda q: F.array_join(F.transform(F.coalesce(q["r"], F.array().cast("array<struct<rPr:struct<solidFill:" + _FILL_OF + ">,t:string>>")), lambda r: F.coalesce(r["t"], F.lit(""))), "")), lambda t: t != "")
    fonts = F.filter(F.flatten(F.transform(F.filter(runs, lambda q: q["r"].isNotNull()), lambda q: q["r"])), lambda r: r["rPr"].isNotNull())
    width = F.when(drawing_color(p["ln"]["solidFill"]).isNull() & p["ln"]["noFill"].isNotNull(), F.lit(0)).when(p["ln"]["_w"].isNotNull(), half_up(p["ln"]["_w"] / 9525 * 1.333))
    return a.select(
        *SHEET, "nth", "left", "top", "width", "height", "cell", F.coalesce(F.element_at(literal_map(SHAPES), p["prstGeom"]["_prst"]), F.lit("rectangle")).alias("type"),
        F.coalesce(drawing_color(p["solidFill"]), F.when(p["noFill"].isNotNull(), "transparent")).alias("background"), drawing_color(p["ln"]["solidFill"]).alias("border_color"),
        width.cast("long").alias("border_width"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("text"), drawing_color(F.get(fonts, F.lit(0))["rPr"]["solidFill"]).alias("font_color"),
    )


_TITLE = "struct<tx:struct<rich:struct<p:array<struct<r:array<struct<t:string>>>>>>>"
_AXIS = f"struct<delete:{_VAL},scaling:struct<orientation:{_VAL},min:{_VAL},max:{_VAL}>,title:{_TITLE}>"
_REF = "struct<f:string>"
_SERIES = f"array<struct<val:struct<numRef:{_REF}>,yVal:struct<numRef:{_REF}>,cat:struct<strRef:{_REF},numRef:{_REF}>,spPr:struct<solidFill:{_FILL_OF},ln:struct<solidFill:{_FILL_OF}>>>>"
_CHART = f"chart struct<title:{_TITLE},legend:struct<legendPos:{_VAL}>,plotArea:struct<{','.join(f'{c}Chart:struct<ser:{_SERIES}>' for c in CHARTS)},catAx:array<{_AXIS}>,valAx:array<{_AXIS}>>>"


def _title(t: Column) -> Column:
    runs = F.transform(t["tx"]["rich"]["p"], lambda p: F.array_join(F.transform(p["r"], lambda r: F.coalesce(r["t"], F.lit(""))), ""))
    return F.nullif(F.array_join(runs, ""), F.lit(""))


def xlsx_charts(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, nth, left, top, width, height, cell, type, title, legend, base_axis, side_axis, range, orientation, datasets, labels, series).

    range: the bounding box of all series and labels; orientation: whether the first series is a column; datasets and labels:
    their places within the range, along it."""
    a = xlsx_anchors(docs, key, content).where("kind = 'chart'").withColumn("rid", F.col("a.graphicFrame.graphic.graphicData.chart._id"))
    a = a.join(xlsx_rels(docs, "xl/drawings", key, content).drop("kind"), ["workbook_id", "part", "rid"]).drop("a")
    c = parsed(parts(docs, r"xl/charts/[^/]+\.xml", key, content), "chartSpace", _CHART).withColumnRenamed("part", "target")
    c = a.join(c, ["workbook_id", "target"]).withColumn("plot", F.col("x.chart.plotArea"))
    kind = F.coalesce(*(F.when(F.col(f"plot.{k}Chart").isNotNull(), k) for k in CHARTS), F.lit("bar"))
    series = F.coalesce(*(F.col(f"plot.{k}Chart.ser") for k in CHARTS))

    def axis(ax: Column, limits: bool) -> Column:
        scale = ax["scaling"]
        ends = [scale[n]["_val"].try_cast("double").alias(n) for n in ("min", "max")] if limits else []
        return F.struct((ax["delete"]["_val"] != "1").alias("display"), (scale["orientation"]["_val"] == "maxMin").alias("reverse"), _title(ax["title"]).alias("title"), *ends)

    both = F.col("plot.catAx").isNotNull() & F.col("plot.valAx").isNotNull()
    c = c.select(
        *SHEET, "nth", "left", "top", "width", "height", "cell", kind.alias("type"), _title(F.col("x.chart.title")).alias("title"),
        F.when(F.col("x.chart.legend").isNotNull(), F.coalesce(F.element_at(literal_map(LEGENDS), F.col("x.chart.legend.legendPos._val")), F.lit("right"))).alias("legend"),
        F.when(both, axis(F.col("plot.catAx")[0], False)).alias("base_axis"), F.when(both, axis(F.col("plot.valAx")[0], True)).alias("side_axis"), F.coalesce(series, F.array().cast(_SERIES)).alias("ser"),
    )
    c = c.withColumn("sets", F.filter(F.transform("ser", lambda s: F.coalesce(s["val"]["numRef"]["f"], s["yVal"]["numRef"]["f"])), lambda f: f.isNotNull()))
    c = c.withColumn("names", F.get(F.filter(F.transform("ser", lambda s: F.coalesce(s["cat"]["strRef"]["f"], s["cat"]["numRef"]["f"])), lambda f: f.isNotNull()), F.lit(0)))
    c = c.withColumn("series", F.transform("ser", lambda s: F.struct(drawing_color(s["spPr"]["solidFill"]).alias("color"), drawing_color(s["spPr"]["ln"]["solidFill"]).alias("border_color"))))
    # a chart's few ranges, whose box is one aggregate
    refs = c.select(*SHEET, "nth", F.explode(F.concat("sets", F.when(F.col("names").isNotNull(), F.array("names")).otherwise(F.array().cast("array<string>")))).alias("ref"))
    r = range_coords("ref")
    box = bounding_box(refs.select(*SHEET, "nth", r["y1"].alias("r1"), r["x1"].alias("c1"), r["y2"].alias("r2"), r["x2"].alias("c2")), [*SHEET, "nth"])
    c = c.join(box, [*SHEET, "nth"], "left")
    at = [F.transform("sets", lambda f: range_coords(f)), range_coords("names")]
    upright = F.get(at[0], F.lit(0))["x1"] == F.get(at[0], F.lit(0))["x2"]
    sheet = F.regexp_extract(F.coalesce(F.get("sets", F.lit(0)), "names"), "^(.*!)", 1)

    def place(p: Column) -> Column:
        return F.when(upright, p["x1"] - F.col("c1")).otherwise(p["y1"] - F.col("r1"))

    whole = F.concat(sheet, cell_name("c1", "r1"), F.lit(":"), cell_name("c2", "r2"))
    return c.select(
        *SHEET, "nth", "left", "top", "width", "height", "cell", "type", "title", "legend", "base_axis", "side_axis", whole.alias("range"), upright.alias("orientation"),
        F.transform(at[0], place).alias("datasets"), place(at[1]).alias("labels"), "series",
    )
