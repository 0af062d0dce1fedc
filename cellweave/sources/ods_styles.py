"""Looks of OpenDocument sheets: styles as CSS, number formats, frozen panes and styled cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators.relational import border_dedup, range_explode
from cellweave.sources.zipped import ods_worksheets, parsed, parts, scan_ods

_PROPERTIES = """`text-properties`:struct<`_font-family`:string,`_font-size`:string,`_font-weight`:string,`_font-style`:string,`_text-underline-style`:string,_color:string>,
`table-cell-properties`:struct<`_background-color`:string,_border:string,`_border-left`:string,`_border-right`:string,`_border-top`:string,`_border-bottom`:string>,
`paragraph-properties`:struct<`_text-align`:string>"""
_NUMBER = "struct<`_decimal-places`:int,`_min-decimal-places`:int>"
_FORMAT = f"array<struct<_name:string,number:{_NUMBER},`currency-symbol`:array<struct<_VALUE:string>>>>"
_KINDS = ("number", "percentage", "currency", "date", "time")
_GROUP = f"struct<style:array<struct<_name:string,_family:string,`_data-style-name`:string,{_PROPERTIES}>>,{','.join(f'`{k}-style`:{_FORMAT}' for k in _KINDS)}>"
_BOTH = f"`automatic-styles` {_GROUP}, styles {_GROUP}"


def _groups(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(workbook_id, rank, g): groups of styles; those of content.xml come before those of styles.xml."""
    out = None
    for rank, (name, tag) in enumerate((("content", "document-content"), ("styles", "document-styles"))):
        p = parsed(parts(docs, rf"{name}\.xml", key, content, (tag, {"automatic-styles", "styles"})), tag, _BOTH)
        for k, group in enumerate(("automatic-styles", "styles")):
            some = p.select("workbook_id", F.lit(2 * rank + k).alias("rank"), F.col(f"x.`{group}`").alias("g"))
            out = some if out is None else out.unionByName(some)
    return out


def _first(df: DataFrame, name: str, *take: str) -> DataFrame:
    """The entry of the lowest rank, then place, for each name."""
    return df.groupBy("workbook_id", name).agg(F.min_by(F.struct(*take), F.struct("rank", "place")).alias("m")).select("workbook_id", name, "m.*")


def ods_number_formats(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, format_name, mask) of number, percentage, currency, date and time styles; dates and times have number masks."""
    g, out = _groups(docs, key, content), None
    for kind in _KINDS:
        f = g.select("workbook_id", "rank", F.posexplode(f"g.`{kind}-style`").alias("place", "f"))
        stored, least = F.coalesce("f.number.`_decimal-places`", F.lit(0)), F.coalesce("f.number.`_min-decimal-places`", F.lit(0))
        places = stored if kind in ("currency", "percentage") else F.greatest(stored, least)
        tail = F.when(places > 0, F.concat(F.lit("."), F.repeat(F.lit("0"), places))).otherwise("")
        symbol = F.coalesce(F.get("f.`currency-symbol`", F.lit(0))["_VALUE"], F.lit("$" if kind == "currency" else ""))
        symbol = F.when(F.size("f.`currency-symbol`") > 0, symbol).otherwise("")
        mask = F.concat(symbol, F.lit("#,##0"), tail) if kind == "currency" else F.concat(F.lit("0"), tail, F.lit("%" if kind == "percentage" else ""))
        some = f.select("workbook_id", "rank", "place", F.col("f._name").alias("format_name"), mask.alias("mask"))
        out = some if out is None else out.unionByName(some)
    return _first(out.where("format_name is not null"), "format_name", "mask")


def ods_styles(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, style_name, style_rank, css, number_format): each named style; style_rank is its place among the workbook's.

    A border of all sides is laid out by side, so that sides may be dropped one by one; an own side comes after it."""
    s = _groups(docs, key, content).select("workbook_id", "rank", F.posexplode("g.style").alias("place", "s")).where("s._name is not null")
    t, c, p = "s.`text-properties`", "s.`table-cell-properties`", "s.`paragraph-properties`"

    def prop(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value))

    def lined(value: Column) -> Column:
        for word, width in (("thin", "1px"), ("medium", "2px"), ("thick", "3px")):
            value = F.regexp_replace(value, rf"\b{word}\b", width)
        return value

    sides = ("left", "right", "top", "bottom")
    own = {side: F.nullif(F.col(f"{c}.`_border-{side}`"), F.lit("none")) for side in sides}
    css = [
        prop("font-family", F.col(f"{t}.`_font-family`")), prop("font-size", F.col(f"{t}.`_font-size`")), prop("font-weight", F.col(f"{t}.`_font-weight`")), prop("font-style", F.col(f"{t}.`_font-style`")),
        F.when(F.col(f"{t}.`_text-underline-style`").isNotNull(), F.lit("text-decoration: underline")), prop("color", F.col(f"{t}._color")), prop("background-color", F.col(f"{c}.`_background-color`")),
        *(prop(f"border-{side}", lined(F.col(f"{c}._border"))) for side in sides), *(prop(f"border-{side}", lined(own[side])) for side in sides), prop("text-align", F.col(f"{p}.`_text-align`")),
    ]
    s = s.select("workbook_id", "rank", "place", F.col("s._name").alias("style_name"), F.concat_ws("; ", *css).alias("css"), F.col("s.`_data-style-name`").alias("format_name"))
    s = _first(s, "style_name", "css", "format_name", "rank", "place")
    s = s.withColumn("style_rank", F.row_number().over(W.partitionBy("workbook_id").orderBy("rank", "place", "style_name")) - 1)
    s = s.join(ods_number_formats(docs, key, content), ["workbook_id", "format_name"], "left")
    return s.select("workbook_id", "style_name", "style_rank", "css", F.col("mask").alias("number_format"))


def ods_frozen(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, freeze_rows, freeze_cols) from the stored positions of splits, by sheet name."""
    item = "struct<_name:string,_VALUE:string>"
    tables = f"array<struct<_name:string,`config-item`:array<{item}>>>"
    view = f"array<struct<`config-item-map-named`:array<struct<_name:string,`config-item-map-entry`:{tables}>>>>"
    schema = f"settings struct<`config-item-set`:array<struct<_name:string,`config-item-map-indexed`:array<struct<_name:string,`config-item-map-entry`:{view}>>>>>"
    p = parsed(parts(docs, r"settings\.xml", key, content), "document-settings", schema)
    for path in ("x.settings.`config-item-set`", "v.`config-item-map-indexed`", "v.`config-item-map-entry`", "v.`config-item-map-named`", "v.`config-item-map-entry`"):
        p = p.select("workbook_id", F.explode(path).alias("v"))

    def setting(name: str) -> Column:
        return F.get(F.filter("v.`config-item`", lambda i: i["_name"] == name), F.lit(0))["_VALUE"].try_cast("int")

    p = p.select("workbook_id", F.col("v._name").alias("sheet_name"), F.nullif(setting("PositionBottom"), F.lit(0)).alias("freeze_rows"), F.nullif(setting("PositionRight"), F.lit(0)).alias("freeze_cols"))
    p = p.where("freeze_rows is not null or freeze_cols is not null")
    return ods_worksheets(docs, key, content).join(p, ["workbook_id", "sheet_name"]).select("workbook_id", "sheet_idx", "freeze_rows", "freeze_cols")


def ods_styled_cells(docs: DataFrame, key: str = "doc_id", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(styles, cells): cells with css, number_format and style_idx, borders that meet drawn once, also at the edges of merged cells.

    styles has every named style in order of declaration, then what the removal of borders made, by first appearance."""
    named = ods_styles(docs, key, content)
    c = scan_ods(docs, key, content).join(named.drop("style_rank"), ["workbook_id", "style_name"], "left").withColumn("css", F.nullif("css", F.lit("")))
    kept = F.when((F.col("number_format") != "0") | (F.col("v_num") % 1 == 0) | F.col("v_num").isNull(), F.col("number_format"))
    c = c.withColumn("number_format", F.when(F.col("v_num").isNotNull(), kept))
    # a merged cell stands on all its slots while borders are compared; its own are at its first slot
    at = ["workbook_id", "sheet_idx", "row_idx", "col_idx"]
    wide = c.where("colspan > 1 or rowspan > 1").select("workbook_id", "sheet_idx", "css", F.col("row_idx").alias("r1"), (F.col("row_idx") + F.col("rowspan") - 1).alias("r2"), F.col("col_idx").alias("c1"), (F.col("col_idx") + F.col("colspan") - 1).alias("c2"), F.col("row_idx").alias("top"), F.col("col_idx").alias("left"))
    slots = range_explode(wide).where("row_idx <> top or col_idx <> left").select(*at, "css", F.lit(True).alias("slot"))
    slots = slots.join(c.select(*at), at, "left_anti")
    both = border_dedup(c.withColumn("slot", F.lit(False)).unionByName(slots, allowMissingColumns=True)).where("not slot").drop("slot")
    both = both.withColumn("css", F.nullif("css", F.lit("")))
    declared = named.where("css <> ''").groupBy("workbook_id", "css").agg(F.min("style_rank").alias("rank"))
    found = both.where("css is not null").groupBy("workbook_id", "css").agg(F.min(F.struct("sheet_idx", "row_idx", "col_idx")).alias("first"))
    every = declared.join(found, ["workbook_id", "css"], "full")
    order = W.partitionBy("workbook_id").orderBy(F.col("rank").asc_nulls_last(), "first")
    styles = every.select("workbook_id", "css", (F.row_number().over(order) - 1).alias("style_idx"))
    return styles, both.join(styles, ["workbook_id", "css"], "left")

