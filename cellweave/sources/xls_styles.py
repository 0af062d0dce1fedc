"""Looks of Excel 97-2003 sheets: fonts, number formats, style records, rows and styled cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.functions.palettes import indexed_color
from cellweave.operators.relational import styled
from cellweave.sources.binary import biff_records, latin, scan_xls, unsigned

# Horizontal alignment by code (0 is by kind of value), and vertical.
ACROSS = (None, "left", "center", "right", "fill", "justify", "center-across-selection", "distributed")
UPRIGHT = ("top", "middle", "bottom", "justify", "distributed")


def _numbered(r: DataFrame, kind: int, name: str) -> DataFrame:
    """Records of a type, numbered within their workbook."""
    return r.where(F.col("type") == kind).withColumn(name, (F.row_number().over(W.partitionBy("workbook_id").orderBy("n")) - 1).cast("int"))


def _string(data: Column, at: int, size: Column, wide: Column) -> Column:
    """A string of size characters that follows its flag byte."""
    body = F.substring(data, F.lit(at + 1), (size * F.when(wide, 2).otherwise(1)).cast("int"))
    return F.when(wide, F.decode(body, "UTF-16LE")).otherwise(latin(body))


def _bit(x: Column, n: int) -> Column:
    return F.shiftright(x, n) % 2 == 1


def _bits(x: Column, n: int, width: int) -> Column:
    return F.shiftright(x, n) % (1 << width)


def xls_fonts(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, font, name, size_pt, italic, strike, underline, color). Weights in these records are not to be trusted.

    Font 4 is never stored, so numbers from there on are one more than places."""
    f = _numbered(biff_records(docs, key, content), 0x31, "place")
    d = F.col("data")
    flags = unsigned(d, 2, 2)
    name = F.regexp_replace(_string(d, 16, unsigned(d, 14, 1), unsigned(d, 15, 1) % 2 == 1), "[\x00-\x1f]", "")
    return f.select(
        "workbook_id", F.when(F.col("place") >= 4, F.col("place") + 1).otherwise(F.col("place")).alias("font"), name.alias("name"), (unsigned(d, 0, 2) / 20).alias("size_pt"),
        _bit(flags, 1).alias("italic"), _bit(flags, 3).alias("strike"), (unsigned(d, 10, 1) > 0).alias("underline"), unsigned(d, 4, 2).cast("int").alias("color"),
    )


def xls_formats(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, format, mask) of the number formats that a workbook stores."""
    d = F.col("data")
    f = biff_records(docs, key, content).where("type = 1054")
    return f.select("workbook_id", unsigned(d, 0, 2).cast("int").alias("format"), _string(d, 5, unsigned(d, 2, 2), unsigned(d, 4, 1) % 2 == 1).alias("mask"))


def xls_styles(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, xf, css, number_format, wrap): each style record with its font, format, alignment, fill and borders.

    A solid fill gives its foreground as background, another pattern its background; automatic colours (64 on) give none."""
    d = F.col("data")
    x = _numbered(biff_records(docs, key, content), 0xE0, "xf")
    align, lines, pattern, fills = unsigned(d, 6, 1), unsigned(d, 10, 4), _bits(unsigned(d, 14, 4), 26, 6), unsigned(d, 18, 2)
    x = x.select(
        "workbook_id", "xf", unsigned(d, 0, 2).cast("int").alias("font"), unsigned(d, 2, 2).cast("int").alias("format"), _bits(align, 0, 3).cast("int").alias("across"), _bit(align, 3).alias("wrap"),
        _bits(align, 4, 3).cast("int").alias("upright"), lines.alias("lines"), F.when(pattern == 1, fills % 128).when(pattern > 1, _bits(fills, 7, 7)).alias("fill"),
    )
    # fonts and formats: at most a few hundred to a workbook
    x = x.join(xls_fonts(docs, key, content), ["workbook_id", "font"], "left").join(xls_formats(docs, key, content), ["workbook_id", "format"], "left")

    def prop(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value))

    sides = [F.when(_bits(F.col("lines"), n, 4) > 0, F.lit(f"border-{s}: 1px solid #000")) for n, s in ((0, "left"), (4, "right"), (8, "top"), (12, "bottom"))]
    css = [
        prop("font-family", F.nullif("name", F.lit(""))), F.when(F.col("size_pt") > 0, F.concat(F.lit("font-size: "), F.regexp_replace(F.col("size_pt").cast("string"), r"\.0$", ""), F.lit("pt"))),
        F.when(F.col("italic"), F.lit("font-style: italic")), F.when(F.col("underline"), F.lit("text-decoration: underline")), F.when(F.col("strike"), F.lit("text-decoration: line-through")),
        prop("text-align", F.get(F.array(*map(F.lit, ACROSS)), F.col("across"))), prop("vertical-align", F.get(F.array(*map(F.lit, UPRIGHT)), F.col("upright"))), F.when(F.col("wrap"), F.lit("white-space: pre-wrap")),
        prop("background-color", F.concat(F.lit("#"), indexed_color(F.col("fill")))), prop("color", F.concat(F.lit("#"), indexed_color(F.col("color")))), *sides,
    ]
    return x.select("workbook_id", "xf", F.concat_ws("; ", *css).alias("css"), F.col("mask").alias("number_format"), "wrap")


def xls_rows(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, row_idx, height_pt, visible) of row records."""
    r = biff_records(docs, key, content)
    m = r.where("type = 520 and sheet_idx is not null")
    d = F.col("data")
    return m.select("workbook_id", "sheet_idx", unsigned(d, 0, 2).cast("int").alias("row_idx"), (unsigned(d, 6, 2) % 32768 / 20).alias("height_pt"), (~_bit(unsigned(d, 12, 2), 5)).alias("visible"))


def xls_styled_cells(docs: DataFrame, key: str = "doc_id", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(styles, cells): cells with css and style_idx, borders that meet drawn once, styles numbered by first appearance."""
    cells = scan_xls(docs, key, content).join(xls_styles(docs, key, content), ["workbook_id", "xf"], "left")
    return styled(cells)
