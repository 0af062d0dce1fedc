"""Whole workbooks as JSON files: what is stored of each sheet, sorted and written line by line."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.sources import binary, markup, ods_styles, xls_styles, xlsx_parts, zipped
from cellweave.sources.datasource import json_pieces, register
from cellweave.sources.reader import scan_files

#: Parts of a sheet, in the order in which a file has them.
PARTS = ("sheet", "columns", "rows", "merges", "comments", "styles", "validations", "data")
SHEET = ["workbook_id", "sheet_idx"]


def _text(cells: DataFrame) -> Column:
    """A cell's value as JSON has it: its formula, text, number or flag."""
    number = F.regexp_replace(F.col("v_num").cast("string"), r"\.0$", "")
    return F.coalesce("formula", "v_str", number, F.col("v_bool").cast("string"))


def data_lines(cells: DataFrame) -> DataFrame:
    """A line for each stored row: its number and its cells (column, value, and what is there of type, css and mask)."""
    more = [c for c in ("css", "mask", "style_idx") if c in cells.columns]
    cell = F.struct("col_idx", _text(cells).alias("value"), F.col("v_type").alias("type"), *more)
    rows = cells.groupBy(*SHEET, "row_idx").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select(*SHEET, F.lit("data").alias("part"), F.col("row_idx").cast("long").alias("at"), F.to_json(F.struct(F.col("row_idx").alias("row"), "cells")).alias("item"))


def part_lines(part: str, rows: DataFrame, order: str | Column | None = None) -> DataFrame:
    """A line for each row of another part; all columns but those of the sheet's place are its fields."""
    if part not in PARTS:
        raise ValueError(f"No part {part!r}; there are {', '.join(PARTS)}")
    at = F.lit(0) if order is None else F.col(order) if isinstance(order, str) else order
    fields = [c for c in rows.columns if c not in SHEET]
    return rows.select(*SHEET, F.lit(part).alias("part"), at.cast("long").alias("at"), F.to_json(F.struct(*fields)).alias("item"))


def workbook_lines(cells: DataFrame, **parts: DataFrame | tuple[DataFrame, str]) -> DataFrame:
    """(workbook_id, sheet_idx, part, at, item): all lines of all workbooks. parts: tables (workbook_id, sheet_idx, ...) by name in PARTS,
    or such a table and the column that orders it."""
    out = data_lines(cells)
    for name, given in parts.items():
        out = out.unionByName(part_lines(name, *(given if isinstance(given, tuple) else (given,))))
    return out


def write_workbooks(lines: DataFrame, path: str) -> None:
    """Write a JSON file for each workbook under a folder: {"worksheets": [{part: [item, ...], ...}, ...]}.

    Lines are dealt by workbook and sorted within tasks, which spills where it must; the writer holds one line. A file takes its place
    when all tasks are done; a job that fails leaves none."""
    register(lines.sparkSession)
    nth = F.array_position(F.array(*map(F.lit, PARTS)), F.col("part"))
    ready = lines.withColumn("nth", nth).repartition("workbook_id").sortWithinPartitions("workbook_id", "sheet_idx", "nth", "at", "item")
    ready = ready.select(F.col("workbook_id").cast("string").alias("workbook_id"), "sheet_idx", "part", "at", "item")
    ready.write.format("cellweave").option("as", "json").mode("append").save(path)


def _xlsx(docs: DataFrame) -> tuple[DataFrame, dict]:
    styles, cells = xlsx_parts.xlsx_styled_cells(docs)
    parts = {
        "sheet": zipped.xlsx_worksheets(docs).drop("part"), "columns": (zipped.xlsx_columns(docs), "col_idx"), "rows": (xlsx_parts.xlsx_rows(docs), "row_idx"),
        "merges": (zipped.xlsx_merges(docs), "row_idx"), "comments": xlsx_parts.xlsx_sheet_comments(docs), "validations": _on_sheets(docs, zipped.xlsx_validations(docs)),
    }
    return cells, parts | {"styles": (styles.withColumn("sheet_idx", F.lit(0)), "style_idx")}


def _on_sheets(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules under the number of the sheet that their range names."""
    names = zipped.xlsx_worksheets(docs).select("workbook_id", "sheet_idx", "sheet_name")
    return rules.withColumn("sheet_name", F.regexp_extract("range", "^(.*)!", 1)).join(names, ["workbook_id", "sheet_name"]).drop("sheet_name")


def _xls(docs: DataFrame) -> tuple[DataFrame, dict]:
    styles, cells = xls_styles.xls_styled_cells(docs)
    sheets = binary.biff_sheets(binary.biff_records(docs, "doc_id", "content")).drop("bof")
    parts = {"sheet": sheets, "columns": (binary.xls_columns(docs), "col_idx"), "merges": (binary.xls_merges(docs), "row_idx")}
    return cells, parts | {"styles": (styles.withColumn("sheet_idx", F.lit(0)), "style_idx")}


def _ods(docs: DataFrame) -> tuple[DataFrame, dict]:
    styles, cells = ods_styles.ods_styled_cells(docs)
    spans = zipped.scan_ods(docs).where("colspan > 1 or rowspan > 1").select(*SHEET, "row_idx", "col_idx", "colspan", "rowspan")
    parts = {"sheet": zipped.ods_worksheets(docs), "columns": (zipped.ods_columns(docs), "col_idx"), "merges": (spans, "row_idx"), "comments": (zipped.ods_comments(docs), "row_idx")}
    return cells, parts | {"styles": (styles.withColumn("sheet_idx", F.lit(0)), "style_idx")}


def file_lines(files: DataFrame, ext: str, **options) -> DataFrame:
    """workbook_lines of files (path, content) of one format, with all that the format stores beside cells: sheets, columns, rows, merged
    ranges, comments, validations and styles of Excel and OpenDocument files, merged ranges of HTML."""
    if whole := {"xlsx": _xlsx, "xls": _xls, "ods": _ods}.get(ext):
        docs = files.select(F.col("path").alias("doc_id"), "content")
        cells, parts = whole(docs)
        return workbook_lines(cells, **parts)
    cells = scan_files(files, {ext}, **options)
    return workbook_lines(cells, **({"merges": (markup.merges(cells), "row_idx")} if ext in ("html", "htm") else {}))


def printed(lines: DataFrame) -> Iterator[str]:
    """The JSON text of each workbook, piece by piece, as its lines come from a sorted plan."""
    nth = F.array_position(F.array(*map(F.lit, PARTS)), F.col("part"))
    rows = lines.withColumn("nth", nth).orderBy("workbook_id", "sheet_idx", "nth", "at", "item").toLocalIterator()
    for _, own in groupby(rows, lambda r: r["workbook_id"]):
        yield from (piece.decode() for piece in json_pieces(own))
