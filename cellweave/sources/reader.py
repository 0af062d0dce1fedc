"""One entry for files of all formats: cells of every file under a path, by extension."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cellweave.operators.relational import grid
from cellweave.sources import binary, delimited, markup, zipped
from cellweave.sources.encodings import decoded_as, dif_encoding_of, encoding_of
from cellweave.sources.streams import archive_damage

#: Scan of each extension; text formats get a decoded column, others bytes.
TEXT = {"csv", "tsv", "tab", "txt", "dif", "slk", "sylk", "xml", "html", "htm"}
BINARY: dict[str, Callable] = {
    "dbf": binary.scan_dbf, "xls": binary.scan_xls, "xlsx": zipped.scan_xlsx, "ods": zipped.scan_ods,
    **dict.fromkeys(("wks", "wk1", "wk3", "wk4", "123"), binary.scan_lotus),
}


def extension(path: str) -> str:
    """Lower-case text after the last dot of a name; '' if there is none."""
    name = re.split(r"[/\\]", path)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def scan_text(docs: DataFrame, ext: str, key: str, delimiter: str = ",", table_index: int | None = 0, first_row_as_header: bool = True) -> DataFrame:
    if ext in ("csv", "tsv", "tab", "txt"):  # tabular text always has tabs, whatever the option says
        return delimited.scan_csv(docs, key, "text", delimiter if ext == "csv" else "\t")
    if ext == "dif":
        return delimited.scan_dif(docs, key, "text")
    if ext in ("slk", "sylk"):
        return delimited.scan_sylk(docs, key, "text")
    if ext == "xml":
        return markup.scan_xml2003(docs, key, "text")
    return markup.scan_html(docs, key, "text", table_index, first_row_as_header)


def path_extension(path: Column) -> Column:
    """extension() of a column of paths."""
    name = F.element_at(F.split(path, r"[/\\\\]"), -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


@F.pandas_udf(StringType())
def damage(ext: pd.Series, content: pd.Series) -> pd.Series:
    """What keeps a binary file from being scanned, or null: no archive or a damaged part, no compound file, no such workbook, a wrong start."""

    def one(kind: str, data: bytes | None) -> str | None:
        data = bytes(data or b"")
        if kind in ("xlsx", "ods"):
            return archive_damage(data, kind)
        if kind == "xls":
            try:
                return None if binary.stream(data, ("Workbook", "Book")) else "No workbook stream"
            except (struct.error, IndexError, ValueError):
                return "A damaged compound file"
        if kind == "dbf":
            return None if len(data) >= 32 else "Too short for a table header"
        return None if data[:2] == b"\0\0" else "Not a worksheet of this kind"

    return pd.Series([one(k, c) for k, c in zip(ext, content, strict=True)], dtype=object)


def scan_files(files: DataFrame, exts: set[str], encoding: str | None = "UTF-8", worksheet_index: int | None = None, **options) -> DataFrame:
    """Cells of files (path, content), each scanned by its extension; columns that only one format has are null elsewhere.

    encoding None: each text's own, as detected; DIF tries the code pages that its writers used."""
    files = files.select(F.col("path").alias("doc_id"), "content", path_extension(F.col("path")).alias("ext"))
    out = []
    for ext in sorted(exts):
        some = files.where(F.col("ext") == ext)
        if ext in TEXT:
            if encoding is None:
                text = decoded_as("content", dif_encoding_of("content") if ext == "dif" else encoding_of("content"))
            else:
                text = F.regexp_replace(F.decode("content", encoding), "^\ufeff", "")
            out.append(scan_text(some.select("doc_id", text.alias("text")), ext, "doc_id", **options))
        else:
            # archives are looked through by their scans
            whole = some if ext in ("xlsx", "ods") else some.where(damage("ext", "content").isNull())
            out.append(BINARY[ext](whole, "doc_id", "content"))
    cells = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
    return cells if worksheet_index is None else cells.where(F.col("sheet_idx") == worksheet_index)


def file_errors(files: DataFrame) -> DataFrame:
    """(path, message) of files (path, content) that have no scan or are damaged."""
    f = files.select("path", "content", path_extension(F.col("path")).alias("ext"))
    unknown = f.where(~F.col("ext").isin(*TEXT, *BINARY)).select("path", F.concat(F.lit("Unsupported file type: "), "ext").alias("message"))
    broken = f.where(F.col("ext").isin(*BINARY)).select("path", damage("ext", "content").alias("message")).where("message is not null")
    return unknown.unionByName(broken)


def read_workbook(spark: SparkSession, path: str, onload: Callable[[DataFrame], None] | None = None, onerror: Callable[[Exception], None] | None = None, **options) -> DataFrame | None:
    """Cells of the file at path. Options: delimiter, table_index, first_row_as_header, encoding, worksheet_index.

    onload gets the cells. ValueError, or a call of onerror with it and None: no path, or an extension without a scan."""
    try:
        if not isinstance(path, str) or not path:
            raise ValueError("Invalid file")
        ext = extension(path)
        if ext not in TEXT and ext not in BINARY:
            raise ValueError(f"Unsupported file type: {ext}")
    except ValueError as e:
        if onerror is None:
            raise
        onerror(e)
        return None
    cells = scan_files(spark.read.format("binaryFile").load(path), {ext}, **options)
    if onload is not None:
        onload(cells)
    return cells


def read_folder(spark: SparkSession, path: str, exts: set[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(cells, errors) of every file under a folder; errors (path, message) has those without a scan and those damaged."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return scan_files(files, exts or TEXT | set(BINARY), **options), file_errors(files)


def workbook_json(cells: DataFrame) -> DataFrame:
    """(workbook_id, json): each workbook's sheets as rows of text, formulas in place of their values."""
    flat = cells.withColumn("v", F.coalesce("formula", "v_str", F.regexp_replace(F.col("v_num").cast("string"), r"\.0$", ""), F.col("v_bool").cast("string")))
    rows = grid(flat, "v").groupBy("workbook_id", "sheet_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))), lambda r: r["cells"]).alias("data"))
    return rows.groupBy("workbook_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("sheet_idx", "data"))), lambda s: F.struct(s["data"].alias("data"))).alias("worksheets"))).alias("json"))
