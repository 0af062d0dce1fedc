"""The relational cell model that every scan returns."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that a task hands on at a time.
ROWS = 20_000

CELL = ["workbook_id", "sheet_idx", "row_idx", "col_idx", "v_type", "v_str", "v_num", "v_bool", "formula"]


def cells(df: DataFrame, *extra: str | Column, kind: Column, text: Column | None = None, num: Column | None = None, flag: Column | None = None, formula: Column | None = None) -> DataFrame:
    """Rows of the cell model from (workbook_id, sheet_idx, row_idx, col_idx, ...); absent parts are null."""
    return df.select(
        "workbook_id", F.col("sheet_idx").cast("int"), F.col("row_idx").cast("int"), F.col("col_idx").cast("int"), kind.alias("v_type"),
        (F.lit(None) if text is None else text).cast("string").alias("v_str"), (F.lit(None) if num is None else num).cast("double").alias("v_num"),
        (F.lit(None) if flag is None else flag).cast("boolean").alias("v_bool"), (F.lit(None) if formula is None else formula).cast("string").alias("formula"), *extra,
    )


def by_text(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "empty").otherwise("string")


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def batches_of(rows: Iterator[tuple], schema: str, size: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Rows of a schema of plain types (`name type, ...`) as batches of at most so many."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    while some := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)


def streamed(docs: DataFrame, key: str, column: str, schema: str, read: Callable[..., Iterator[tuple]]) -> DataFrame:
    """(workbook_id, *schema): what read gives for each value of a column, value by value in one pass; null values give nothing."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, value in enumerate(b.column(1)):
                if value.is_valid:
                    for out in batches_of(read(value.as_py()), schema):
                        keys = b.column(0).take(pa.array([i] * out.num_rows, pa.int64()))
                        yield pa.RecordBatch.from_arrays([keys, *out.columns], ["workbook_id", *out.schema.names])

    return docs.select(F.col(key).alias("k"), F.col(column).alias("v")).mapInArrow(run, f"workbook_id {kind}, {schema}")
