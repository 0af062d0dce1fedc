"""Cell-reference algebra as Column expressions: names, coordinates, ranges and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"\$?[A-Z]{1,3}\$?[0-9]+"
#: A1, A1:B2, A:A and 1:1, each with $ and after an optional sheet; a quoted sheet has no colon.
TOKEN = rf"^(?:(?:'[^':]+'|[A-Za-z0-9_.]+)!)?(?:{_PART}(?::{_PART})?|\$?[A-Z]{{1,3}}:\$?[A-Z]{{1,3}}|\$?[0-9]+:\$?[0-9]+)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def column_name(index: Column | str) -> Column:
    """Letters of a 0-based column: 0 is A, 26 is AA. Negative gives '', null gives null."""
    n = _col(index).cast("long")

    def step(acc: Column, _: Column) -> Column:
        more = acc["n"] > 0
        rest = F.when(more, F.floor((acc["n"] - 1) / 26).cast("long")).otherwise(acc["n"])
        letter = F.char((acc["n"] - 1) % 26 + 65)
        return F.struct(rest.alias("n"), F.when(more, F.concat(letter, acc["s"])).otherwise(acc["s"]).alias("s"))

    start = F.struct((n + 1).alias("n"), F.lit("").alias("s"))
    letters = F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda acc: acc["s"])
    return F.when(n < 0, F.lit("")).when(n.isNotNull(), letters)


def column_index(letters: Column | str) -> Column:
    """0-based column of letters in either case; '' and null give null."""
    s = F.upper(_col(letters))
    return F.when(F.length(s) > 0, F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64) - 1)


def cell_name(col: Column | str, row: Column | str) -> Column:
    """A1 name of 0-based coordinates."""
    return F.concat(column_name(col), (_col(row) + 1).cast("string"))


def coords(name: Column | str) -> Column:
    """struct(col, row) of an A1 name, 0-based; all but A-Z and digits is ignored, a missing part is null."""
    s = _col(name)
    letters, digits = F.regexp_replace(s, "[^A-Z]", ""), F.regexp_replace(s, "[^0-9]", "")
    row = F.when(digits != "", digits.cast("int") - 1)
    return F.struct(column_index(letters).alias("col"), row.alias("row"))


def range_coords(ref: Column | str) -> Column:
    """struct(x1, y1, x2, y2) of a range or a cell; a sheet prefix is dropped, missing parts are 0."""
    bare = F.element_at(F.split(_col(ref), "!"), -1)
    ends = F.split(bare, ":")
    a, b = coords(F.element_at(ends, 1)), coords(F.element_at(ends, -1))
    zero = F.lit(0)
    return F.struct(
        F.coalesce(a["col"], zero).alias("x1"), F.coalesce(a["row"], zero).alias("y1"),
        F.coalesce(b["col"], zero).alias("x2"), F.coalesce(b["row"], zero).alias("y2"),
    )


def range_tokens(x1: Column, y1: Column, x2: Column, y2: Column, sheet: Column | None = None) -> Column:
    """A1 names of a rectangle, row by row, each behind `sheet!` if a sheet is given."""
    prefix = F.lit("") if sheet is None else F.when(F.coalesce(sheet, F.lit("")) != "", F.concat(sheet, F.lit("!"))).otherwise("")
    return F.flatten(F.transform(F.sequence(y1, y2), lambda y: F.transform(F.sequence(x1, x2), lambda x: F.concat(prefix, cell_name(x, y)))))


def is_token(text: Column | str) -> Column:
    """Whether text is a cell or range reference; null is none."""
    return F.coalesce(_col(text).rlike(TOKEN), F.lit(False))
