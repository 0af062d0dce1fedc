"""Transforms of the cell model: bounds, grids, dictionaries, ranges, neighbours and cursors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.functions.refs import column_name
from cellweave.functions.text import without_property

SHEET = ["workbook_id", "sheet_idx"]


def bounds(cells: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """(workbook_id, sheet_idx, max_row, max_col), far corners of merged ranges included."""
    at = cells.select(*SHEET, "row_idx", "col_idx")
    if merges is not None:
        at = at.unionByName(merges.select(*SHEET, (F.col("row_idx") + F.col("rowspan") - 1).alias("row_idx"), (F.col("col_idx") + F.col("colspan") - 1).alias("col_idx")))
    return at.groupBy(*SHEET).agg(F.max("row_idx").alias("max_row"), F.max("col_idx").alias("max_col"))


def densify(cells: DataFrame, value: str, fill: object, merges: DataFrame | None = None, max_cells: int | None = None) -> DataFrame:
    """(workbook_id, sheet_idx, row_idx, col_idx, value) of every slot up to the bounds; holes get fill.

    max_cells: sheets with more slots stay as they are, sparse. One shuffle on the slot for the join; slots come from
    their sheet's bounds row by row, so no product of tables is made."""
    b = bounds(cells, merges)
    if max_cells is not None:
        b = b.withColumn("fits", (F.col("max_row") + 1).cast("long") * (F.col("max_col") + 1) <= max_cells)
        sparse = cells.join(b.where("not fits").select(*SHEET), SHEET, "left_semi").select(*SHEET, "row_idx", "col_idx", value)
        b = b.where("fits")
    rows = b.select(*SHEET, "max_col", F.explode(F.sequence(F.lit(0), "max_row")).alias("row_idx")).repartition(*SHEET, "row_idx")
    slots = rows.select(*SHEET, "row_idx", F.explode(F.sequence(F.lit(0), "max_col")).alias("col_idx"))
    out = slots.join(cells.select(*SHEET, "row_idx", "col_idx", value), [*SHEET, "row_idx", "col_idx"], "left")
    out = out.withColumn(value, F.coalesce(value, F.lit(fill)))
    return out if max_cells is None else out.unionByName(sparse)


def grid(cells: DataFrame, value: str, fill: str = "") -> DataFrame:
    """(workbook_id, sheet_idx, row_idx, cells array<string>): a row's values in place, padded to the sheet's width."""
    width = bounds(cells).select(*SHEET, "max_col")
    rows = cells.groupBy(*SHEET, "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", F.col(value).cast("string")))).alias("m"))
    laid = F.transform(F.sequence(F.lit(0), "max_col"), lambda c: F.coalesce(F.element_at("m", c), F.lit(fill)))
    return rows.join(width, SHEET).select(*SHEET, "row_idx", laid.alias("cells"))


def style_dictionary(cells: DataFrame, css: str = "css", order: tuple[str, ...] = ("sheet_idx", "row_idx", "col_idx")) -> tuple[DataFrame, DataFrame]:
    """(styles, cells with style_idx): texts numbered within a workbook by first appearance.

    The dictionary is aggregated before it is ranked, so the ranked rows are the distinct texts."""
    first = cells.where(F.col(css).isNotNull()).groupBy("workbook_id", css).agg(F.min(F.struct(*order)).alias("first"))
    styles = first.select("workbook_id", css, (F.row_number().over(W.partitionBy("workbook_id").orderBy("first")) - 1).alias("style_idx"))
    return styles, cells.join(styles, ["workbook_id", css], "left")


def border_dedup(cells: DataFrame, css: str = "css") -> DataFrame:
    """Cells without a left border beside a right one, and without a top border below a bottom one."""
    across = W.partitionBy(*SHEET, "row_idx").orderBy("col_idx")
    down = W.partitionBy(*SHEET, "col_idx").orderBy("row_idx")

    def meets(over: W, at: str, side: str) -> Column:
        beside = (F.lag(at).over(over) == F.col(at) - 1) & F.contains(F.coalesce(F.lag(css).over(over), F.lit("")), F.lit(f"border-{side}:"))
        return F.coalesce(beside, F.lit(False))

    t = cells.withColumn("_l", meets(across, "col_idx", "right")).withColumn("_t", meets(down, "row_idx", "bottom"))
    left = F.when(F.col("_l"), without_property(F.col(css), "border-left")).otherwise(F.col(css))
    t = t.withColumn(css, left)
    return t.withColumn(css, F.when(F.col("_t"), without_property(F.col(css), "border-top")).otherwise(F.col(css))).drop("_l", "_t")


def styled(cells: DataFrame, css: str = "css") -> tuple[DataFrame, DataFrame]:
    """(styles, cells) of style_dictionary after border_dedup; a style text without properties is none."""
    bare = border_dedup(cells, css)
    return style_dictionary(bare.withColumn(css, F.nullif(css, F.lit(""))), css)


def dyadic_blocks(lo: Column, hi: Column, levels: int) -> Column:
    """array<struct<level, block>>: the fewest aligned blocks of 2**level rows that make up the rows from lo to hi; at most two a level.

    From both ends inwards: a block that has no sibling within the range is taken, and the rest goes on to blocks of twice the size.
    Blocks of the highest level are taken one by one."""
    start = F.struct(lo.cast("long").alias("a"), hi.cast("long").alias("z"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def take(when: Column, level: Column, block: Column) -> Column:
        return F.when(when, F.array(F.struct(level.cast("int").alias("level"), block.alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))

    def step(acc: Column, level: Column) -> Column:
        a, z = acc["a"], acc["z"]
        left, right = (a <= z) & (a % 2 == 1), (z > a) & (z % 2 == 0) | (z == a) & (a % 2 == 0)
        top = F.when(a <= z, F.transform(F.sequence(a, z), lambda b: F.struct(level.cast("int").alias("level"), b.alias("block"))))
        here = F.when(level == levels, F.coalesce(top, F.array().cast("array<struct<level:int,block:bigint>>"))).otherwise(F.concat(take(left, level, a), take(right, level, z)))
        up = F.when(left, a + 1).otherwise(a), F.when(right, z - 1).otherwise(z)
        return F.struct(F.shiftright(up[0], 1).alias("a"), F.when(up[0] > up[1], F.lit(-1).cast("long")).otherwise(F.shiftright(up[1], 1)).alias("z"), F.concat(acc["out"], here).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda acc: acc["out"])


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], rank: str, levels: int = 24) -> DataFrame:
    """points with rank of the first range (r1..r2, c1..c2; smallest rank) that holds them, or null.

    A range is laid out as its dyadic blocks of rows, at most two a level whatever its height; a cell looks into the blocks that hold its
    row, one a level, of the levels at which ranges of its key have any. So the join is one of equal keys, a range over whole columns
    costs as many rows as a low one, and between only checks columns: a block lies wholly in its range."""
    r = ranges.withColumn("_b", F.explode(dyadic_blocks(F.col("r1"), F.col("r2"), levels))).select(*keys, "_b.level", "_b.block", "c1", "c2", rank)
    used = r.groupBy(*keys).agg(F.array_sort(F.collect_set("level")).alias("_levels"))
    p = points.select(*keys, "row_idx", "col_idx").distinct().join(used, keys)
    p = p.withColumn("level", F.explode("_levels")).withColumn("block", F.expr("shiftright(cast(row_idx as bigint), level)"))
    hit = p.join(r, [*keys, "level", "block"]).where("col_idx between c1 and c2")
    first = hit.groupBy(*keys, "row_idx", "col_idx").agg(F.min(rank).alias(rank))
    return points.join(first, [*keys, "row_idx", "col_idx"], "left")


def range_explode(ranges: DataFrame) -> DataFrame:
    """A row for every cell of (r1..r2, c1..c2); other columns stay."""
    rest = [c for c in ranges.columns if c not in ("r1", "r2", "c1", "c2")]
    rows = ranges.select(*rest, "c1", "c2", F.explode(F.sequence("r1", "r2")).alias("row_idx"))
    return rows.select(*rest, "row_idx", F.explode(F.sequence("c1", "c2")).alias("col_idx"))


def repeat_explode(runs: DataFrame, keys: list[str], order: str, times: str, out: str) -> DataFrame:
    """Run-length coded rows laid out: each repeats, and out counts on over its group."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    t = runs.withColumn("_from", F.coalesce(F.sum(times).over(before), F.lit(0)).cast("long")).where(F.col(times) > 0)
    return t.withColumn(out, F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col(times) - 1))).drop("_from")


def header_promote(cells: DataFrame, value: str = "v_str") -> DataFrame:
    """Cells with the first row as title; a column without one gets its letters; rows move up."""
    head = cells.where("row_idx = 0").select(*SHEET, "col_idx", F.col(value).alias("title"))
    body = cells.where("row_idx > 0").withColumn("row_idx", F.col("row_idx") - 1)
    out = body.join(head, [*SHEET, "col_idx"], "left")
    return out.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), column_name("col_idx")))


def validation_union(first: DataFrame, *more: DataFrame, sheet: str = "sheet_name", ref: str = "range") -> DataFrame:
    """Rules of all sheets; a range without a sheet gets its own."""
    out = first
    for x in more:
        out = out.unionByName(x)
    return out.withColumn(ref, F.when(F.instr(ref, "!") > 0, F.col(ref)).otherwise(F.concat(sheet, F.lit("!"), ref)))


def bounding_box(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r1, c1, r2, c2): the smallest rectangle over all ranges of a key."""
    return ranges.groupBy(*keys).agg(F.min("r1").alias("r1"), F.min("c1").alias("c1"), F.max("r2").alias("r2"), F.max("c2").alias("c2"))


def default_columns(cells: DataFrame, columns: DataFrame, width: float = 100.0) -> DataFrame:
    """(workbook_id, sheet_idx, col_idx, title, width_px) of every column up to the bounds; stored ones keep their width."""
    every = bounds(cells).select(*SHEET, F.explode(F.sequence(F.lit(0), "max_col")).alias("col_idx"))
    out = every.join(columns.select(*SHEET, "col_idx", "width_px"), [*SHEET, "col_idx"], "left")
    return out.select(*SHEET, "col_idx", column_name("col_idx").alias("title"), F.coalesce("width_px", F.lit(width)).alias("width_px"))


#: Rows of a segment of a mergeable scan.
SEGMENT = 1 << 14


def before_segments(df: DataFrame, keys: list[str], sums: dict[str, Column], merge: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """df (with _seg, a segment's number in its group) and _before: the merged sums of all earlier segments of its group, null in the first.

    Each segment is summed up by itself; a group's sums, one a segment, are merged in order. merge gives the sums of an earlier and a later
    part as those of both."""
    each = df.groupBy(*keys, "_seg").agg(*(c.alias(n) for n, c in sums.items()))
    kind = "struct<" + ",".join(f"{n}:{t}" for n, t in each.dtypes if n in sums) + ">"
    rows = F.array_sort(F.collect_list(F.struct("_seg", F.struct(*sums).alias("s"))))
    zero = F.struct(F.lit(None).cast(kind).alias("s"), F.array().cast(f"array<struct<_seg:bigint,s:{kind}>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        both = F.when(acc["s"].isNull(), x["s"]).otherwise(F.struct(*(c.alias(n) for n, c in merge(acc["s"], x["s"]).items())).cast(kind))
        return F.struct(both.alias("s"), F.concat(acc["out"], F.array(F.struct(x["_seg"].alias("_seg"), acc["s"].alias("s")))).alias("out"))

    b = each.groupBy(*keys).agg(rows.alias("_rows")).withColumn("_x", F.explode(F.aggregate("_rows", zero, step, lambda acc: acc["out"])))
    b = b.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_x._seg").alias("_kseg"), F.col("_x.s").alias("_before"))
    same = reduce(lambda x, y: x & y, (df[k].eqNullSafe(b[f"_k{i}"]) for i, k in enumerate(keys)), df["_seg"] == b["_kseg"])
    return df.join(b, same).select(*df.columns, "_before")


def sticky(df: DataFrame, keys: list[str], order: str, *names: str, segment: int | Column = SEGMENT) -> DataFrame:
    """Each named column's last non-null value so far within its group.

    A group is cut into segments of its order, so that its rows are sorted by many tasks; see before_segments. segment: how many of an
    order of whole numbers make one; for other orders a whole number that never falls along the order."""
    t = df.withColumn("_seg", F.floor(F.col(order) / segment) if isinstance(segment, int) else segment.cast("long"))
    sums = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) for c in names}
    t = before_segments(t, keys, sums, lambda a, x: {c: F.coalesce(x[c], a[c]) for c in names})
    over = W.partitionBy(*keys, "_seg").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return t.select(*(F.coalesce(F.last(c, True).over(over), F.col(f"_before.{c}")).alias(c) if c in names else F.col(c) for c in df.columns))


def running_sums(df: DataFrame, keys: list[str], order: str, *names: str, segment: int = SEGMENT) -> DataFrame:
    """df with each named column's sum so far within its group, its own value included; order: whole numbers without large gaps."""
    t = df.withColumn("_seg", F.floor(F.col(order) / segment))
    t = before_segments(t, keys, {c: F.coalesce(F.sum(c), F.lit(0)) for c in names}, lambda a, b: {c: a[c] + b[c] for c in names})
    over = W.partitionBy(*keys, "_seg").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return t.select(*((F.coalesce(F.sum(c).over(over), F.lit(0)) + F.coalesce(F.col(f"_before.{c}"), F.lit(0))).alias(c) if c in names else F.col(c) for c in df.columns))


def cursor(df: DataFrame, keys: list[str], order: str, x: str, y: str, moves: str, segment: int = SEGMENT) -> DataFrame:
    """df with row_idx and col_idx (from 0) of a cursor that stays: y is the last y so far; x the last x so far, and one more for each row
    since then whose moves is true. x and y count from 1, and are 1 before any.

    Mergeable: a segment is summed up as its last x, its last y, and its moving rows from that x on, or all without one."""
    t = df.withColumn("_seg", F.floor(F.col(order) / segment)).withColumn("_m", F.col(moves).cast("long"))
    own = W.partitionBy(*keys, "_seg").orderBy(order)
    t = t.withColumn("_moved", F.coalesce(F.sum("_m").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    has_x = F.when(F.col(x).isNotNull(), F.col(order))
    sums = {"x": F.max_by(x, has_x), "y": F.max_by(y, F.when(F.col(y).isNotNull(), F.col(order))), "since": F.coalesce(F.sum("_m"), F.lit(0)) - F.coalesce(F.max_by("_moved", has_x), F.lit(0))}

    def merge(a: Column, b: Column) -> dict[str, Column]:
        return {"x": F.coalesce(b["x"], a["x"]), "y": F.coalesce(b["y"], a["y"]), "since": b["since"] + F.when(b["x"].isNull(), a["since"]).otherwise(0)}

    t = before_segments(t, keys, sums, merge)
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    at = F.last(F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("x"), F.col("_moved").alias("moved"))), True).over(upto)
    t = t.withColumn("_at", at).withColumn("_y", F.coalesce(F.last(y, True).over(upto), F.col("_before.y"), F.lit(1)))
    here = F.col("_at.x") + F.col("_moved") - F.col("_at.moved")
    earlier = F.coalesce("_before.x", F.lit(1)) + F.coalesce("_before.since", F.lit(0)) + F.col("_moved")
    return t.select(*df.columns, (F.col("_y") - 1).cast("int").alias("row_idx"), (F.coalesce(here, earlier) - 1).cast("int").alias("col_idx"))


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: str, *take: str) -> DataFrame:
    """left with the columns of the first row of right by order that has its keys."""
    first = right.groupBy(*keys).agg(F.min_by(F.struct(*take), order).alias("_m"))
    return left.join(first, keys, "left").select(*left.columns, *(F.col(f"_m.{c}").alias(c) for c in take))
