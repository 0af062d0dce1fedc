"""Links within families of sets that signatures brought together but whose pivots did not link.

The consensus of a family is what over half of its sets hold. Each set is written as its difference from it, which
is short for near copies. With G = (100 + p) * |difference| - (100 - p) * |set| and u = G / (2 * (100 + p)), two sets
link at p percent when their differences share u1 + u2 elements or more. So sets whose u add up to 0 or less link to
the set of least u. Any others that link share one of the first |difference| - (u1 + u2) + 1 elements of both, rarest
first, which is a few for each set, as sizes bound the u of what it can link to. Groups by such an element hold at most half of a
family, since over half would have put the element into the consensus. Groups of at most FEW sets are compared pair by
pair; larger ones are parted by classes of u, for which fewer elements do, and what is still large is a family of the
next round. Rounds thus end, each is linear in its rows, and no large group's pairs are listed. What only one set
of a family differs by brings it to no other: a round counts it and leaves it behind. The sets of a family are numbered from 0, so that whoever has all
holders of an element of the consensus knows the sets that lack it: only differences are written, not the sets' elements.

Families of at most WHOLE_SETS sets and WHOLE_SIZE elements, a bound on what a task holds, are done by one task each
(whole_links), in the same way; larger ones by Spark, in rounds (delta_links).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm import kernels as K
from cellweave.llm.components import connected_components
from cellweave.llm.shared import LONG_ROWS, cut, discard, parts_for

#: Sets of a group that are compared pair by pair; ratio of the ends of a class of G.
FEW, STEP = 16, 1.5
#: Sets and elements of a family that one task takes at most, and elements of the families that a bucket stands for.
WHOLE_SETS, WHOLE_SIZE, BUCKET = 4096, 4 << 20, 1 << 20
#: Sets that one task numbers.
NUMBERED = 1 << 16
#: What stands for the elements of a task's sets in a bucket, and the kinds of numbers in its columns.
KINDS = {"fam": np.int64, "i": np.int32, "n": np.int32, "size": np.int32, "x": np.int64}
SENT = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in KINDS)])


def _class(u: Column) -> Column:
    """The class of u; classes are STEP times as wide from one to the next, on both sides of 0."""
    size = F.log(1 + F.abs(u)) / log(STEP)
    return F.when(u >= 0, F.floor(size)).otherwise(-F.ceil(size)).cast("int")


def _least(k: Column) -> Column:
    """No u of class k is smaller."""
    return F.when(k >= 0, F.pow(F.lit(STEP), k) - 1).otherwise(1 - F.pow(F.lit(STEP), -k))


def _members(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Groups of more than one component: keys, n, and columns that tell groups of equal members."""
    one = F.xxhash64("w")
    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("c", *more)]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(one.cast("decimal(20,0)")).alias("h1"), F.bit_xor(one).alias("h2"), *ends)
    return groups.where("min_c < max_c")


def _listed(rows: DataFrame, keys: list[str], unit: int) -> DataFrame:
    """(fam, wa, wb): pairs of the few sets of each group that may link, by where the shared element stands in both."""
    few = rows.groupBy(*keys).agg(F.collect_list(F.struct("w", "c", "g", "d", "at")).alias("all"))

    def may(p: Column, q: Column) -> Column:
        need = F.greatest(F.lit(1), F.ceil((p["g"] + q["g"]) / unit - 1e-6))
        return (p["w"] < q["w"]) & (p["c"] != q["c"]) & (p["at"] <= p["d"] - need) & (q["at"] <= q["d"] - need)

    return few.select("fam", F.explode(_pairs("all", may, "w")).alias("pair")).select("fam", F.col("pair.p").alias("wa"), F.col("pair.q").alias("wb"))


def _pairs(members: str, may: Callable[[Column, Column], Column], name: str) -> Column:
    """The pairs of an array of few structs that may go on, by name."""
    return F.flatten(F.transform(members, lambda p: F.transform(F.filter(members, lambda q: may(p, q)), lambda q: F.struct(p[name].alias("p"), q[name].alias("q")))))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows (fam, key, ...), and i: places from 0 to n - 1 of the n keys of each fam; a key occurs once in it. Written tables, or what gives equal rows each time."""
    slots = parts_for(rows.count(), NUMBERED, 1)
    slotted = rows.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)))
    fam = Window.partitionBy("fam")
    before = fam.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slot = slotted.groupBy("fam", "slot").agg(F.count("*").alias("k"))
    slot = slot.select("fam", "slot", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"), F.sum("k").over(fam).alias("n"))
    place = F.row_number().over(Window.partitionBy("fam", "slot").orderBy(key)) - 1
    return slotted.withColumn("place", place).join(slot, ["fam", "slot"]).withColumn("i", F.col("base") + F.col("place")).drop("slot", "place", "base")


def differences(level: DataFrame, buckets: int) -> DataFrame:
    """(fam, i, x, k): what parts set i of a family from its consensus, if k > 1 sets differ by it; a null x stands for k more that only this set differs by.

    An element goes to one bucket; the elements of a task's sets go to a bucket as one record."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            fam, i, n, size, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            row = np.repeat(np.arange(len(fam)), size)
            bucket = ((K.mix(x.view(np.uint64) ^ K.mix(fam.view(np.uint64))[row]) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            bucket, row, x = bucket[by], row[by], x[by]
            out = []
            for s, e in zip(*K.runs(bucket), strict=True):
                start, end = K.runs(row[s:e])
                own = row[s:e][start]
                cols = zip((fam[own], i[own], n[own], end - start, x[s:e]), KINDS.values(), strict=True)
                out.append((int(bucket[s]), *(c.astype(kind).tobytes() for c, kind in cols)))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SENT, strict=True)], schema=SENT)

        parts, have = [], 0
        for b in batches:
            lists = b.column(3)
            off = lists.offsets.to_numpy().astype(np.int64)
            if off[-1] == off[0]:
                continue
            fam, i, n = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            parts.append((fam, i, n, np.diff(off), lists.values.to_numpy()[off[0] : off[-1]]))
            have += len(parts[-1][4])
            if have >= BUCKET:
                yield sent(parts)
                parts, have = [], 0
        if have:
            yield sent(parts)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        fam, i, n, size, x = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in KINDS.items())
        row = np.repeat(np.arange(len(fam)), size)
        by = np.argsort(x) if (fam == fam[0]).all() else np.lexsort((x, fam[row]))
        row, x = row[by], x[by]
        turn = np.ones(len(x), bool)
        turn[1:] = (x[1:] != x[:-1]) | (fam[row[1:]] != fam[row[:-1]])
        start = np.flatnonzero(turn)
        k, total = np.diff(np.append(start, len(x))), n[row[start]].astype(np.int64)
        most = 2 * k > total
        own = np.repeat(~most & (k > 1), k)
        alone = np.bincount(row[start[~most & (k == 1)]], minlength=len(fam))
        alone = alone, np.flatnonzero(alone)
        # a mark for each set of the family of an element of the consensus, of which those that have it are set
        common = np.flatnonzero(most & (k < total))
        first = np.cumsum(total[common]) - total[common]
        place = np.full(len(start), -1)
        place[common] = first
        place = np.repeat(place, k)
        has = np.zeros(total[common].sum(), bool)
        has[place[place >= 0] + i[row[place >= 0]]] = True
        lacking = np.flatnonzero(~has)
        which = np.searchsorted(first, lacking, "right") - 1
        lacked = common[which]
        rare = (total - k)[lacked]
        rows = (
            (fam[row[own]], i[row[own]], x[own], np.repeat(k, k)[own]),
            (fam[row[start[lacked]]], lacking - first[which], x[start[lacked]], rare),
            (fam[alone[1]], i[alone[1]], np.zeros(len(alone[1]), np.int64), alone[0][alone[1]]),
        )
        fam, i, x, k = (np.concatenate(c).astype(np.int64) for c in zip(*rows, strict=True))
        none = np.concatenate([np.zeros(own.sum(), bool), rare == 1, np.ones(len(alone[1]), bool)])
        return pa.table({"fam": fam, "i": i, "x": pa.array(x, mask=none), "k": k})

    rows = level.select("fam", "i", "n", "xs").mapInArrow(send, "bucket long, fam binary, i binary, n binary, size binary, x binary")
    return rows.groupBy("bucket").applyInArrow(meet, "fam long, i long, x long, k long")


def _round(level: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) to the sets of least u, other links, and the families of the next round."""
    unit = 2 * (100 + percent)
    sized = cut(level.select("fam", "i", "w", "id", "c", "s", "alone", F.size("xs").cast("long").alias("size")), "sized", LONG_ROWS)
    held = cut(differences(level, parts_for(sized.agg(F.sum("size")).first()[0], BUCKET, 48)), "held", LONG_ROWS)
    discard(level)
    # rarest first
    rare = F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("k", "x"))))["x"]
    own = held.groupBy("fam", "i").agg(rare.alias("xs"), F.sum(F.when(F.col("x").isNull(), F.col("k"))).alias("more"))
    apart = sized.join(own, ["fam", "i"], "left").withColumn("alone", F.col("alone") + F.coalesce("more", F.lit(0)))
    apart = apart.select("fam", "w", "id", "c", "s", "alone", F.coalesce("xs", F.array().cast("array<long>")).alias("xs"))
    apart = apart.withColumn("d", F.col("alone") + F.size("xs"))
    apart = apart.withColumn("g", (100 + percent) * F.col("d") - (100 - percent) * F.col("s"))
    apart = cut(apart.withColumn("own", _class(F.col("g") / unit)), "apart", LONG_ROWS)
    discard(held, sized)
    family = cut(apart.groupBy("fam").agg(F.min(F.struct("g", "id", "c")).alias("m")), "family")
    near = cut(apart.join(family, "fam").where("g + m.g <= 0 and c <> m.c").select(F.col("id").alias("a"), F.col("m.id").alias("b"), "c", F.col("m.c").alias("mc")), "near")
    if not near.isEmpty():
        joined = connected_components(near, "c", "mc").select(F.col("node").alias("c"), F.col("component").alias("to"))
        before, apart = apart, cut(apart.join(joined, "c", "left").withColumn("c", F.coalesce("to", "c")).drop("to"), "apart", LONG_ROWS)
        discard(before)
    who = ["fam", "w", "c", "g", "d", "own"]
    u = F.col("g") / unit
    # a set of smaller u links only if all that is needed fits into its own difference, whose set is at most 100 / p as large
    least = F.greatest(F.col("m.g") / unit, u - (F.col("d") - 2 * u) * 100 / percent)
    need = F.greatest(F.lit(1), F.ceil(u + least - 1e-6)).cast("int")
    # what a set alone differs by comes first and brings it to no other
    kept = F.greatest(F.lit(0), F.col("d") - need + 1 - F.col("alone")).cast("int")
    first = apart.join(family, "fam").where(F.col("d") >= need).select(*who, "alone", F.posexplode(F.slice("xs", 1, kept)).alias("at", "x"))
    first = cut(first.withColumn("at", F.col("at") + F.col("alone")).drop("alone"), "first", LONG_ROWS)
    keys = ["fam", "x"]
    classes = first.groupBy(*keys).agg(F.count("*").alias("n"), F.collect_set("own").alias("ks")).where(F.col("n") > FEW).drop("n")
    groups = cut(_members(first, keys).select(*keys, "n").join(classes, keys, "left"), "groups")
    pairs = _listed(first.join(groups.where(F.col("n") <= FEW).drop("ks"), keys), keys, unit)

    def meets(k: Column) -> Column:
        return (u + _least(k + 1) > 0) & (F.col("at") <= F.col("d") - F.greatest(F.lit(1), F.ceil(u + _least(k) - 1e-6)))

    # a set has a row for each class that its group holds and that it can link to, no more
    large = first.join(groups.where(F.col("n") > FEW).drop("n"), keys).withColumn("other", F.explode(F.filter("ks", meets))).drop("ks")
    large = cut(large.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")), "large")
    keys = ["fam", "lo", "hi", "x"]
    few, groups = groups, cut(_members(large, keys, "own").where("lo = hi or min_own < max_own").select(*keys, "n", "h1", "h2"), "groups")
    pairs = pairs.unionByName(_listed(large.join(groups.where(F.col("n") <= FEW).select(*keys), keys), keys, unit)).distinct()
    side = [apart.select("fam", F.col("w").alias(f"w{e}"), F.col("id").alias(e), F.col("g").alias(f"g{e}"), F.col("xs").alias(f"x{e}")) for e in "ab"]
    both = pairs.join(side[0], ["fam", "wa"]).join(side[1], ["fam", "wb"])
    more = both.where(F.col("ga") + F.col("gb") <= unit * F.size(F.array_intersect("xa", "xb")).cast("long")).select("a", "b")
    many = groups.where(F.col("n") > FEW).groupBy("n", "h1", "h2").agg(F.min(F.struct(*keys)).alias("key")).select("key.*")
    many = cut(large.join(many, keys).select(F.col("fam").alias("of"), "w", F.xxhash64(*keys).alias("fam")).distinct(), "many")
    following = numbered(many, "w").join(apart.withColumnRenamed("fam", "of"), ["of", "w"]).select("fam", "i", "n", "w", "id", "c", "s", "alone", "xs")
    links, following = cut(more, "links", LONG_ROWS), cut(following, "level", LONG_ROWS)
    discard(apart, family, first, few, large, groups, many)
    return near.select("a", "b"), links, following


def delta_links(level: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join whatever components c the links within each family join.

    level (fam, w, id, c, s, xs): a row for each different set of a family, named w there, of s elements, of document id in
    component c; xs: its difference from any one set of reference of its family, such as the empty one. Columns i and n, where given:
    the set's number in its family (see numbered) and how many sets it has. A written table of cut, deleted by the first round.
    Pairs already in one component need not be in the result; every pair in it links."""
    found = level.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    if "i" not in level.columns:
        before, level = level, cut(level.join(numbered(level.select("fam", "w"), "w"), ["fam", "w"]), "level", LONG_ROWS)
        discard(before)
    first, level = level, level.withColumn("alone", F.lit(0).cast("long"))
    level._cut_path = getattr(first, "_cut_path", None)
    while not level.isEmpty():
        near, more, level = _round(level, percent)
        found = found.unionByName(near).unionByName(more)
    return cut(found, "found")


def _family_links(ids: np.ndarray, comps: np.ndarray, row: np.ndarray, h: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) that join the components of one family; row and h: the elements of each set."""
    n, unit = len(ids), 2 * (100 + percent)
    s = np.bincount(row, minlength=n)
    kinds, x, count = np.unique(h, return_inverse=True, return_counts=True)
    common = np.flatnonzero(2 * count > n)
    place = np.full(len(kinds), -1)
    place[common] = np.arange(len(common))
    has = np.zeros((n, len(common)), bool)
    shared = place[x] >= 0
    has[row[shared], place[x[shared]]] = True
    lacks = np.nonzero(~has)
    row, x = np.concatenate([row[~shared], lacks[0]]), np.concatenate([x[~shared], common[lacks[1]]])
    by = np.lexsort((x, np.minimum(count, n - count)[x], row))
    row, x = row[by], x[by]
    d = np.bincount(row, minlength=n)
    first = np.cumsum(d) - d
    at = np.arange(len(row)) - first[row]
    g = (100 + percent) * d - (100 - percent) * s
    u = g / unit
    parent = {int(c): int(c) for c in comps}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []

    def link(i: int, j: int) -> None:
        a, b = root(int(comps[i])), root(int(comps[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))

    least = np.lexsort((ids, g))[0]
    for i in np.flatnonzero(g + g[least] <= 0).tolist():
        link(i, least)
    group = np.array([root(int(c)) for c in comps])
    need = np.maximum(1, np.ceil(u + np.maximum(u[least], u - (d - 2 * u) * 100 / percent) - 1e-6))
    kept = np.flatnonzero(at <= (d - need)[row])
    kept = kept[np.argsort(x[kept], kind="stable")]
    who, pos, what = row[kept], at[kept], x[kept]
    end = np.searchsorted(what, what, "right")
    here, step, codes = np.arange(len(what)), 1, []
    while len(here := here[here + step < end[here]]):
        i, j = who[here], who[here + step]
        t = np.maximum(1, np.ceil(u[i] + u[j] - 1e-6))
        may = (group[i] != group[j]) & (pos[here] <= d[i] - t) & (pos[here + step] <= d[j] - t)
        codes.append(np.unique(np.minimum(i, j)[may] * n + np.maximum(i, j)[may]))
        step += 1
    for code in np.unique(np.concatenate(codes)).tolist() if codes else ():
        i, j = divmod(code, n)
        if root(int(comps[i])) != root(int(comps[j])):
            both = len(np.intersect1d(x[first[i] : first[i] + d[i]], x[first[j] : first[j] + d[j]], assume_unique=True))
            if g[i] + g[j] <= unit * both:
                link(i, j)
    return out


def whole_links(sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(a, b) as delta_links gives them, of families that a task may hold; sets: (fam, w, id, c, xs)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("fam").combine_chunks()
        fam, ids, comps = (table[c].to_numpy() for c in ("fam", "id", "c"))
        lists = table["xs"].combine_chunks()
        off, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        out = []
        edges = np.flatnonzero(np.diff(fam, prepend=fam[0] - 1, append=fam[-1] + 1))
        for i, j in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            size = np.diff(off[i : j + 1])
            out += _family_links(ids[i:j], comps[i:j], np.repeat(np.arange(j - i), size), values[off[i] : off[j]], percent)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    rows = sets.select(F.pmod(F.xxhash64("fam"), F.lit(buckets)).alias("bucket"), "fam", "id", "c", "xs")
    return rows.groupBy("bucket").applyInArrow(run, "a long, b long")
