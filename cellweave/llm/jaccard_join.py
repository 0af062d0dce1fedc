"""Exact Jaccard join of documents on word shingles by a partition of the token universe.

A shingle's hash assigns it to one of m segments. Two sets of a size band that link differ in at most H shingles,
so if the segments' allotted thresholds add up to H + 1, they differ within some segment by less than its
threshold: 1 asks for equal segments, 2 for one shingle more or less, met by one-deletion neighbours. A band's
plan (m, how many segments get 2, how many more stand in for empty ones) is the cheapest by signatures written
and by chance matches, whose number follows from the sets counted in the band. Empty segments of threshold 1 are
not indexed: the spare segments stand in for them, and a set with more empty ones signs them too. So every linked
pair shares a signature, and only such pairs are compared. With thresholds of 1 a set has a signature a segment,
with 2 one a shingle besides, so the plan takes 2 where chance matches cost more: in bands of small sets.

Pairs within a signature's group are not listed. Each task links its members to local pivots, a bucket links
local pivots to pivots of all, and each such pair is verified on the whole texts. Parity bitmaps of the sets rule
out most pairs before texts are fetched. Where a pair fails, its group's sets may link to one another. Groups of at
most GROUP sets are gone through by their bitmaps in a task, which lists what these leave open if that is few pairs a
set (open_groups). The sets of other groups are joined again on their differences from a consensus (delta_links), which
lists no group's pairs either.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import kernels as K
from cellweave.llm.components import connected_components
from cellweave.llm.delta_links import BUCKET as FAMILIES
from cellweave.llm.delta_links import WHOLE_SETS, WHOLE_SIZE, delta_links, numbered, whole_links
from cellweave.llm.shared import LONG_ROWS, cut, discard, lean_workers, parts_for, text_bytes, utf8

U = np.uint64
#: Ratio of a size band's ends.
BAND = 1.3
#: Cost of a chance match against that of a signature.
MATCH = 40.0
#: Signatures that a task gathers before it sends them, and text bytes that a bucket stands for.
FLUSH, BUCKET = 1 << 20, 8 << 20
#: Orders by which pivots are chosen; a signature's hash says which.
PIVOTS = 3
#: Words of 64 bits in a set's parity bitmap, at least; large sets have a bit a shingle.
MAP = 16
#: Signatures that a pair of one task or bucket carries along; of pairs with more, they are found again from the texts.
CARRIED = 8
#: Sets of a group whose bitmaps one task compares, open pairs a set that it lists at most, and rows that a bucket of groups stands for.
GROUP, OPEN, GROUPED = 1024, 4, 1 << 14
#: Words of bitmaps that are compared at once.
WORDS = 1 << 20

#: (segments, how many of them have threshold 2, spare ones) of each band, by its place.
Plans = tuple[tuple[int, int, int], ...]


@cache
def band_edges(most: int) -> tuple[int, ...]:
    """Smallest sizes of the bands, until one is over most."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return tuple(edges)


@cache
def plan(low: int, high: int, percent: int, sets: float) -> tuple[int, int, int]:
    """(segments, how many of them have threshold 2, spare) for pairs whose larger set has low to high shingles.

    sets: how many sets sign the band. The smallest of them has percent of low shingles, which sets the empty segments."""
    differ = 2 * high * (100 - percent) // (100 + percent)
    if differ == 0:
        return 1, 0, 0
    small = max(1, low * percent // 100)
    half = (differ + 1) // 2
    best = None
    for twos in sorted({*range(min(half, 16) + 1), half // 4, half // 2, half}):
        for widths in range(5):
            m, spare = differ + 1 - twos, 0
            for _ in range(16):  # spare segments add empty ones in turn
                empty = m * (1 - 1 / m) ** small
                spare = int(empty + widths * empty**0.5) if widths else 0
                if (now := differ + 1 - twos + spare) == m:
                    break
                m = now
            empty, single = (1 - 1 / m) ** small, small / m * (1 - 1 / m) ** (small - 1) if m > 1 else 0.0
            mean = max(0, m - twos) * empty
            # a segment of threshold 2 that is empty, or is so without its one shingle, meets all others like it
            signed = mean * _beyond(mean, spare) + twos * (empty + single)
            met = min(1.0, sets * (empty + single))
            cost = m + twos * small / m + MATCH * signed * met
            if best is None or cost < best[0]:
                best = cost, m, twos, m + twos - differ - 1
    return best[1:]


def _beyond(mean: float, spare: int) -> float:
    """The chance of more than spare empty segments, which are nearly Poisson."""
    if mean <= 0:
        return 0.0
    term = below = exp(-mean)
    for k in range(1, spare + 1):
        term *= mean / k
        below += term
    return max(0.0, 1 - below)


def plans(counts: dict[int, int], most: int, percent: int) -> Plans:
    """A plan for each band up to that of the largest set, from the number of sets by band."""
    edges = band_edges(most * 100 // percent + 1)
    out = []
    for band, (low, end) in enumerate(zip(edges, edges[1:], strict=False)):
        first = max(i for i, e in enumerate(edges) if e <= max(1, low * percent // 100))
        out.append(plan(low, end - 1, percent, float(sum(counts.get(i, 0) for i in range(first, band + 1)))))
    return tuple(out)


def signatures(row: np.ndarray, h: np.ndarray, sizes: np.ndarray, percent: int, plan_of: Plans) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature of each indexed segment; row and h are the distinct shingles by row."""
    if not len(sizes) or not sizes.max():
        return row[:0], h[:0]
    edges = np.array(band_edges(int(sizes.max()) * 100 // percent + 1))
    own = np.searchsorted(edges, sizes, "right") - 1
    last = np.searchsorted(edges, sizes * 100 // percent, "right") - 1
    rows, out = [], []
    first = np.concatenate([[0], np.cumsum(sizes)])
    for band in np.unique(np.concatenate([own[sizes > 0], last[sizes > 0]])).tolist():
        m, twos, spare = plan_of[band]
        docs = np.flatnonzero((own <= band) & (band <= last) & (sizes > 0))
        if not len(docs):
            continue
        size = sizes[docs]
        at = np.repeat(first[docs] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        x = K.mix(h[at] + U(0xA0761D6478BD642F))
        seg = ((x >> U(32)) * U(m) >> U(32)).astype(np.int64)
        doc = np.repeat(np.arange(len(docs)), size)
        cell = doc * m + seg
        total = np.zeros(len(docs) * m, np.uint64)
        np.add.at(total, cell, x)
        held = np.bincount(cell, minlength=len(total))
        salt = K.mix(U(band * 0x9E3779B9 + 1) + np.arange(m, dtype=np.uint64) * U(0x632BE59BD9B4E019))
        exact = K.mix(total ^ np.tile(salt, len(docs)))
        bare = held == 0
        sign = ~bare
        sparse = bare.reshape(-1, m)[:, twos:].sum(1) > spare
        sign |= np.repeat(sparse, m)
        if twos:
            sign |= np.tile(np.arange(m) < twos, len(docs))  # one shingle against none counts there
        which = np.flatnonzero(sign)
        rows.append(docs[which // m])
        out.append(exact[which])
        if twos:
            some = seg < twos
            rows.append(docs[doc[some]])
            out.append(K.mix((total[cell[some]] - x[some]) ^ salt[seg[some]]))
    return np.concatenate(rows), np.concatenate(out)


def local_stars(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Pivot (signature, id) of each group, and distinct (member, pivot) of all others with their signatures.

    The pivot is the smallest id in one of PIVOTS orders, so that members meet few pivots but not one only."""
    order = (sig % U(PIVOTS)).astype(np.uint64)
    rank = K.mix(ids.view(np.uint64) ^ K.mix(order + U(1)))
    by = np.lexsort((ids, rank, sig))
    sig, ids = sig[by], ids[by]
    start, end = K.runs(sig)
    pivot = np.repeat(ids[start], end - start)
    other = np.flatnonzero(ids != pivot)
    other = other[np.lexsort((sig[other], pivot[other], ids[other]))]
    a, b, s = ids[other], pivot[other], sig[other]
    turn = np.ones(len(a), bool)
    turn[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(turn)
    last = np.append(first[1:], len(a))[: len(first)]
    carried = [s[i:j].tobytes() if j - i <= CARRIED else None for i, j in zip(first.tolist(), last.tolist(), strict=True)]
    return sig[start], ids[start], pa.table({"a": a[first], "b": b[first], "sig": pa.array(carried, pa.binary())})


SENT = pa.schema([("bucket", pa.int64()), ("sig", pa.binary()), ("ids", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])


def _sets(batches: Iterator[pa.RecordBatch], n: int):
    """(ids, row, hash, sizes) of the distinct shingles of each block of rows."""
    for batch in batches:
        buf, off = K.flat(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in K.blocks(off):
            o = off[i : j + 1] - off[i]
            row, h = K.distinct(*K.shingles(buf[off[i] : off[j]], o, n))
            yield ids[i:j], row, h, np.bincount(row, minlength=j - i)


def _copies(row: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each set; it does not depend on the order of its shingles."""
    out = []
    for salt in (0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9):
        total = np.zeros(len(sizes), np.uint64)
        np.add.at(total, row, K.mix(h ^ U(salt)))
        out.append(K.mix(total + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def parity(row: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The parity bitmap of each set: MAP words, or the power of two that has a bit a shingle.

    A bitmap folds to half its size by xor of its halves, so any two can be compared."""
    x = K.mix(h ^ U(0xE7037ED1A0B428DB))
    width = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes, MAP * 64) / 64)).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(width)])
    wide = np.zeros(off[-1], np.uint64)
    np.bitwise_xor.at(wide, off[row] + ((x >> U(6)).astype(np.int64) & (width[row] - 1)), U(1) << (x & U(63)))
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(wide.view(np.int64)))


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, c1, c2, wide): the size of each document's set, a 128-bit hash and the parity bitmap of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, h, sizes in _sets(batches, n):
            c1, c2 = _copies(row, h, sizes)
            cols = [pa.array(x) for x in (ids.astype(np.int64), sizes.astype(np.int64), c1, c2)]
            yield pa.RecordBatch.from_arrays([*cols, parity(row, h, sizes)], ["id", "n_shingles", "c1", "c2", "wide"])

    return docs.mapInArrow(run, "id long, n_shingles long, c1 long, c2 long, wide array<long>")


def _maps(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each bitmap starts, its words, and the words of all."""
    off = column.offsets.to_numpy()
    return off[:-1], np.diff(off), column.values.to_numpy().view(np.uint64)


def _can(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], percent: int) -> np.ndarray:
    """Whether sizes and bitmaps of pairs allow a link; left and right: size, start and words of each pair's end, and the words of all."""
    (sa, oa, wa, bits_a), (sb, ob, wb, bits_b) = left, right
    can = (100 * sa >= percent * sb) & (100 * sb >= percent * sa)
    for va, vb in {*zip(wa[can].tolist(), wb[can].tolist(), strict=True)}:
        same, least = np.flatnonzero(can & (wa == va) & (wb == vb)), min(va, vb)
        for k in range(0, len(same), each := max(1, WORDS // max(va, vb))):
            rows = same[k : k + each]
            fold = [np.bitwise_xor.reduce(bits[off[rows][:, None] + np.arange(w)].reshape(len(rows), -1, least), axis=1) for off, w, bits in ((oa, va, bits_a), (ob, vb, bits_b))]
            differ = np.bitwise_count(fold[0] ^ fold[1]).sum(1).astype(np.int64)
            can[rows] = differ * (100 + percent) <= (sa[rows] + sb[rows]) * (100 - percent)
    return can


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, ...) of unequal sets, and can: whether their sizes and bitmaps allow a link."""
    names = pairs.columns
    for end in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(end), *(F.col(c).alias(c + end) for c in ("s", "c1", "c2", "wide"))), end)
    unequal = pairs.where("c1a <> c1b or c2a <> c2b").select(*names, "sa", "sb", "widea", "wideb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [(b.column(s).to_numpy(zero_copy_only=False), *_maps(b.column(w))) for s, w in (("sa", "widea"), ("sb", "wideb"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(_can(*ends, percent))], [*names, "can"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*names).schema]
    return unequal.mapInArrow(run, ", ".join([*kinds, "can boolean"]))


def star_pairs(docs: DataFrame, n: int, percent: int, buckets: int, plan_of: Plans) -> DataFrame:
    """Distinct (a, b, sigs, whole): members of a signature's group and its pivots. One record a task and signature is shuffled.

    sigs: signatures for which a and b were paired; whole: these are all."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ids, have, known = [], [], 0, {}

        def flush() -> Iterator[pa.RecordBatch]:
            sig, who, pairs = local_stars(np.concatenate(sigs), np.concatenate(ids))
            bucket = ((sig >> U(40)) % U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            bucket, sig, who = bucket[by], sig[by], who[by]
            rows = [(int(bucket[s]), sig[s:e].tobytes(), who[s:e].tobytes(), None, None) for s, e in zip(*K.runs(bucket), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SENT, strict=True)], schema=SENT)
            a, b, carried = (pairs[c].combine_chunks() for c in ("a", "b", "sig"))
            yield pa.RecordBatch.from_arrays([pa.array(-1 - (a.to_numpy() % buckets)), carried, pa.nulls(len(a), pa.binary()), a, b], schema=SENT)

        for who, row, h, sizes in _sets(batches, n):
            copies = list(zip(*(x.tolist() for x in _copies(row, h, sizes)), strict=True))
            # a copy of a set that this task has seen needs no signature of its own: copies are linked by their hash
            gone = np.array([bool(sizes[i]) and known.setdefault(c, int(who[i])) != who[i] for i, c in enumerate(copies)], bool)
            if gone.any():
                h, row, sizes = h[~gone[row]], row[~gone[row]], np.where(gone, 0, sizes)
            r, s = signatures(row, h, sizes, percent, plan_of)
            if len(s):
                sigs.append(s)
                ids.append(who[r].astype(np.int64))
                have += len(s)
            if have >= FLUSH:
                yield from flush()
                sigs, ids, have, known = [], [], 0, {}
        if have:
            yield from flush()

    def meet(key: tuple, sent: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return sent.select(["a", "b", "sig"])
        sig = np.frombuffer(b"".join(sent["sig"].to_pylist()), np.uint64)
        ids = np.frombuffer(b"".join(sent["ids"].to_pylist()), np.int64)
        return local_stars(sig, ids)[2]

    sent = docs.mapInArrow(send, "bucket long, sig binary, ids binary, a long, b long")
    pairs = sent.groupBy("bucket").applyInArrow(meet, "a long, b long, sig binary")
    ends = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "sig")
    return ends.groupBy("a", "b").agg(F.collect_list("sig").alias("sigs"), F.bool_and(F.col("sig").isNotNull()).alias("whole"))


def unpacked(pairs: DataFrame) -> DataFrame:
    """(sig) of the signatures that pairs carry, with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b"".join(x for part in b.column(0).to_pylist() for x in part)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(data, np.int64)))], ["sig"])

    return pairs.select("sigs").mapInArrow(run, "sig long")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, plan_of: Plans | None) -> DataFrame:
    """(a, b, linked, broken): whether the whole texts link, and, where not and there are plans, the signatures that they share."""
    left = docs.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("broken", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = np.maximum(*(np.diff(K.flat(batch.column(i))[1]) for i in (2, 3)))
            for i, j in K.blocks(np.concatenate([[0], np.cumsum(most)])):
                part = batch.slice(i, j - i)
                na, nb, shared = K.overlap(part.column(2), part.column(3), n)
                union = na + nb - shared
                linked = (union > 0) & (100 * shared >= percent * union)
                broken: list = [None] * (j - i)
                lost = np.flatnonzero(~linked)
                if len(lost) and plan_of is not None:
                    keys = []
                    for c in (2, 3):
                        row, h = K.distinct(*K.shingles(*K.flat(part.column(c).take(pa.array(lost))), n))
                        keys.append(K.distinct(*signatures(row, h, np.bincount(row, minlength=len(lost)), percent, plan_of)))
                    row, s = (np.concatenate(x) for x in zip(*keys, strict=True))
                    by = np.lexsort((s, row))
                    row, s = row[by], s[by]
                    twice = np.flatnonzero((row[1:] == row[:-1]) & (s[1:] == s[:-1]))
                    for k in twice.tolist():
                        x = lost[row[k]]
                        broken[x] = [*(broken[x] or []), int(s[k].view(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked), pa.array(broken, schema.field(3).type)], schema=schema)

    return both.mapInArrow(run, "a long, b long, linked boolean, broken array<long>")


def signature_rows(docs: DataFrame, n: int, percent: int, plan_of: Plans) -> DataFrame:
    """(sig, id), every signature of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, h, sizes in _sets(batches, n):
            r, s = K.distinct(*signatures(row, h, sizes, percent, plan_of))
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(ids[r].astype(np.int64))], ["sig", "id"])

    return docs.mapInArrow(run, "sig long, id long")


def open_groups(of: DataFrame, size: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) that may link, and (id, low, c), the members of groups whose pairs are not listed.

    of: (sig, id, c), documents by signature and their components. Only pairs of one group and two components count."""
    mixed = of.groupBy("sig").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("sig")
    # copies are linked already: one document stands for each set; groups of equal sets are one
    sets = of.join(mixed, "sig").join(size.select("id", "c1", "c2"), "id").groupBy("sig", "c1", "c2").agg(F.min("id").alias("id"), F.min("c").alias("c"))
    sets, one = cut(sets.select("sig", "id", "c"), "alike"), F.xxhash64("id")
    each = sets.groupBy("sig").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.sum(one.cast("decimal(20,0)")).alias("h1"), F.bit_xor(one).alias("h2"))
    once = each.groupBy("n", "h1", "h2").agg(F.min(F.struct("sig", "low")).alias("of")).where("n > 1").select("of.*", "n")
    rows = cut(sets.join(once, "sig"), "grouped")
    discard(sets)
    buckets, most_open = parts_for(rows.count(), GROUPED, 48), OPEN

    def meet(table: pa.Table) -> pa.Table:
        by = np.argsort(table["sig"].to_numpy(), kind="stable")
        sig, ids, c, s = (table[k].to_numpy()[by] for k in ("sig", "id", "c", "s"))
        at, width, bits = _maps(table["wide"].combine_chunks())
        at, width = at[by], width[by]
        start, end = K.runs(sig)
        group = np.repeat(np.arange(len(start)), end - start)
        here, step, left, right = np.arange(len(sig)), 1, [ids[:0]], [ids[:0]]
        while len(here := here[here + step < end[group[here]]]):
            i = here[c[here] != c[here + step]]
            j = i + step
            can = _can((s[i], at[i], width[i], bits), (s[j], at[j], width[j], bits), percent)
            left.append(i[can])
            right.append(j[can])
            step += 1
        i, j = np.concatenate(left), np.concatenate(right)
        crowded = np.bincount(group[i], minlength=len(start)) > most_open * (end - start)
        listed, all_of = ~crowded[group[i]], np.flatnonzero(crowded[group])
        a, b = ids[i[listed]], ids[j[listed]]
        low = np.minimum.reduceat(ids, start)[group]
        none = np.arange(len(a) + len(all_of)) < len(a)
        return pa.table({
            "a": np.concatenate([np.maximum(a, b), ids[all_of]]),
            "b": np.concatenate([np.minimum(a, b), low[all_of]]),
            "c": pa.array(np.concatenate([np.zeros(len(a), np.int64), c[all_of]]), mask=none),
        })

    small = rows.where(F.col("n") <= GROUP).join(size.select("id", "s", "wide"), "id")
    small = small.select(F.pmod(F.xxhash64("sig"), F.lit(buckets)).alias("bucket"), "sig", "id", "c", "s", "wide")
    found = cut(small.groupBy("bucket").applyInArrow(meet, "a long, b long, c long"), "open")
    crowded = found.where("c is not null").select(F.col("a").alias("id"), F.col("b").alias("low"), "c")
    large = rows.where(F.col("n") > GROUP).select("id", "low", "c")
    return found.where("c is null").select("a", "b").distinct(), cut(crowded.unionByName(large).distinct(), "chains")


def whole_sets(docs: DataFrame, n: int) -> DataFrame:
    """docs (id, text, ...) with the shingles of each text in place of it: w, a hash of them, s, their number, and xs. Empty sets are left out."""
    more = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, row, h, sizes in _sets(iter([batch]), n):
                xs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(h.view(np.int64)))
                own = [batch.column(c).slice(at, len(ids)) for c in more]
                at += len(ids)
                cols = [pa.array(ids.astype(np.int64)), *own, pa.array(_copies(row, h, sizes)[0]), pa.array(sizes.astype(np.int64)), xs]
                yield pa.RecordBatch.from_arrays(cols, ["id", *more, "w", "s", "xs"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in more)
    return docs.mapInArrow(run, f"id long, {kinds}, w long, s long, xs array<long>").where("s > 0")


def family_links(chains: DataFrame, keyed: DataFrame, size: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links between the components of each family; chains: (id, low, c), documents of groups in which a pair failed."""
    family = connected_components(chains, "id", "low").select(F.col("node").alias("id"), F.col("component").alias("fam"))
    members = family.join(chains.select("id", "c").distinct(), "id").join(size.select("id", "c1", "c2"), "id")
    # copies are linked already: one document stands for each set
    members = cut(members.groupBy("fam", "c1", "c2").agg(F.min("id").alias("id"), F.min("c").alias("c")).select("fam", "id", "c"), "members")
    sized = members.join(size.select("id", "s"), "id")
    families = cut(sized.groupBy("fam").agg(F.count("*").alias("n"), F.sum("s").alias("total")).where("n > 1"), "families")
    wanted = numbered(members, "id").drop("n").join(families, "fam")
    # what a family needs to know goes along with the texts, so that sets are not shuffled for it
    sets = whole_sets(keyed.join(wanted, "id").select("id", "text", "fam", "i", "n", "total", "c"), n)
    # only rows of one id can give a family a set twice; the sets are then numbered again
    if not keyed.groupBy("id").count().where("count > 1").join(wanted, "id", "left_semi").isEmpty():
        sets = sets.dropDuplicates(["fam", "w"]).drop("i")
    every = cut(sets, "sets")
    small = (F.col("n") <= WHOLE_SETS) & (F.col("total") <= WHOLE_SIZE)
    found = whole_links(every.where(small), percent, parts_for(families.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0], FAMILIES, 48))
    # the empty set is the reference of larger families; their first round finds what most of their sets hold
    found = cut(found, "found", LONG_ROWS)
    level = every.where(~small).select("fam", *(("i", "n") if "i" in every.columns else ()), "w", "id", "c", "s", "xs")
    level._cut_path = every._cut_path  # deleted once the first round has its own
    more = delta_links(level, percent)
    discard(members, families)
    return found.unionByName(more)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): each row's set size and the smallest key that links lead to.

    A set is the distinct n-word shingles of the lower-cased (A-Z) words between space, tab to carriage return;
    fewer words are one shingle. Two rows link when 100 * shared >= percent * union. Null and empty texts have
    empty sets and link with nothing. Rows of equal key are one document as to links, so keys should be unique;
    repeated rows each give a row. A null key gives a row with a null component. Extra columns are ignored, an
    empty table gives no rows. Ties have no effect: components do not depend on the order of rows.
    """
    lean_workers(docs.sparkSession)
    none = np.iinfo(np.int64).min
    base = docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("text"))
    keyed = base.where("id is not null")
    sizes = cut(set_sizes(base.select(F.coalesce("id", F.lit(none)).alias("id"), "text"), n), "sizes")
    real = sizes.where((F.col("id") != none) & (F.col("n_shingles") > 0))
    most = real.agg(F.max("n_shingles")).first()[0] or 1
    band = F.size(F.filter(F.array(*map(F.lit, band_edges(most))), lambda e: e <= F.col("n_shingles"))) - 1
    plan_of = plans({b: k for b, k in real.groupBy(band.alias("b")).count().collect()}, most, percent)
    buckets = parts_for(text_bytes(keyed, "text"), BUCKET, 48)
    first = real.groupBy("c1", "c2").agg(F.min("id").alias("b"), F.count("*").alias("k")).where("k > 1")
    copies = real.join(first, ["c1", "c2"]).select(F.col("id").alias("a"), "b").where("a <> b")
    size = real.groupBy("id").agg(F.max("n_shingles").alias("s"), *(F.max_by(c, F.struct("n_shingles", "c1", "c2")).alias(c) for c in ("c1", "c2", "wide")))
    stars = cut(possible(star_pairs(keyed, n, percent, buckets, plan_of).where("a <> b"), size, percent), "stars")
    # a pair that cannot link goes on only if its signatures are not all known
    checked = cut(verified(stars.where("can or not whole").select("a", "b"), keyed, n, percent, plan_of), "verified")
    edges = copies.unionByName(checked.where("linked").select("a", "b"))
    parts = cut(connected_components(edges), "components")
    # groups in which a pair failed: their members may link to one another
    broken = checked.where("not linked").select(F.explode("broken").alias("sig")).unionByName(unpacked(stars.where("not can and whole"))).distinct()
    members = signature_rows(keyed, n, percent, plan_of).join(broken, "sig")
    of = members.join(parts.withColumnRenamed("node", "id"), "id", "left").select("sig", "id", F.coalesce("component", "id").alias("c"))
    of = cut(of, "members")
    open_pairs, chains = open_groups(of, size, percent)
    discard(of, stars)
    more = cut(verified(open_pairs, keyed, n, percent, None), "verified").where("linked").select("a", "b")
    if not chains.isEmpty():
        more = more.unionByName(family_links(chains, keyed, size, n, percent))
    if not more.isEmpty():
        parts = cut(connected_components(edges.unionByName(more)), "components")
    out = sizes.join(parts.withColumnRenamed("node", "id"), "id", "left")
    null = F.col("id") == none
    return out.select(F.when(~null, F.col("id")).alias(key), "n_shingles", F.when(~null, F.coalesce("component", "id")).alias("component_id"))
