"""SimHash near-duplicates by the pigeonring: candidates need a chain of consecutive segments whose differences stay within their share.

A fingerprint's 64 bits form a ring of segments, one more than the differing bits that a link allows. By the pigeonring principle, two
fingerprints of a link have a segment from which every chain of k consecutive ones differs in at most floor(k * most / segments) bits in
all: none in the first, one in the first two, and so on. Equal texts and equal fingerprints are one row first. Each fingerprint goes to
the bucket of each of its segments (length 1), and within a bucket meets only those whose next segment differs in at most one bit
(length 2), found by sorted search; longer chains are then held to their budgets, and what is left is compared in full.

A bucket's size is known before (segments times values of a segment, at most some 41,000 counts). One of over CELL fingerprints is dealt
into lanes, and each pair of lanes is a task's work of its own. Tasks return stars, a link from each member of a group to its smallest
fingerprint, never the group's pairs; groups are joined by alternating stars.

Texts that are null, empty or without words have fingerprint zero and are linked like any others. A null doc_id keeps its row and its
links but is no component's name unless all are null; repeated doc_ids and rows stay rows of their own. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.components import connected_components
from cellweave.llm.kernels import joined_roots
from cellweave.llm.shared import cut, utf8

#: Fingerprints of a lane, fingerprints of a task, candidates compared at once, and shingles hashed at once.
CELL, TASK, PAIRS, SHINGLES = 1 << 16, 1 << 18, 1 << 22, 1 << 18
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: bytes, n: int = 4) -> int:
    """Bits set in over half of the hashes of all n-word shingles; a shorter text's words are one shingle."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    wide = min(n, len(words))
    start, end = (end - size)[: len(words) - wide + 1], end[wide - 1 :]
    counts, digest = np.zeros((8, 256), np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(start), SHINGLES):
        spans = zip(start[k : k + SHINGLES].tolist(), end[k : k + SHINGLES].tolist(), strict=True)
        h = np.array([digest(joined[a:z], 42) for a, z in spans], "<u8").view(np.uint8).reshape(-1, 8)
        for i in range(8):
            counts[i] += np.bincount(h[:, i], minlength=256)
    ones = (counts @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def _fingerprints(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([fingerprint(t.as_py(), n) for t in b["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(own)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, fp) of each row; fp is the unsigned fingerprint's bits as a long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(_fingerprints(n), f"doc_id {kind}, fp long")


def ring(most: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of most + 1 segments of nearly equal width."""
    edge = [64 * i // (most + 1) for i in range(most + 2)]
    return [(a, z - a) for a, z in zip(edge, edge[1:], strict=False)]


def chained(x: np.ndarray, first: np.ndarray, segments: list[tuple[int, int]], most: int) -> np.ndarray:
    """Which differences x keep the budgets of all chains from their first segment; the whole ring is the full comparison."""
    m = len(segments)
    low, width = (np.array(c, np.uint64) for c in zip(*segments, strict=True))
    total, ok = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for k in range(m):
        at = (first + k) % m
        total += np.bitwise_count((x >> low[at]) & ((np.uint64(1) << width[at]) - np.uint64(1)))
        ok &= total <= (k + 1) * most // m
    return ok


def stars(start: np.ndarray, lane: np.ndarray, lo: np.ndarray, hi: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, smallest fp of its group) of fingerprints that share a task, each at a start segment and in a cell of two lanes.

    Rows meet within a bucket (start, segment value, lanes), sorted by the next segment; in a cell of two lanes only across."""
    segments, m = ring(most), most + 1
    low, width = (np.array(c, np.uint64) for c in zip(*segments, strict=True))
    mask, following = (np.uint64(1) << width) - np.uint64(1), (start + 1) % m
    value, after = (fp >> low[start]) & mask[start], (fp >> low[following]) & mask[following]
    order = np.lexsort((after, value, hi, lo, start))
    start, lane, lo, hi, fp, value, after, following = (c[order] for c in (start, lane, lo, hi, fp, value, after, following))
    fresh = np.ones(len(fp), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (value[1:] != value[:-1])
    bucket = (np.cumsum(fresh) - 1).astype(np.uint64)
    wide = np.uint64(max(w for _, w in segments))
    place = (bucket << wide) | after  # ascending
    unit, node = np.unique(fp, return_inverse=True)
    root, rows = np.arange(len(unit)), np.arange(len(fp))
    for flip in range(-1, int(wide)):
        near = rows if flip < 0 else rows[(flip < width[following]) & (after & (np.uint64(1) << np.uint64(max(flip, 0))) == 0)]
        sought = place[near] if flip < 0 else place[near] | (np.uint64(1) << np.uint64(flip))
        a = near + 1 if flip < 0 else np.searchsorted(place, sought)
        count = np.searchsorted(place, sought, "right") - a
        done = np.cumsum(count)
        i = 0
        while i < len(near):
            j = max(i + 1, int(np.searchsorted(done, done[i] - count[i] + PAIRS, "right")))
            each = count[i:j]
            left = np.repeat(near[i:j], each)
            right = np.arange(len(left)) + np.repeat(a[i:j] - np.cumsum(each) + each, each)
            i = j
            across = (lo[left] == hi[left]) | (lane[left] != lane[right])
            left, right = left[across], right[across]
            ok = chained(fp[left] ^ fp[right], start[left], segments, most)
            root = joined_roots(root, node[left[ok]], node[right[ok]])
    tied = np.flatnonzero(root != np.arange(len(unit)))
    return unit[tied], unit[root[tied]]


def _stars(most: int) -> Callable:
    def run(_key: tuple, t: pa.Table) -> pa.Table:
        cells = (t[c].to_numpy() for c in ("start", "lane", "lo", "hi"))
        a, b = stars(*cells, t["fp"].to_numpy().view(np.uint64), most)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def near_links(unique: DataFrame, most: int = 4, cell: int = CELL, task: int = TASK) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints of at most so many differing bits into the right components. unique: fp."""
    segments = ring(most)
    value = [F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1) for low, width in segments]
    every = F.array(*(F.struct(F.lit(i).alias("start"), v.cast("int").alias("value")) for i, v in enumerate(value)))
    rows = unique.select("fp", F.explode(every).alias("x")).select("fp", "x.*")
    total, lanes = cut(rows.groupBy("start", "value").count(), "buckets"), F.ceil(F.col("count") / cell)
    parts = max(1, math.ceil((total.agg(F.sum("count")).first()[0] or 0) / task))
    dealt = rows.join(total.select("start", "value", lanes.cast("int").alias("lanes")), ["start", "value"])
    dealt = dealt.withColumn("lane", F.pmod(F.xxhash64("fp"), F.col("lanes")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    dealt = dealt.withColumns({"lo": F.least("lane", "other"), "hi": F.greatest("lane", "other")})
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("start", "value", "lo", "hi"), F.lit(parts)).cast("int"))
    return dealt.select("part", "start", "lane", "lo", "hi", "fp").groupBy("part").applyInArrow(_stars(most), "a long, b long").distinct()


def simhash_components(docs: DataFrame, n: int = 4, most: int = 4, cell: int = CELL, task: int = TASK) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: the smallest doc_id reachable by links)."""
    rows = cut(fingerprints(docs, n), "fingerprints")
    unique = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "unique")
    groups = cut(connected_components(near_links(unique.select("fp"), most, cell, task)).distinct(), "groups")
    named = unique.join(groups.withColumnRenamed("node", "fp"), "fp")
    lows = named.groupBy("component").agg(F.min("low").alias("name"))
    of_fp = unique.join(named.join(lows, "component").select("fp", "name"), "fp", "left").select("fp", F.coalesce("name", "low").alias("component_id"))
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
