"""Benchmark decontamination: size-partitioned MinHash containment search of short items in long documents.

Items are partitioned by their number of distinct shingles. An item's signature is its k smallest shingle hashes (a
bottom-k MinHash), k being set by the partition's largest item: with size s, at least need = ceil(s * percent / 100)
shingles are in a document that holds the item, so at most s - need of the signature are not. The share of the
signature that a document has estimates containment; documents with fewer than k - (s - need) of it are ruled out
without loss, whatever their length, and k is long enough that this is at least one. What is left is verified by
exact containment of all of the item's shingles.

Items of at most SMALL shingles go to every task as one index. A larger benchmark is joined instead: documents'
shingles meet signatures by hash, hits are counted by document and item, and so are shared shingles after them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm import kernels as K
from cellweave.llm.shared import cut, utf8

WORDS, PERCENT = 5, 80
#: Shingles of the items that go to every task at most: 16 bytes each, so 32 MB.
SMALL = 2_000_000


def need_of(size: np.ndarray, percent: int) -> np.ndarray:
    return -(-size * percent // 100)


def signature_sizes(size: np.ndarray, percent: int) -> np.ndarray:
    """k of each item: one more than the largest of its partition (sizes of one power of two) may lack."""
    largest = np.left_shift(1, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) + 1) - 1
    return np.minimum(size, largest - need_of(largest, percent) + 1)


class Index:
    """Signatures and shingles of all items as sorted arrays."""

    def __init__(self, row: np.ndarray, h: np.ndarray, ids: np.ndarray, percent: int) -> None:
        self.ids = ids
        self.size = np.bincount(row, minlength=len(ids))
        self.need = need_of(self.size, percent)
        k = signature_sizes(self.size, percent)
        self.hits = np.maximum(1, k - (self.size - self.need))
        nth = np.arange(len(row)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.sketch, self.whole = (self._sorted(row[x], h[x]) for x in (nth < k[row], np.ones(len(row), bool)))

    @staticmethod
    def _sorted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.lexsort((row, h))
        return h[by], row[by]

    @staticmethod
    def _counts(row: np.ndarray, h: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) pairs that share hashes, and how many; row and h are distinct."""
        lo, hi = np.searchsorted(held[0], h, "left"), np.searchsorted(held[0], h, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.unique(np.stack([np.repeat(row, n), held[1][at]], 1), axis=0, return_counts=True)

    def find(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, shared shingles) of each containment; row and h are documents' shingles."""
        none = np.zeros(0, np.int64)
        if not len(self.sketch[0]) or not len(h):
            return none, none, none
        keys = self.sketch[0]
        hit = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
        met = K.distinct(row[hit], h[hit])
        pair, n = self._counts(*met, self.sketch)
        pair = pair[n >= self.hits[pair[:, 1]]]
        if not len(pair):
            return none, none, none
        row, h = K.distinct(*(x[np.isin(row, pair[:, 0])] for x in (row, h)))
        every, shared = self._counts(row, h, self.whole)
        ok = (shared >= self.need[every[:, 1]]) & np.isin(every @ [len(self.ids), 1], pair @ [len(self.ids), 1])
        return every[ok, 0], every[ok, 1], shared[ok]


def small_index(items: DataFrame, words: int, percent: int) -> Index | None:
    """The index of all items, or None where they have more than SMALL shingles. Repeated item rows stay apart."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size // 2 > SMALL:  # a word and its gap take two bytes
        return None
    got = items.select(F.col("item_id").cast("long").alias("i"), utf8("text").alias("t")).where("i is not null and octet_length(t) > 0").orderBy("i", "t").toArrow()
    row, h = K.distinct(*K.shingles(*K.flat(got["t"]), words))
    return Index(row, h, got["i"].to_numpy(), percent)


def shingle_rows(df: DataFrame, words: int) -> DataFrame:
    """(key, mark, nth, n, h): each distinct shingle of each row (key, text), by rising hash, and their number; mark: a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.flat(b.column(1))
            for i, j in K.blocks(off):
                o = off[i : j + 1] - off[i]
                part = buf[off[i] : off[j]]
                row, h = K.distinct(*K.shingles(part, o, words))
                size = np.bincount(row, minlength=j - i)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                mark = K.word_hashes(part, o[:-1], o[1:], fold=False)[row].view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(row)), *map(pa.array, (mark, nth, size[row], h.view(np.int64)))], ["key", "mark", "nth", "n", "h"])

    return df.mapInArrow(run, "key string, mark long, nth long, n long, h long")


def joined_items(docs: DataFrame, items: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, item_id, n_item, n_shared) of each row (key, text) of docs and item it holds, by joins alone."""
    d = shingle_rows(docs.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), utf8("text").alias("text")), words)
    i = shingle_rows(items.where("item_id is not null").select(F.col("item_id").cast("string").alias("key"), utf8("text").alias("text")), words)
    i = cut(i.select(F.col("key").alias("item"), F.col("mark").alias("item_mark"), "nth", "n", "h"), "items")

    def need(n: Column) -> Column:
        return F.ceil(n * percent / 100)

    largest = (F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1).cast("long")
    k = F.least("n", largest - need(largest) + 1)
    signed = i.where(F.col("nth") < k).withColumn("hits", F.greatest(F.lit(1), k - (F.col("n") - need(F.col("n")))))
    pair = ["key", "mark", "item", "item_mark"]
    # rows that repeat count more than once here, which lets more pairs through, not fewer
    met = d.join(signed, "h").groupBy(*pair).agg(F.count("*").alias("c"), F.first("hits").alias("hits")).where("c >= hits").select(*pair)
    met = cut(met, "met")
    shared = d.select("key", "mark", "h").join(met, ["key", "mark"]).join(i.drop("nth"), ["item", "item_mark", "h"])
    shared = shared.groupBy(*pair).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    copies = [x.where("nth = 0").groupBy(*names).agg(F.count("*").alias(c)) for x, names, c in ((d, pair[:2], "nd"), (i, pair[2:], "ni"))]
    out = shared.join(copies[0], pair[:2]).join(copies[1], pair[2:]).withColumn("shared", (F.col("c") / (F.col("nd") * F.col("ni"))).cast("long"))
    out = out.where(F.col("shared") >= need(F.col("n"))).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("nd") * F.col("ni"))))
    return out.select("key", F.col("item").cast("long").alias("item_id"), F.col("n").alias("n_item"), F.col("shared").alias("n_shared"))


def contained_items(docs: DataFrame, items: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of each document and item it holds.

    A document holds an item if at least percent in a hundred of the item's distinct shingles (words words, A-Z
    in lower case; an item of fewer words is one shingle, met by a document of just these words) are in it. Items
    of null id or without words hold nowhere, so do documents without words. A null doc_id passes as null; repeated
    rows each give rows; repeated items too. Extra columns are ignored. Either table may be empty: no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    names = ["doc_id", "item_id", "n_item", "n_shared"]
    index = small_index(items, words, percent)
    if index is None:
        found = joined_items(base.withColumnRenamed("doc_id", "key"), items, words, percent)
        found = found.select(F.nullif("key", F.lit("")).cast("long").alias("doc_id"), *names[1:])
    else:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for b in batches:
                buf, off = K.flat(b.column(1))
                for i, j in K.blocks(off):
                    doc, item, n = ix.find(*K.shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], words))
                    who = b.column(0).slice(i, j - i).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays([who, *map(pa.array, (ix.ids[item], ix.size[item], n))], names)

        found = base.mapInArrow(run, "doc_id long, item_id long, n_item long, n_shared long")
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the rows whose text holds an item, whatever their doc_id. Columns are those of docs; extra ones pass."""
    index = small_index(items, words, percent)
    if index is None:
        mark = F.sha2(utf8("text"), 256)
        bad = joined_items(docs.select(mark.alias("key"), "text"), items, words, percent).select(F.col("key").alias("_held")).distinct()
        return docs.join(bad, mark == F.col("_held"), "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("boolean")
    def holds(column: pa.Array) -> pa.Array:
        buf, off = K.flat(column)
        out = np.zeros(len(off) - 1, bool)
        for i, j in K.blocks(off):
            out[i + shared.value.find(*K.shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], words))[0]] = True
        return pa.array(out)

    return docs.where(~holds(utf8("text")))
