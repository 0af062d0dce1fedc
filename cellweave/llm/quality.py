"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on binned features with numpy from a bounded sample of labelled rows, then flattened into
arrays; documents are scored in tasks by walking all trees at once over a batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm import kernels as K
from cellweave.llm.shared import utf8

#: Labelled rows that a fit may use at most; a documented bound on what reaches the driver.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 60, 4, 32, 0.2, 10
#: A score of at least this is label 1.
ACCEPT = 0.3
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "long_words", "one_byte_words", "distinct_words", "top_word", "upper", "digits", "marks",
    "symbols", "high_bytes", "sentence_ends", "commas", "bars", "log_lines", "line_words", "repeated_lines", "repeated_words", "marked_words",
    "upper_words", "numeric_words", "braces", "quotes", "rare_marks",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT, _HIGH = _mask(bytes(range(65, 91))), _mask(bytes(range(48, 58))), _mask(bytes(range(128, 256)))
_PLAIN = _mask(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \t\r\n\x0b\x0c") | _HIGH
_ENDS, _COMMA, _BAR, _BRACE, _QUOTE = _mask(b".!?"), _mask(b",;:"), _mask(b"|"), _mask(b"{}[]()<>"), _mask(b"\"'`")
_ODD = ~(_PLAIN | _ENDS | _COMMA | _QUOTE | _mask(b"-()"))


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text gives zeros."""
    n = len(off) - 1
    size = np.diff(off).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        hits = np.concatenate([[0], np.cumsum(mask[buf])])
        return (hits[off[1:]] - hits[off[:-1]]) / np.maximum(size, 1)

    start, end, row = K.spans(buf, off)
    words = np.bincount(row, minlength=n).astype(float)
    per = np.maximum(words, 1)
    length = end - start
    h = K.word_hashes(buf, start, end) if len(buf) else np.zeros(0, np.uint64)

    def words_with(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=mask, minlength=n) / per

    def inside(mask: np.ndarray) -> np.ndarray:
        hits = np.concatenate([[0], np.cumsum(mask[buf])])
        return hits[end] - hits[start]

    by = np.lexsort((h, row))
    first, last = K.runs(row[by].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ h[by])
    of = row[by][first] if len(first) else row
    kinds = np.bincount(of, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, of, (last - first).astype(float))
    same = np.zeros(n)
    if len(h) > 1:
        np.add.at(same, row[1:], (h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    # lines, by the hash of their bytes
    brk = np.flatnonzero(buf == 10)
    ls = np.unique(np.concatenate([off[:-1][size > 0], brk + 1])) if len(buf) else np.zeros(0, np.int64)
    ls = ls[ls < len(buf)]
    le = np.append(ls[1:], len(buf)) if len(ls) else ls
    lrow = np.searchsorted(off, ls, "right") - 1
    lh = K.word_hashes(buf, ls, le) if len(ls) else np.zeros(0, np.uint64)
    lines = np.bincount(lrow, minlength=n).astype(float)
    distinct_lines = np.bincount(K.distinct(lrow, lh)[0], minlength=n)
    marked = inside(_ODD)
    cols = [
        np.log1p(size), np.log1p(words), np.bincount(row, weights=length, minlength=n) / per, words_with(length > 12), words_with(length == 1),
        kinds / per, top / per, share(_UPPER), share(_DIGIT), share(~_PLAIN), share(_ODD), share(_HIGH), share(_ENDS), share(_COMMA), share(_BAR),
        np.log1p(lines), words / np.maximum(lines, 1), 1 - distinct_lines / np.maximum(lines, 1), same / per, words_with(marked > 0),
        words_with((inside(_UPPER) == length) & (length > 1)), words_with(inside(_DIGIT) * 2 > length), share(_BRACE), share(_QUOTE), words_with(marked > 2),
    ]
    out = np.stack(cols, 1)
    out[size == 0] = 0
    return out


@dataclass
class Forest:
    """Trees as arrays of nodes: feature (-1 at a leaf), threshold, left child (the right one follows), value."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, all trees walked together."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[at]
            go = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(f < 0, at, self.left[at] + go)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit_forest(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees of the logistic loss; nodes of one depth share a histogram pass. One label only gives its rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if len(x) else np.zeros(x.shape, np.int64)
    d = x.shape[1]
    feature, threshold, left, value, roots = [], [], [], [], []
    margin = np.full(len(y), base)

    def node() -> int:
        for array, v in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            array.append(v)
        return len(feature) - 1

    for _ in range(TREES if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        level, slot = [root], np.zeros(len(y), np.int64)
        ended = np.full(len(y), -1)
        for depth in range(DEPTH + 1):
            k = len(level)
            if not k:
                break
            live = slot >= 0
            flat = (slot[live, None] * d + np.arange(d)) * BINS + binned[live]
            shape = (k, d, BINS)
            total = k * d * BINS
            hg = np.bincount(flat.ravel(), np.repeat(g[live], d), total).reshape(shape)
            hh = np.bincount(flat.ravel(), np.repeat(h[live], d), total).reshape(shape)
            hn = np.bincount(flat.ravel(), minlength=total).reshape(shape)
            gl, hl, nl = (np.cumsum(a, 2)[:, :, :-1] for a in (hg, hh, hn))
            gt, ht, nt = (a.sum(2)[:, :1, None] for a in (hg, hh, hn))
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(nl < LEAST) | (nt - nl < LEAST)] = 0
            best = gain.reshape(k, -1).argmax(1)
            grown, place = [], np.full(k, -1)
            for i, n in enumerate(level):
                f, b = divmod(int(best[i]), BINS - 1)
                if depth < DEPTH and gain[i, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[n], threshold[n] = f, float(cuts[f][b])
                    place[i] = len(grown)
                    a, z = node(), node()
                    left[n] = a
                    grown += [a, z]
                else:
                    value[n] = float(-RATE * gt[i, 0, 0] / (ht[i, 0, 0] + 1))
            level_of = np.array(level)
            rows = np.flatnonzero(live)
            to = place[slot[rows]]
            n = level_of[slot[rows]]
            leaf = to < 0
            ended[rows[leaf]] = n[leaf]
            slot[rows[leaf]] = -1
            rows, to, n = rows[~leaf], to[~leaf], n[~leaf]
            f = np.array(feature)[n]
            slot[rows] = to + (x[rows, f] > np.array(threshold)[n])
            level = grown
        margin += np.array(value)[ended]
    if not roots:
        roots = [node()]
    return Forest(base, np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(value))


def features(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep columns and x (array<double>), the statistics of each whole text."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.flat(b.column(len(keep)))
            x = np.concatenate([statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in K.blocks(off)] or [np.zeros((0, len(FEATURES)))])
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], values], [*keep, "x"])

    return df.select(*keep, utf8(text).alias("_text")).mapInArrow(run, f"{schema}, x array<double>")


def held_out(key: str | Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves rest modulo mod; a null key counts as empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod == rest


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column | None = None, most: int = SAMPLE) -> Forest:
    """A forest of at most `most` labelled rows, those of the smallest hash of doc_id; train says which rows may be used.

    Labels without a document, of null doc_id, or of a quality other than 0 and 1 (null too) don't count; repeated labels count once, and
    of different ones the higher. Without any label of use every document has score 0.5."""
    usable = labels.where("doc_id is not null and quality in (0, 1)")
    if train is not None:
        usable = usable.where(train)
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "text", "doc_id", "quality")
    got = rows.groupBy("doc_id").agg(F.max_by("x", F.xxhash64("x")).alias("x"), F.max("quality").alias("quality")).orderBy("doc_id").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_forest(x, np.array(got["quality"].to_pylist(), float))


def quality_scores(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """docs with score and predicted; columns of these names are replaced.

    Null and empty texts have zero statistics and the score of those. Whole texts are read. Equal texts have
    equal scores. An empty table gives no rows; other columns, nulls and repeated rows pass as they are."""
    docs = docs.drop("score", "predicted")
    model = docs.sparkSession.sparkContext.broadcast(forest)  # TREES trees of at most DEPTH levels: a fixed bound

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        buf, off = K.flat(column)
        parts = [model.value.score(statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in K.blocks(off)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn("score", scored(utf8(text))).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
