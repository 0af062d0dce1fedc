"""Language of each word by a linear-chain conditional random field, for text that switches languages.

A line is a chain of words; a longer one than CHAIN words is several chains. A word's score for a label sums the weights of its features (prefixes, suffixes,
byte n-grams, and itself if the lexicon has it), hashed into a fixed table; transitions between labels are
learned too: a fit strings MIXED pieces of up to PIECE words, of neighbouring documents, into one chain, so that
languages switch within it. Forward-backward gives each word's label probabilities (label_words), and a document's
language is the label of the largest expected number of words.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.llm import kernels as K
from cellweave.llm.shared import utf8

#: Documents, and bytes of them, that a fit may use at most, whole: a documented bound on what one task holds. The driver gets the field only.
SAMPLE, SAMPLE_BYTES = 1_500, 48 << 20
#: Words of a chain at most; pieces of a training chain and their words.
CHAIN, MIXED, PIECE = 256, 3, 12
#: Rows of the feature table, words of the lexicon a language, rounds of the fit and its step.
TABLE, LEXICON, ROUNDS, STEP = 1 << 16, 1_000, 12, 0.3
#: Words whose chains a fit steps through together.
STEPPED = 1 << 17
UNDETERMINED = "und"
U = np.uint64
_LETTER = r"\p{L}"


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # TABLE x labels
    moves: np.ndarray  # labels x labels
    lexicon: np.ndarray  # sorted word hashes


class Lines:
    """The words of a block of texts: distinct words with their features, and chains of equal steps."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lexicon: np.ndarray | None) -> None:
        start, end, self.row = self.start, self.end, _ = K.spans(buf, off)
        h = np.zeros(len(start), np.uint64)
        for i, j in K.blocks(off) if len(start) else ():
            a, b = np.searchsorted(start, off[[i, j]])
            h[a:b] = K.word_hashes(buf[off[i] : off[j]], start[a:b] - off[i], end[a:b] - off[i])
        self.hash, first, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.features, self.owner = word_features(buf, start[first], end[first], self.hash, lexicon)
        chain = np.searchsorted(np.flatnonzero(buf == 10), start)
        turn = np.ones(len(start), bool)
        turn[1:] = (chain[1:] != chain[:-1]) | (self.row[1:] != self.row[:-1])
        self.begin = np.flatnonzero(turn)
        at = np.arange(len(start)) - (np.repeat(self.begin, np.diff(np.append(self.begin, len(start)))) if len(start) else 0)
        self.chains(np.flatnonzero(at % CHAIN == 0))

    def chains(self, begin: np.ndarray) -> None:
        """Chains begin at these words."""
        self.begin, self.size = begin, np.diff(np.append(begin, len(self.word)))

    def mixed(self) -> np.ndarray:
        """Words in an order that strings MIXED pieces of different documents together; chains begin accordingly."""
        n = len(self.word)
        at = np.arange(n) - np.repeat(self.begin, self.size) if n else np.zeros(0, np.int64)
        piece = np.cumsum(at % PIECE == 0) - 1
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        docs = self.row[first]
        nth = np.arange(len(first)) - np.searchsorted(docs, docs, "left")
        turn = np.lexsort((docs, nth))  # the first pieces of all documents, then the second ones
        size = np.diff(np.append(first, n))[turn]
        order = np.repeat(first[turn] - (np.cumsum(size) - size), size) + np.arange(n) if n else at
        self.word, self.row = self.word[order], self.row[order]
        self.chains((np.cumsum(size) - size)[::MIXED])
        return order

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Each distinct word's score for each label."""
        if not len(self.hash):
            return np.zeros((0, weights.shape[1]))
        first = np.flatnonzero(np.concatenate([[True], self.owner[1:] != self.owner[:-1]]))
        return np.add.reduceat(weights[self.features], first, axis=0)

    def marginals(self, scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each word, and the expected number of each transition; all chains step together."""
        n, k = len(self.word), moves.shape[0]
        e = scores[self.word]
        e = np.exp(e - e.max(1, keepdims=True)) if n else e
        t = np.exp(moves)
        order = np.argsort(-self.size, kind="stable")
        begin, size = self.begin[order], self.size[order]
        live = np.searchsorted(-size, -np.arange(1, (size[0] if n else 0) + 1), "right")
        fwd, back = np.empty((n, k)), np.ones((n, k))
        for step, m in enumerate(live.tolist()):
            at = begin[:m] + step
            a = e[at] if step == 0 else (fwd[at - 1] @ t) * e[at]
            fwd[at] = a / a.sum(1, keepdims=True)
        pairs = np.zeros((k, k))
        for step in range(len(live) - 1, 0, -1):
            at = begin[: live[step]] + step
            b = e[at] * back[at]
            x = b @ t.T
            scale = x.sum(1, keepdims=True)
            back[at - 1] = x / scale
            z = (fwd[at - 1] * x).sum(1, keepdims=True)
            pairs += ((fwd[at - 1] / z).T @ b) * t
        p = fwd * back
        return (p / p.sum(1, keepdims=True) if n else p), pairs

    def expected(self, scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected number of each distinct word's labels and of each transition, over chains of some STEPPED words at a time."""
        counts, pairs = np.zeros((len(self.hash), moves.shape[0])), np.zeros(moves.shape)
        whole, begin, i = self.word, self.begin, 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + STEPPED)))
            self.word = whole[begin[i] : begin[j] if j < len(begin) else len(whole)]
            self.chains(begin[i:j] - begin[i])
            p, some = self.marginals(scores, moves)
            pairs += some
            for c in range(len(moves)):
                counts[:, c] += np.bincount(self.word, p[:, c], len(counts))
            i = j
        self.word = whole
        self.chains(begin)
        return counts, pairs


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, lexicon: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each occurrence and the word that owns it, by word: affixes of 1 to 4 bytes, 2- to 4-grams, lexicon."""
    n = len(start)
    size = end - start
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum()) if n else start
    who = np.repeat(np.arange(n), size)
    left = at - start[who] if n else at
    right = end[who] - at if n else at
    code = K._FOLDED[buf[at]] if n else np.zeros(0, np.uint64)
    feats, owners = [], []
    gram = code.copy()
    for width in range(1, 5):
        if width > 1:
            gram = gram[: len(code) - width + 1] * U(0xD6E8FEB86659FD93) + code[width - 1 :] if len(code) >= width else gram[:0]
        m = len(gram)
        inside = right[:m] >= width
        for salt, mask in ((1, inside & (left[:m] == 0)), (2, inside & (right[:m] == width)), (3, inside if width > 1 else np.zeros(m, bool))):
            x = np.flatnonzero(mask)
            feats.append(K.mix(gram[x] + U(width * 8 + salt)))
            owners.append(who[x])
    feats.append(K.mix(np.full(n, 7, np.uint64)))  # every word has this one
    owners.append(np.arange(n))
    if lexicon is not None and len(lexicon) and n:
        known = np.flatnonzero(lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h)
        feats.append(K.mix(h[known] ^ U(0x51ED270B)))
        owners.append(known)
    f, o = np.concatenate(feats) % U(TABLE), np.concatenate(owners)
    by = np.argsort(o, kind="stable")
    return f[by].astype(np.int64), o[by]


def fit_field(texts: list[bytes], langs: list[str]) -> Field:
    """A field from whole texts whose words all bear the text's language; weights start at log odds of features."""
    labels = sorted(set(langs))
    k = len(labels)
    if not k:
        return Field([], np.zeros((TABLE, 0), np.float32), np.zeros((0, 0)), np.zeros(0, np.uint64))
    column = pa.array(texts, pa.large_binary())
    buf, off = K.flat(column)
    lines = Lines(buf, off, None)
    y = np.array([labels.index(x) for x in langs])[lines.row] if k else lines.row
    count = np.zeros((len(lines.hash), k))
    np.add.at(count, (lines.word, y), 1)
    lexicon = np.unique(np.concatenate([lines.hash[np.argsort(-count[:, j], kind="stable")[:LEXICON]] for j in range(k)] or [lines.hash[:0]]))
    lines = Lines(buf, off, lexicon)
    y = y[lines.mixed()]
    seen = np.zeros((TABLE, k))
    np.add.at(seen, lines.features, count[lines.owner])
    weights = np.log((seen + 0.1) / (seen.sum(0) + 0.1 * TABLE))
    weights -= weights.mean(1, keepdims=True)
    weights[seen.sum(1) < 2] = 0
    weights /= 10.0  # a word has some ten features that say much the same
    moves = np.eye(k) * 2.0
    square_w, square_m = np.full((TABLE, k), 1e-6), np.full((k, k), 1e-6)
    total = max(len(lines.word), 1)
    inner = np.ones(len(lines.word), bool)
    inner[lines.begin] = False
    held = np.zeros((k, k))
    np.add.at(held, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    for _ in range(ROUNDS if k > 1 else 0):
        expected, pairs = lines.expected(lines.scores(weights), moves)
        per_word = (count - expected) / total
        grad = np.zeros((TABLE, k))
        np.add.at(grad, lines.features, per_word[lines.owner])
        grad -= 1e-6 * weights
        square_w += grad**2
        weights += STEP * 0.1 * grad / np.sqrt(square_w)
        grad = (held - pairs) / total - 1e-3 * moves
        square_m += grad**2
        moves += STEP * grad / np.sqrt(square_m)
    return Field(labels, weights.astype(np.float32), moves, lexicon)


def fit_language(docs: DataFrame, train: Column | None = None, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Field:
    """A field of at most `most` documents (doc_id, text, lang) of non-null text and lang, and of at most most_bytes of them.

    Each lang has an equal part, filled by the smallest hashes of doc_id; a document that would go beyond the bytes
    of its lang's part is passed over. Rows that repeat count as often as they are there."""
    usable = docs.where("text is not null and lang is not null")
    if train is not None:
        usable = usable.where(train)
    usable = usable.select("doc_id", "lang", utf8("text").alias("text"), F.xxhash64("doc_id").alias("_order"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return fit_field([], [])
    each = max(1, most // len(counts))
    # orders are evenly spread, so some twice as many as wanted, of each language, are below this
    edge = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, -(2.0**63) + 2.0**64 * min(1.0, (2.0 * each + 50) / n)))), F.col("lang"))
    few = usable.where(F.col("_order") <= edge).select("lang", "doc_id", "_order", F.octet_length("text").alias("size"), F.xxhash64("text").alias("_same"))
    over = W.partitionBy("lang").orderBy("_order", "doc_id", "size", "_same")
    few = few.withColumn("nth", F.row_number().over(over)).where(F.col("nth") <= each)
    chosen = few.withColumn("sum", F.sum("size").over(over.rowsBetween(W.unboundedPreceding, 0))).where(F.col("sum") <= most_bytes // len(counts)).select("doc_id", "lang").distinct()
    got = usable.where(F.col("_order") <= edge).join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text").orderBy("doc_id", "lang", "text").limit(most)
    return Field(**pickle.loads(got.select("text", "lang").coalesce(1).mapInArrow(_fit, "field binary").collect()[0].field))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The field of all (text, lang), pickled as a dict."""
    texts, langs = [], []
    for b in batches:
        texts += b.column(0).to_pylist()
        langs += b.column(1).to_pylist()
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(fit_field(texts, langs)))], pa.binary())], ["field"])


def label_words(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, nth, start, end, word, lang, p): each word of each whole text with its likeliest label and its probability.

    start and end are UTF-8 byte offsets. Words are parted by space and tab to carriage return. Null and empty texts
    have no words; ties go to the first label; null keys pass; rows repeat as they are. A field without labels gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(field)
    names = ["key", "nth", "start", "end", "word", "lang", "p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        for b in batches:
            buf, off = K.flat(b.column(1))
            for i, j in K.blocks(off):
                o, part = off[i : j + 1] - off[i], buf[off[i] : off[j]]
                lines = Lines(part, o, f.lexicon)
                if not f.labels or not len(lines.word):
                    continue
                p, _ = lines.marginals(lines.scores(f.weights), f.moves)
                best = p.argmax(1)
                nth = np.arange(len(best)) - np.searchsorted(lines.row, lines.row, "left")
                words = [part[a:z].tobytes().decode("utf-8", "replace") for a, z in zip(lines.start.tolist(), lines.end.tolist(), strict=True)]
                cols = [nth, lines.start - o[lines.row], lines.end - o[lines.row], words, [f.labels[c] for c in best.tolist()], p.max(1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(lines.row)), *map(pa.array, cols)], names)

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), utf8(text).alias("text")).mapInArrow(run, f"key {kind}, nth long, start long, end long, word string, lang string, p double")
    return out.withColumnRenamed("key", key)


def predict_language(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, words) of each whole text; words: expected number of words of each label, as a map.

    score is the share of lang_pred's words. A text that is null or without a letter, or a field without labels,
    gives `und` and 0. Ties go to the first label by code point. Rows repeat as they are; null keys pass; other
    columns are ignored; an empty table gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(field)  # TABLE rows of weights: a fixed bound for a label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        for b in batches:
            buf, off = K.flat(b.column(1))
            letters = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            total = np.zeros((len(off) - 1, len(f.labels)))
            for i, j in K.blocks(off, 1 << 20):
                lines = Lines(buf[off[i] : off[j]], off[i : j + 1] - off[i], f.lexicon)
                p, _ = lines.marginals(lines.scores(f.weights), f.moves)
                for c in range(len(f.labels)):
                    total[i:j, c] = np.bincount(lines.row, p[:, c], j - i)
            known = letters & (total.sum(1) > 0)
            share = total / np.maximum(total.sum(1, keepdims=True), 1e-9)
            best = share.argmax(1) if len(f.labels) else np.zeros(len(share), int)
            lang = [f.labels[c] if ok else UNDETERMINED for c, ok in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, share.max(1), 0.0) if len(f.labels) else np.zeros(len(share))
            counts = [list(zip(f.labels, x, strict=True)) if ok else [] for x, ok in zip(total.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(counts, pa.map_(pa.string(), pa.float64()))], ["key", "lang_pred", "score", "words"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("text"), F.coalesce(F.col(text).rlike(_LETTER), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, words map<string,double>").withColumnRenamed("key", key)
