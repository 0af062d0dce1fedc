"""Removal of every long string that also starts in an earlier document, exact over the whole corpus.

All positions of a corpus are too many to shuffle, so suffixes are sorted sparsely and still exactly.
A window is LENGTH bytes. The smallest hash of its GRAM-byte grams, its anchor, depends on its bytes only,
so equal windows have equal anchors. Consecutive windows of one anchor form a run (one string). Steps:

1. anchors: each chunk of documents sends its distinct anchors, packed by bucket, with their numbers of
   distinct runs, and learns which of them other chunks hold too; all other windows are unique and drop out.
   It also learns which are hot, that is, of more than HOT distinct runs, summed over chunks.
2. windows: runs of shared anchors go to the anchor's bucket with the smallest doc_id of their chunk. Equal
   runs fall together; where different runs share an anchor, their windows' suffixes are ordered by
   deep-shallow sorting, and each window gets the smallest doc_id that holds it. (Equal runs are settled by hash
   tables, so the sort sees only anchors of several distinct runs.) Runs of hot anchors are cut
   into single windows, which go to the bucket of the window's own hash: equal windows still meet.
3. cover: each chunk learns which windows of its runs start in an earlier document and removes their bytes.

What one chunk sends to a bucket is distinct, so a window held by a third of all documents costs one record
a chunk. Around such a passage the run strings differ by document while the anchor inside it is the same; cut
into windows, these runs spread over all buckets, and no bucket gets over HOT runs of one anchor. Texts are shuffled
once: the three steps name the same exchange, which Spark reuses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import kernels as K
from cellweave.llm.shared import parts_for, text_bytes, utf8
from cellweave.llm.suffixes import deep_shallow_sort

LENGTH, GRAM = 50, 25
#: Windows of a run at most: their flags fit 32 bits.
RUN = 32
#: Text bytes of a chunk, and of what numpy takes at once.
CHUNK, PIECE = 4 << 20, 1 << 20
#: Chunks and buckets at least, so that small inputs spread too.
SPREAD = 48
#: Distinct runs of an anchor, summed over chunks, beyond which its windows go their own ways; 16 bits count them in a chunk.
HOT = 1 << 15
LAST = np.iinfo(np.int64).max
U = np.uint64


def grams(buf: np.ndarray, size: int) -> np.ndarray:
    """A 48-bit hash of the gram at each position."""
    h, width = {1: K._TABLE[buf]}, 1
    while 2 * width <= size:
        a = h[width]
        h[2 * width] = a[:-width] * U(pow(K._M, width, 2**64)) + a[width:]
        width *= 2
    out, have = h[width], width
    while have < size:
        step = 1 << ((size - have).bit_length() - 1)
        n = len(buf) - have - step + 1
        out = out[:n] * U(pow(K._M, step, 2**64)) + h[step][have : have + n]
        have += step
    return K.mix(out) >> U(16)


def anchored_runs(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor, first window, end (exclusive) and row of each run of windows; windows keep within their row."""
    if len(buf) < length:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    low, width, span = grams(buf, gram), 1, length - gram + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n = len(buf) - length + 1
    if width < span:
        low = np.minimum(low[:n], low[span - width : span - width + n])
    size = np.maximum(np.diff(off) - length + 1, 0)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + off[row]
    low = low[at]
    cut = np.ones(len(low), bool)
    cut[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(cut)
    place = np.arange(len(low)) - np.repeat(first, np.diff(np.append(first, len(low))))
    first = np.flatnonzero(place % RUN == 0)
    end = np.append(first[1:], len(low))
    return low[first], at[first], at[first] + (end - first), row[first]


def pack(values: np.ndarray) -> bytes:
    """Sorted 48-bit values as six planes of bytes of their steps."""
    step = np.diff(values, prepend=U(0))
    return step.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.zeros((len(data) // 6, 8), np.uint8)
    planes[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return np.cumsum(planes.reshape(-1).view(np.uint64), dtype=np.uint64)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; starts ascend."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + PIECE)))
        base = start[i]
        out[i:j] = K.word_hashes(buf[base : end[i:j].max()], start[i:j] - base, end[i:j] - base, fold=False)
        i = j
    return out


def by_bucket(values: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket's places in values, in their order."""
    b = (values % U(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    for s, e in zip(*K.runs(b[order]), strict=True):
        yield int(b[order[s]]), order[s:e]


class Chunk:
    """The documents of one chunk by doc_id, then text, with the runs of each."""

    def __init__(self, docs: pa.Table, length: int, gram: int) -> None:
        ids = docs["doc_id"].to_numpy(zero_copy_only=False) if not docs["doc_id"].null_count else docs["doc_id"].fill_null(LAST).to_numpy()
        docs = docs.take(pa.array(np.lexsort((docs["text"].combine_chunks().to_numpy(zero_copy_only=False), ids)))) if len(docs) > 1 else docs
        self.doc_id = docs["doc_id"]
        self.order = docs["doc_id"].fill_null(LAST).to_numpy()
        self.buf, self.off = K.flat(docs["text"])
        parts = []
        for i, j in K.blocks(self.off, PIECE):
            base = self.off[i]
            key, first, end, row = anchored_runs(self.buf[base : self.off[j]], self.off[i : j + 1] - base, length, gram)
            parts.append((key, first + base, end + base, row + i))
        self.key, self.first, self.end, self.row = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else anchored_runs(self.buf, self.off, length, gram)

    def distinct_runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors and how many distinct runs each has."""
        values, at, count = np.unique(self.key, return_inverse=True, return_counts=True)
        many = np.flatnonzero(count[at] > 1)
        if len(many):
            _, one = np.unique(span_hashes(self.buf, self.first[many], self.end[many] + length - 1), return_index=True)
            count = np.where(count > 1, np.bincount(at[many[one]], minlength=len(values)), count)
        return values, count

    def cut_hot(self, hot: np.ndarray, length: int) -> None:
        """Cut the runs of hot anchors into single windows, each by its own hash; anchor keeps what the runs had."""
        is_hot = np.isin(self.key, hot)
        self.anchor = self.key
        if not is_hot.any():
            return
        n = np.where(is_hot, self.end - self.first, 1)
        of = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        single = np.flatnonzero(is_hot[of])
        self.first, self.end = self.first[of] + nth, self.end[of]
        self.end[single] = self.first[single] + 1
        self.anchor, self.row = self.anchor[of], self.row[of]
        self.key = self.anchor.copy()
        self.key[single] = span_hashes(self.buf, self.first[single], self.first[single] + length)

    def shared_here(self) -> np.ndarray:
        """Anchors that two documents of this chunk hold."""
        doc = self.order[self.row]
        by = np.lexsort((doc, self.anchor))
        key, doc = self.anchor[by], doc[by]
        return np.unique(key[1:][(key[1:] == key[:-1]) & (doc[1:] != doc[:-1])])

    def entries(self, shared: np.ndarray, buckets: int, length: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(run, bucket, number among the bucket's distinct strings, string) of each run with a shared anchor.

        Runs are in the order of doc_id, so that a string's first entry has the chunk's smallest doc_id."""
        every = np.union1d(shared, self.shared_here())
        at = np.searchsorted(every, self.anchor) if len(every) else np.zeros(len(self.anchor), np.int64)
        mine = np.flatnonzero(every[np.minimum(at, len(every) - 1)] == self.anchor) if len(every) else at[:0]
        data, known, count = self.buf.tobytes(), {}, {}
        tail = length - 1
        for run, s, e, b in zip(mine.tolist(), self.first[mine].tolist(), self.end[mine].tolist(), (self.key[mine] % U(buckets)).tolist(), strict=True):
            text = data[s : e + tail]
            k = known.get(text)
            if k is None:
                k = known[text] = count.get(b, 0)
                count[b] = k + 1
            yield run, b, k, text


def _anchors(buckets: int, length: int, gram: int):
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("runs", pa.binary())])

    def send(key: tuple, docs: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        values, runs = Chunk(docs, length, gram).distinct_runs(length)
        runs = np.minimum(runs, np.iinfo(np.uint16).max).astype(np.uint16)
        rows = [(b, chunk, pack(values[at]), runs[at].tobytes()) for b, at in by_bucket(values, buckets)]
        return pa.table([list(x) for x in zip(*rows, strict=True)] or [[]] * 4, schema=schema)

    return send


def _shared(hot: int):
    def told(key: tuple, sent: pa.Table) -> pa.Table:
        """Back to each chunk: those of its anchors that another chunk sent too, and which of these are hot."""
        chunks = sent["chunk"].to_numpy()
        values = [unpack(x) for x in sent["data"].to_pylist()]
        of = np.repeat(np.arange(len(chunks)), [len(v) for v in values])
        v = np.concatenate(values)
        runs = np.frombuffer(b"".join(sent["runs"].to_pylist()), np.uint16)
        by = np.lexsort((of, v))
        v, of, runs = v[by], of[by], runs[by]
        twin = np.zeros(len(v), bool)
        twin[1:] = v[1:] == v[:-1]
        twin[:-1] |= twin[1:]
        v, of, runs = v[twin], of[twin], runs[twin]
        s, e = K.runs(v)
        many = np.repeat(np.add.reduceat(runs.astype(np.int64), s) > hot, e - s) if len(v) else twin[:0]
        by = np.argsort(of, kind="stable")
        v, of, many = v[by], of[by], many[by]
        out = []
        for s, e in zip(*K.runs(of), strict=True):
            out.append((int(chunks[of[s]]), SHARED, pack(v[s:e])))
            if many[s:e].any():
                out.append((int(chunks[of[s]]), MANY, pack(v[s:e][many[s:e]])))
        return pa.table([list(x) for x in zip(*out, strict=True)] or [[], [], []], schema=BACK)

    return told


#: In place of a bucket: anchors that other chunks share, and the hot ones of these.
SHARED, MANY = -1, -2
BACK = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("strings", pa.binary())])


def _told(back: pa.Table, what: int) -> np.ndarray:
    """The anchors that came back as SHARED, or as MANY."""
    parts = [unpack(d) for b, d in zip(back["bucket"].to_pylist(), back["data"].to_pylist(), strict=True) if b == what]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _windows(buckets: int, length: int, gram: int):
    def send(key: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not len(docs):
            return SENT.empty_table()
        chunk, out = Chunk(docs, length, gram), {}
        chunk.cut_hot(_told(back, MANY), length)
        for run, b, k, text in chunk.entries(_told(back, SHARED), buckets, length):
            got = out.setdefault(b, ([], []))
            if k == len(got[0]):
                got[0].append(run)
                got[1].append(text)
        rows = []
        for b, (first, strings) in out.items():
            first = np.array(first)
            rows.append((b, key[0].as_py(), chunk.order[chunk.row[first]].tobytes(), chunk.key[first].tobytes(), np.array([len(x) for x in strings], np.int32).tobytes(), b"".join(strings)))
        return pa.table([list(x) for x in zip(*rows, strict=True)] or [[]] * 6, schema=SENT)

    return send


def _earliest(length: int):
    def settle(key: tuple, sent: pa.Table) -> pa.Table:
        """For each string a chunk sent: its windows that start in a document before that chunk's first holder."""
        of, doc, anchor, strings = [], [], [], []
        for i, row in enumerate(sent.to_pylist()):
            sizes = np.frombuffer(row["sizes"], np.int32)
            ends = np.cumsum(sizes).tolist()
            strings += [row["strings"][e - s : e] for s, e in zip(sizes.tolist(), ends, strict=True)]
            of.append(np.full(len(sizes), i))
            doc.append(np.frombuffer(row["docs"], np.int64))
            anchor.append(np.frombuffer(row["keys"], np.uint64))
        of, doc, anchor = (np.concatenate(x) for x in (of, doc, anchor))
        ids: dict[bytes, int] = {}
        rep = np.array([ids.setdefault(x, len(ids)) for x in strings])
        distinct = list(ids)
        low = np.full(len(distinct), LAST)
        np.minimum.at(low, rep, doc)
        key_of = np.zeros(len(distinct), np.uint64)
        key_of[rep] = anchor
        size = np.array([len(x) for x in distinct]) - length + 1
        _, inverse, count = np.unique(key_of, return_inverse=True, return_counts=True)
        open_ = np.flatnonzero(count[inverse] > 1)
        flags = np.zeros(len(distinct), np.uint32)
        if len(open_):
            buf = np.frombuffer(b"".join(distinct[i] for i in open_), np.uint8)
            n = size[open_]
            begin = np.cumsum(n + length - 1) - (n + length - 1)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(open_, n)
            order, head = deep_shallow_sort(buf, np.repeat(begin, n) + nth, length)
            group = np.cumsum(head) - 1
            first = np.minimum.reduceat(low[owner[order]], np.flatnonzero(head))
            early = first[group] < low[owner[order]]
            np.bitwise_or.at(flags, owner[order][early], np.uint32(1) << nth[order][early].astype(np.uint32))
        full = ((np.int64(1) << size.astype(np.int64)) - 1).astype(np.uint32)
        mask = np.where(low[rep] < doc, full[rep], flags[rep])
        chunks, out = sent["chunk"].to_pylist(), []
        for s, e in zip(*K.runs(of), strict=True):
            if mask[s:e].any():
                out.append((chunks[of[s]], key[0].as_py(), mask[s:e].tobytes()))
        return pa.table([list(x) for x in zip(*out, strict=True)] or [[], [], []], schema=BACK)

    return settle


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>"


def _cover(buckets: int, length: int, gram: int, keep: bool):
    arrow = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def remove(key: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not len(docs):
            return arrow.empty_table()
        chunk = Chunk(docs, length, gram)
        chunk.cut_hot(_told(back, MANY), length)
        masks = {b: np.frombuffer(d, np.uint32).tolist() for b, d in zip(back["bucket"].to_pylist(), back["data"].to_pylist(), strict=True) if b >= 0}
        held: dict[tuple[int, int], int] = {}
        whole, some = [], []
        order, row = chunk.order.tolist(), chunk.row.tolist()
        for run, b, k, _ in chunk.entries(_told(back, SHARED), buckets, length):
            d = order[row[run]]
            if held.setdefault((b, k), d) < d:
                whole.append(run)
            elif b in masks and (m := masks[b][k]):
                some.append((run, m))
        edge = np.zeros(len(chunk.buf) + 1, np.int32)
        whole = np.array(whole, np.int64)
        np.add.at(edge, chunk.first[whole], 1)
        np.add.at(edge, chunk.end[whole] + length - 1, -1)
        if some:
            run, m = (np.array(x) for x in zip(*some, strict=True))
            bit = (m[:, None] >> np.arange(RUN)) & 1
            which, nth = np.nonzero(bit)
            start = chunk.first[run[which]] + nth
            np.add.at(edge, start, 1)
            np.add.at(edge, start + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for i in range(len(order)):
            s, e = chunk.off[i], chunk.off[i + 1]
            g = gone[s:e]
            kept = chunk.buf[s:e][~g].tobytes()
            turn = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
            spans = [{"start": int(a), "end": int(z)} for a, z in turn.reshape(-1, 2)] if keep else None
            out.append((int(e - s), int(e - s) - len(kept), len(turn) // 2, hashlib.sha256(kept).hexdigest(), kept if keep else None, spans))
        cols = [list(x) for x in zip(*out, strict=True)]
        return pa.table([chunk.doc_id.combine_chunks(), *(pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(cols))], schema=arrow)

    return remove


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: bool = True, hot: int = HOT) -> DataFrame:
    """Per row of docs (doc_id, text): what is left without the bytes that any string of length bytes covers
    which also starts in a row of smaller doc_id. Strings are compared as UTF-8 bytes within rows, on the input.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if keep, kept (the
    bytes left) and spans. Null text is empty. A null doc_id counts as larger than all others; rows of equal
    doc_id don't remove from each other. Repeated rows each give a row; extra columns are ignored; an empty
    table gives no rows. Copies in longer texts cost no more than one record a chunk. hot is as HOT above, and
    changes no result.
    """
    if not 0 <= hot < 1 << 16:
        raise ValueError("hot must be less than 65536")
    if gram < 2 or not 0 <= length - gram < RUN:
        raise ValueError(f"gram must be 2 to length and more than length - {RUN}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    chunks = buckets = parts_for(text_bytes(docs, "text"), CHUNK, SPREAD)
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    text = docs.groupBy("chunk")
    shared = text.applyInArrow(_anchors(buckets, length, gram), "bucket long, chunk long, data binary, runs binary").groupBy("bucket").applyInArrow(_shared(hot), "chunk long, bucket long, data binary")
    sent = text.cogroup(shared.groupBy("chunk")).applyInArrow(_windows(buckets, length, gram), "bucket long, chunk long, docs binary, keys binary, sizes binary, strings binary")
    early = sent.groupBy("bucket").applyInArrow(_earliest(length), "chunk long, bucket long, data binary")
    return text.cogroup(shared.unionByName(early).groupBy("chunk")).applyInArrow(_cover(buckets, length, gram, keep), RESULT)
