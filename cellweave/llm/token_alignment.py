"""Alignment of two tokenizers: minimal groups of tokens over the same bytes, and how many documents hold each linked pair of ids.

A's tokens and B's tokens are the two sides of a graph, an edge wherever two of them overlap in bytes. Its connected components, found by
union-find, are the minimal groups: a component ends exactly where tokens of both sides end. All A-B pairs of a component are links.

Documents are encoded in blocks of bounded bytes, in the order in which a task reads them. A block hands on its documents' figures, each
document's distinct pairs (delta-coded and compressed) and the block's own distinct pairs with the number of its documents that hold them.
Only the latter meet by pair: counts are summed over blocks, compared with the best of their A id, and go back to the blocks that asked,
where documents add them up. So a pair that every document holds is one row a block, not one a document.

Texts that are null, empty, or whose tokens do not spell space+text have no tokens: zeros and ''. A document of any length is a block of
its own if need be. Ids of documents may be null or repeated; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.kernels import joined_roots
from cellweave.llm.shared import cut, utf8

#: Bytes of text of a block, links that are expanded at once, and pairs of a block's row.
BLOCK, LINKS, PAIRS = 8 << 20, 4 << 20, 1 << 20
#: The split of text into words that byte-level BPE vocabularies of this kind were made with (a fixed value).
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, others for U+0100 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level BPE of a tokenizer file. Where ids ascend in the order of merges, ids are ranks and the faster encoder serves."""

    def __init__(self, blob: bytes):
        spec, letters = json.loads(blob), byte_letters()
        special = {x["content"] for x in spec.get("added_tokens", [])}
        vocabulary = {k: i for k, i in spec["model"]["vocab"].items() if k not in special}
        self.pieces = {i: bytes(letters[c] for c in k) for k, i in vocabulary.items()}
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged == sorted(merged) and len(merged) + 256 == len(vocabulary):
            import tiktoken

            plain = tiktoken.Encoding("plain", pat_str=WORDS, mergeable_ranks={b: i for i, b in self.pieces.items()}, special_tokens={})
            self.encode = lambda texts: [plain.encode_ordinary(" " + t) for t in texts]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            whole = Tokenizer.from_str(blob.decode())
            whole.encode_special_tokens = True
            self.encode = lambda texts: [x.ids for x in whole.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Side B: a sentence-piece model, which adds the space itself."""

    def __init__(self, blob: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.pieces = {
            i: bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]
        }
        self.encode = lambda texts: model.encode(texts, num_threads=1)


class Side:
    """An encoder with its tokens' bytes in one array, and their ids as text with a separator, padded by 0 bytes."""

    def __init__(self, encoder: ByteLevel | Pieces):
        self.encode, n = encoder.encode, max(encoder.pieces, default=-1) + 1
        pieces = [encoder.pieces.get(i, b"") for i in range(n)]
        self.size = np.fromiter(map(len, pieces), np.int64, n)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.written = np.zeros((2, n, len(str(n)) + 1), np.uint8)
        for last in (0, 1):
            for i in range(n):
                text = np.frombuffer(f"{i}{(',', ';')[last]}".encode(), np.uint8)
                self.written[last, i, : len(text)] = text

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of tokens."""
        size = self.size[ids]
        at = np.cumsum(size) - size
        return self.bytes[np.repeat(self.start[ids] - at, size) + np.arange(int(size.sum()))]


_sides: dict[tuple[str, str], Side] = {}


def side(kind: type, blob: bytes) -> Side:
    """Made once in a worker."""
    name = (kind.__name__, hashlib.sha256(blob).hexdigest())
    if name not in _sides:
        _sides[name] = Side(kind(blob))
    return _sides[name]


def groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, counted from 0 by place; ends ascend, and both sides end at the same byte.

    Each stretch between neighbouring ends lies in one token of either side: an edge. A token without bytes has an edge to the first that
    ends where it does. Every component holds a token of A, and those come first, so a root is the first of its component's tokens of A.
    """
    n, total = len(end_a), int(end_a[-1]) if len(end_a) else 0
    mark = np.zeros(total + 1, bool)
    mark[end_a] = mark[end_b] = True
    ends = np.flatnonzero(mark)
    u, v = [np.searchsorted(end_a, ends)], [np.searchsorted(end_b, ends) + n]
    for end, base in ((end_a, 0), (end_b, n)):
        if len(bare := np.flatnonzero(np.diff(end, prepend=0) == 0)):
            u.append(bare + base)
            v.append(np.searchsorted(end, end[bare]) + base)
    root = joined_roots(np.arange(n + len(end_b)), np.concatenate(u), np.concatenate(v))
    number = np.cumsum(root[:n] == np.arange(n)) - 1
    return number[root[:n]], number[root[n:]]


def runs_of(group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and count of each group's run."""
    count = np.bincount(group, minlength=n)
    return np.cumsum(count) - count, count


def tallies(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their summed times."""
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(times, first) if len(key) else times


def linked_pairs(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs of ids (A's in the upper half) and their numbers of links. Links are expanded in bounded runs of groups;
    a group of more links is first counted by id on both sides, and its ids of A are taken in bounded runs."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    at_a, n_a = runs_of(group_a, n)
    at_b, n_b = runs_of(group_b, n)
    links = n_a * n_b
    done = np.cumsum(links)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(key: np.ndarray, times: np.ndarray) -> None:
        found.append(tallies(key, times))
        if sum(len(k) for k, _ in found[1:]) > LINKS:  # keep what waits within the distinct pairs
            found[:] = [tallies(*map(np.concatenate, zip(*found, strict=True)))]

    i = 0
    while i < n:
        if links[i] > LINKS:
            ids_a, times_a = np.unique(a[at_a[i] : at_a[i] + n_a[i]], return_counts=True)
            ids_b, times_b = np.unique(b[at_b[i] : at_b[i] + n_b[i]], return_counts=True)
            for k in range(0, len(ids_a), step := max(1, LINKS // len(ids_b))):
                some = slice(k, k + step)
                add(((ids_a[some, None] << 32) | ids_b[None]).ravel(), (times_a[some, None] * times_b[None]).ravel())
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(done, done[i] - links[i] + LINKS, "right")))
        j = i + int(np.argmax(links[i:j] > LINKS)) if (links[i:j] > LINKS).any() else j
        each, wide = links[i:j], n_b[i:j]
        k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        over, rest = np.divmod(k, np.repeat(wide, each))
        key = (a[np.repeat(at_a[i:j], each) + over].astype(np.int64) << 32) | b[np.repeat(at_b[i:j], each) + rest]
        add(key, np.ones(len(key), np.int64))
        i = j
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else tallies(*map(np.concatenate, zip(*found, strict=True)))


def written(one: Side, other: Side, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: groups in order, ids in decimal."""

    def cells(s: Side, ids: np.ndarray, group: np.ndarray, mark: int, wide: int) -> np.ndarray:
        last = np.ones(len(ids), bool)
        last[:-1] = group[1:] != group[:-1]
        out = np.zeros((len(ids), wide), np.uint8)
        out[:, : s.written.shape[2]] = s.written[last.astype(np.int64), ids]
        if mark:
            out[out == 59] = mark
        return out

    wide = max(one.written.shape[2], other.written.shape[2])
    both = np.empty((len(a) + len(b), wide), np.uint8)
    # a token's place: all of both sides in earlier groups, A's of its own group before B's
    both[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = cells(one, a, group_a, 124, wide)
    both[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = cells(other, b, group_b, 0, wide)
    flat = both.ravel()
    return flat[flat != 0][:-1].tobytes()


def packed(key: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending pairs as differences, bytes of one rank together, compressed."""
    step = np.diff(key, prepend=0).view(np.uint8).reshape(-1, 8).T
    return pa.compress(step.tobytes() + times.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, 16 * n, "zstd", asbytes=True), np.uint8).reshape(2, 8, n) if n else np.zeros((2, 8, 0), np.uint8)
    step, times = (np.ascontiguousarray(x.T).reshape(-1).view(np.int64) for x in raw)
    return np.cumsum(step), times


ENCODED = "block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_pairs long, groups_sha256 string, pairs binary, keys array<long>, docs array<long>"
SUMS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(texts: list[bytes], one: Side, other: Side) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, n_pairs, digest, distinct pairs, their links) of each text."""
    plain = [t.decode() for t in texts]
    some = [k for k, t in enumerate(plain) if t]
    none = (0, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
    out = [none] * len(texts)
    encoded = zip(some, one.encode([plain[k] for k in some]), other.encode([plain[k] for k in some]), strict=True)
    for k, a, b in encoded:
        a, b, want = np.array(a, np.int64), np.array(b, np.int64), np.frombuffer(b" " + texts[k], np.uint8)
        if not all(int(s.size[x].sum()) == len(want) and np.array_equal(s.spelled(x), want) for s, x in ((one, a), (other, b))):
            continue
        group_a, group_b = groups(np.cumsum(one.size[a]), np.cumsum(other.size[b]))
        key, times = linked_pairs(a, group_a, b, group_b)
        digest = hashlib.sha256(written(one, other, a, group_a, b, group_b)).hexdigest()
        out[k] = (len(a), len(b), int(group_a[-1]) + 1, int(times.sum()), len(key), digest, key, times)
    return out


def _encode(blob_a: bytes, blob_b: bytes, most: int) -> Callable:
    def block(name: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        one, other = side(ByteLevel, blob_a), side(Pieces, blob_b)
        key, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out, waiting = [], []
        for k in range(0, len(rows), 64):
            some = rows[k : k + 64]
            for (doc, _), r in zip(some, align([t for _, t in some], one, other), strict=True):
                out.append((name, doc, *r[:6], packed(r[6], r[7]) if r[4] else b"", None, None))
                waiting.append(r[6])
            if k + 64 >= len(rows) or sum(map(len, waiting)) > LINKS:
                fresh = np.concatenate(waiting)
                fresh, times = tallies(fresh, np.ones(len(fresh), np.int64))
                key, docs = tallies(np.concatenate([key, fresh]), np.concatenate([docs, times]))
                waiting = []
        for k in range(0, len(key), PAIRS):
            out.append((name, None, 0, 0, 0, 0, 0, None, None, key[k : k + PAIRS], docs[k : k + PAIRS]))
        fields = list(zip(*out, strict=True))
        schema = pa.schema([("block", pa.string()), *((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_pairs")), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("keys", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(fields, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, k, part = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                data = text.as_py()
                if rows and held + len(data) > most:
                    yield from block(f"{part}-{k}", rows)
                    rows, held, k = [], 0, k + 1
                rows.append((doc, data))
                held += len(data)
        if rows:
            yield from block(f"{part}-{k}", rows)

    return run


def _add_up(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
    """Each document of a block adds up what is known of its pairs."""
    order = np.argsort(pair := known["pair"].to_numpy())
    pair, count, best = pair[order], known["count"].to_numpy()[order], known["best"].to_numpy()[order]
    n_best, count_sum = [], []
    for blob, n in zip(docs["pairs"].to_pylist(), docs["n_pairs"].to_pylist(), strict=True):
        own, times = unpacked(blob, n)
        at = np.searchsorted(pair, own)
        count_sum.append(int((count[at] * times).sum()))
        n_best.append(int(times[best[at]].sum()))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return out.append_column("groups_sha256", docs["groups_sha256"])


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents each pair of ids is linked, and whether that is the highest count of its A id."""
    per_block = encoded.where("keys IS NOT NULL").select(F.explode(F.arrays_zip("keys", "docs")).alias("x")).select("x.*")
    counts = per_block.groupBy(F.col("keys").alias("pair")).agg(F.sum("docs").alias("count"))
    counts = cut(counts, "pairs")
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    a = F.shiftright("pair", 32)
    return counts.withColumn("a", a).join(top, "a").select("pair", "a", (F.col("pair").bitwiseAND(0xFFFFFFFF)).alias("b"), "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, tokenizer_a: bytes, model_b: bytes, block: int = BLOCK) -> DataFrame:
    """Figures of each document (SUMS) for a byte-level tokenizer file A and a sentence-piece model B, both given as bytes."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    encoded = cut(given.mapInArrow(_encode(tokenizer_a, model_b, block), ENCODED), "encoded")
    asked = encoded.where("keys IS NOT NULL").select(F.col("block").alias("asks"), F.explode("keys").alias("pair"))
    known = asked.join(pair_counts(encoded).select("pair", "count", "best"), "pair")
    own = encoded.where("keys IS NULL").drop("keys", "docs")
    return own.groupBy("block").cogroup(known.groupBy("asks")).applyInArrow(_add_up, SUMS)
