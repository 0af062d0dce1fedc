"""Numpy kernels over batches of whole texts laid end to end (bytes plus offsets)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that the kernels take at once; a longer text goes alone.
BLOCK = 1 << 20
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLDED = _TABLE[_FOLD]
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_M = 0x9E3779B97F4A7C15
_W = U(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _M), ("down", pow(_M, -1, 2**64))):
            ones = np.full(size, base, np.uint64)
            ones[0] = 1
            _powers[name] = np.multiply.accumulate(ones)
    return _powers["up"], _powers["down"]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values end to end, and their offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def blocks(off: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: bytes other than space, tab to carriage return; rows part words."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_GAP[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.empty(len(buf), bool)
    before[0] = True
    np.logical_not(word[:-1], out=before[1:])
    start = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = True
    np.logical_not(word[1:], out=after[:-1])
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span; fold lower-cases A to Z first."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _TABLE)[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each n-word shingle, in text order; a row of fewer words is one shingle."""
    start, end, row = spans(buf, off)
    h = word_hashes(buf, start, end)
    if not len(h):
        return row, h
    count = np.bincount(row, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    k = len(h) - n + 1
    rows, out = [], []
    if k > 0:
        s = np.full(k, n, np.uint64)
        for i in range(n):
            s = s * _W + h[i : i + k]
        whole = row[:k] == row[n - 1 :]
        rows.append(row[:k][whole])
        out.append(mix(s[whole]))
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        s = np.full(len(short), m, np.uint64)
        for i in range(m):
            s = s * _W + h[first[short] + i]
        rows.append(short)
        out.append(mix(s))
    r, s = np.concatenate(rows), np.concatenate(out)
    order = np.argsort(r, kind="stable")
    return r[order], s[order]


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash), by row, then hash."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values."""
    if not len(x):
        z = np.zeros(0, np.int64)
        return z, z
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return start, np.concatenate([start[1:], [len(x)]])


def overlap(texts_a: pa.Array, texts_b: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes of each pair of texts and of what their shingles share."""
    a = distinct(*shingles(*flat(texts_a), n))
    b = distinct(*shingles(*flat(texts_b), n))
    row, h = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    both = row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])]
    size = len(texts_a)
    return tuple(np.bincount(x, minlength=size) for x in (a[0], b[0], both))


def joined_roots(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find: the roots once u and v are joined. A root hooks onto a smaller one, then paths are halved, until no edge joins two."""
    while True:
        a, b = root[u], root[v]
        live = a != b
        if not live.any():
            return root
        u, v, a, b = u[live], v[live], a[live], b[live]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(shorter := root[root], root):
            root = shorter
