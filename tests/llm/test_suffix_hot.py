"""Suffix dedup where one passage stands in many documents, with other bytes around it in each."""

import random

import pyarrow as pa
import pytest

from cellweave.llm import suffix_dedup as S


def made(n):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60))
    passage = word()
    return {i: word() + passage + word() for i in range(n)}


def brute(texts, length=50):
    low = {}
    for i, t in sorted(texts.items()):
        for k in range(len(t) - length + 1):
            low.setdefault(t[k : k + length], i)
    out = {}
    for i, t in texts.items():
        gone = {j for k in range(len(t) - length + 1) if low[t[k : k + length]] < i for j in range(k, k + length)}
        out[i] = "".join(c for j, c in enumerate(t) if j not in gone).encode()
    return out


def test_runs_of_a_hot_anchor_spread_over_buckets():
    docs, buckets = list(made(240).items()), 8
    chunks = [pa.table({"doc_id": [i for i, _ in docs[k::4]], "text": pa.array([t.encode() for _, t in docs[k::4]], pa.binary())}) for k in range(4)]
    sent = pa.concat_tables([S._anchors(buckets, 50, 25)((pa.scalar(k),), c) for k, c in enumerate(chunks)])
    back = pa.concat_tables([S._shared(50)((pa.scalar(b),), sent.filter(pa.compute.equal(sent["bucket"], b))) for b in range(buckets)])
    out = [S._windows(buckets, 50, 25)((pa.scalar(k),), c, back.filter(pa.compute.equal(back["chunk"], k))) for k, c in enumerate(chunks)]
    size = [0] * buckets
    for t in out:
        for b, sizes in zip(t["bucket"].to_pylist(), t["sizes"].to_pylist(), strict=True):
            size[b] += len(sizes) // 4
    assert sum(size) > 1000 and max(size) < 2 * sum(size) / buckets


@pytest.mark.parametrize("hot", [0, 50, S.HOT])
def test_hot_anchors_change_no_result(spark, hot):
    texts = made(150) | {1000: "x" * 300, 1001: "y" + "x" * 200, 1002: None, 1003: "", 1004: "short"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in S.suffix_dedup(docs, hot=hot).collect()}
    assert got == brute({i: t or "" for i, t in texts.items()})
