"""Tokenizer alignment, the Merkle manifest and SimHash groups against plain Python over whole tables, and rows that are odd."""

import hashlib
import itertools
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

from cellweave.llm import merkle_manifest as M
from cellweave.llm import queries
from cellweave.llm import simhash_ring as S
from cellweave.llm import token_alignment as T

SF = "/root/testdata/sf0.001"
FILES = Path("/opt/tokenizers")
ODD = [None, "", " ", "a", "A a", "naïve café ▁x <|endoftext|> <s>", "\U0001f469‍\U0001f4bb 日本語テキスト\x00\x01", "x" * 3000, "the  cat\n\n\tsat " * 40, "12345678901234567890" * 9, "the cat sat"]


@pytest.fixture(scope="module")
def blobs():
    return [(FILES / n).read_bytes() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def plain_alignment(texts, blobs):
    """By the libraries themselves, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_str(blobs[0].decode())
    one.encode_special_tokens = True
    other = sentencepiece.SentencePieceProcessor(model_proto=blobs[1])
    letters = T.byte_letters()
    words = {i: bytes(letters.get(c, 0) for c in w) for w, i in one.get_vocab().items()}

    def piece(i):
        p = other.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if other.is_byte(i) else p.replace("▁", " ").encode()

    linked, rows = [], []
    for t in texts:
        a, b = one.encode(" " + (t or ""), add_special_tokens=False).ids, other.encode(t or "")
        ba, bb, want = [words[i] for i in a], [piece(i) for i in b], (" " + (t or "")).encode()
        if not t or b"".join(ba) != want or b"".join(bb) != want:
            linked.append(Counter())
            rows.append((0, 0, 0, 0, ""))
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (ba, bb))
        cuts = sorted(set(ends_a) & set(ends_b))
        pair, text, at = Counter(), [], (0, 0)
        for z in cuts:
            to = (ends_a.index(z, at[0]) + 1, ends_b.index(z, at[1]) + 1)
            own_a, own_b = a[at[0] : to[0]], b[at[1] : to[1]]
            pair.update(itertools.product(own_a, own_b))
            text.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
            at = to
        linked.append(pair)
        rows.append((len(a), len(b), len(cuts), pair.total(), hashlib.sha256(";".join(text).encode()).hexdigest()))
    count = Counter(p for x in linked for p in x)
    most = Counter()
    for (a, _), c in count.items():
        most[a] = max(most[a], c)
    return [(*r[:4], sum(k for p, k in x.items() if count[p] == most[p[0]]), sum(k * count[p] for p, k in x.items()), r[4]) for r, x in zip(rows, linked, strict=True)]


def figures(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def test_alignment_of_all_documents(spark, blobs):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, plain_alignment(list(texts.values()), blobs), strict=True))
    assert figures(queries.op11_cross_tokenizer_alignment(spark, SF)) == want


def test_alignment_of_odd_texts_in_small_blocks(spark, blobs, monkeypatch):
    monkeypatch.setattr(T, "LINKS", 7)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)], "doc_id long, text string, block string, pair int")
    assert figures(T.align_tokenizers(docs, *blobs, block=64)) == dict(enumerate(plain_alignment(ODD, blobs)))
    assert T.align_tokenizers(docs.limit(0), *blobs).count() == 0
    twice = spark.createDataFrame([(None, "the cat"), (None, "the cat"), (5, "the cat")], "doc_id long, text string")
    assert len({r[1:] for r in T.align_tokenizers(twice, *blobs).collect()}) == 1


def test_minimal_groups_and_links():
    rng = random.Random(3)
    for _ in range(200):
        total = rng.randint(1, 30)
        a, b = (sorted({*rng.sample(range(1, total + 1), rng.randint(1, total)), total}) for _ in "ab")
        got_a, got_b = T.groups(np.array(a), np.array(b))
        cuts = sorted(set(a) & set(b))
        assert [got_a.tolist(), got_b.tolist()] == [[sum(c < e for c in cuts) for e in x] for x in (a, b)]
        ids = [np.array([rng.randint(0, 3) for _ in x]) for x in (a, b)]
        key, times = T.linked_pairs(ids[0], got_a, ids[1], got_b)
        want = Counter((int(x), int(y)) for x, g in zip(ids[0], got_a, strict=True) for y, h in zip(ids[1], got_b, strict=True) if g == h)
        assert {(k >> 32, k & 0xFFFFFFFF): n for k, n in zip(key.tolist(), times.tolist(), strict=True)} == want
        assert [x.tolist() for x in T.unpacked(T.packed(key, times), len(key))] == [key.tolist(), times.tolist()]
    assert [x.tolist() for x in T.groups(np.array([0, 2, 2, 3]), np.array([2, 3, 3]))] == [[0, 0, 0, 1], [0, 1, 1]]


def plain_tree(nodes):
    """All levels of a list of hex digests."""
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([hashlib.sha256("".join(rows[-1][k : k + 8]).encode()).hexdigest() for k in range(0, len(rows[-1]), 8)])
    return rows


def siblings(rows, i):
    out = []
    for row in rows[:-1]:
        k = i - i % 8
        out.append(("".join(row[k:i]), "".join(row[i + 1 : k + 8])))
        i //= 8
    return out


def plain_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: hashlib.sha256("".join(map(field, r)).encode()).hexdigest()
    low = lambda s: s and "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: plain_tree([leaf(r) for r in rs]) for g, rs in groups.items()}
    top = plain_tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf((*r[:4], low(r[4]))) if bad else leaf(r)
            for a, z in path:
                h = hashlib.sha256((a + h + z).encode()).hexdigest()
            proof = hashlib.sha256("".join(a + z for a, z in path).encode()).hexdigest()
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return sorted(out, key=str)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_of_all_documents(spark):
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r[c] for c in MANIFEST) for r in queries.op12_merkle_manifest(spark, SF).collect()]
    assert sorted(got, key=str) == plain_manifest(rows)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("rows", [1, 2, 90, 700])
def test_manifest_of_many_blocks_and_odd_rows(spark, tmp_path, rows):
    """Groups of several sizes, null and repeated keys, blocks of two levels so that paths are put together over several passes."""
    made = [(None if i % 50 == 7 else i - i % 3, None if i % 5 == 0 else "s", ["en", None, "de", f"l{i}", ""][(i % 11) % 5 if i % 11 < 4 else 0], None if i % 4 else i, (None, "", "Tü" * i, "ABC")[i % 4], i) for i in range(rows)]
    docs = spark.createDataFrame(made, "doc_id long, source string, lang string, n_chars long, text string, grp int")
    lowered = M.F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    probe = {"text": M.F.when(M.F.crc32(M.F.col("doc_id").cast("string")) % 3 == 0, lowered).otherwise(M.F.col("text"))}
    out = M.merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", probe, proofs=True, tree=M.Tree(levels=2, height=1)).collect()
    assert sorted((tuple(r[c] for c in MANIFEST) for r in out), key=str) == plain_manifest([r[:5] for r in made])
    assert all(hashlib.sha256(r.proof.encode()).hexdigest() == r.proof_sha256 for r in out)


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert M.merkle_manifest(docs, ["doc_id", "text"], "doc_id", "lang").count() == 0


@pytest.mark.parametrize(("n", "levels", "height"), [(1, 0, 2), (5, 1, 2), (8, 1, 2), (9, 2, 2), (64, 2, 2), (65, 4, 2), (513, 4, 2), (600, 6, 2), (700, 5, 2), (100, 3, 1)])
def test_traversal(n, levels, height):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    rows = [leaves]
    for _ in range(levels):
        rows.append([hashlib.sha256("".join(rows[-1][k : k + 8]).encode()).hexdigest() for k in range(0, len(rows[-1]), 8)])
    got = list(M.traverse([x.encode() for x in leaves], levels, 8, height))
    assert got == [[(a.encode(), z.encode()) for a, z in siblings(rows, i)] for i in range(n)]
    assert all(M.unpack(M.pack(p)) == p for p in got)


def plain_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, most=4):
    root = {f: f for f in fps}
    find = lambda f: f if root[f] == f else find(root[f])
    for x, y in itertools.combinations(set(fps), 2):
        if (x ^ y).bit_count() <= most:
            root[find(x)] = find(y)
    low = {}
    for i, f in zip(ids, fps, strict=True):
        low[find(f)] = min(low.get(find(f), i), i)
    return {i: (f"{f:016x}", low[find(f)]) for i, f in zip(ids, fps, strict=True)}


def test_simhash_of_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op13_simhash_near_dedup(spark, SF).collect()}
    assert got == plain_components(list(texts), [plain_fingerprint(t) for t in texts.values()])


@pytest.mark.parametrize(("cell", "task", "most"), [(S.CELL, S.TASK, 4), (20, 200, 4), (20, 200, 2), (50, 1000, 7)])
def test_links_of_dense_fingerprints(spark, cell, task, most):
    """Families around a few centres, of all distances about the limit; small cells part hot buckets into lanes."""
    rng = random.Random(most)
    fps = set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(16):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, most + 1)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps) + [0, 1, 2**64 - 1]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = S.near_links(spark.createDataFrame(signed, "fp long"), most, cell, task).collect()
    root = {f: f for (f,) in signed}
    find = lambda f: f if root[f] == f else find(root[f])
    for r in edges:
        root[find(r.a)] = find(r.b)
    parts = {}
    for (f,), u in zip(signed, fps, strict=True):
        parts.setdefault(find(f), set()).add(u)
    want = plain_components(fps, fps, most)
    assert {min(p): p for p in parts.values()} == {k: {f for f in fps if want[f][1] == k} for k in {x[1] for x in want.values()}}


def test_every_difference_within_the_limit_is_a_candidate():
    rng = random.Random(0)
    segments = S.ring(4)
    for size in range(5):
        for _ in range(300):
            x = np.array([sum(1 << b for b in rng.sample(range(64), size))], np.uint64)
            assert any(S.chained(x, np.array([i]), segments, 4)[0] for i in range(5))


def test_simhash_of_odd_rows(spark):
    made = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (None, "one  TWO"), (5, "one two three four five " * 3000), (5, "x"), (6, "x"), (None, "lone words")]
    docs = spark.createDataFrame([(*r, "c", 7) for r in made], "doc_id long, text string, component string, fp int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_components(docs).collect()), key=str)
    hexed = [f"{plain_fingerprint(t):016x}" for _, t in made]
    want = sorted(zip((i for i, _ in made), hexed, (1, 1, 1, 4, 4, 5, 5, 5, None), strict=True), key=str)
    assert got == want
    assert S.simhash_components(docs.limit(0)).count() == 0
