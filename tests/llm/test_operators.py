"""Training-data operators against SQL, brute force, exact round trips and held-out labels."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from cellweave.llm import queries
from cellweave.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(df):
    def one(x):
        if x is None or x is pd.NA or x != x:
            return None
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted([tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_gif_round_trip(spark, texts):
    got = queries.op2_gif_media(spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


BASE = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m)]
    return [(kind, a, z) for a, _, kind, z in sorted(found)]


def check_secrets(got, texts):
    for r in got:
        spans = base_spans(texts[r.doc_id] or "")
        written = ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))


def test_secrets(spark, texts):
    got = queries.op9_secret_scan(spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts)
    check_secrets(got, texts)


def test_secrets_made(spark):
    from cellweave.llm.secret_scan import redact_secrets, scan_secrets

    made = {
        1: "Password = 'abc123def' and ToKeN:xy token: tok123 " + "a" * 30, 2: "AKIA" + "Z9" * 8 + " AKIAX", 3: "0" * 24 + "x" + "f" * 23, 4: None, 5: "", 6: "\U0001f600 secret=\U0001f600 api_key: A.b-c=/+ \U0001f600",
        7: "password=secret=hunter22", 8: "key Zk3Qp9LxT7vB2nM5wR8yC4dF6gH1jKsA end", 9: "x" * 50_000 + " apikey=" + "q" * 40,
    }
    docs = spark.createDataFrame([(k, v, "s") for k, v in made.items()], "doc_id long, text string, spans string")
    check_secrets(scan_secrets(docs).collect(), made)
    clean = {r.doc_id: r.text for r in redact_secrets(docs).collect()}
    assert clean[4] is None and clean[5] == "" and "hunter22" not in clean[7] and "AKIAZ9" not in clean[2] and clean[6].startswith("\U0001f600 secret=\U0001f600 [SECRET]")
    assert scan_secrets(docs.limit(0)).count() == 0


def test_language_held_out(spark, texts):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op6_language_id_crf(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert r.lang_pred == "und"
    held = [r for r in got if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.9


def test_quality_held_out(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op3_quality_classifier(spark, SF).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= 0.85


def test_token_counts(spark, texts):
    from cellweave.llm.token_counts import VOCABULARY, encoder, read_ranks

    encoding, _ = encoder(read_ranks(VOCABULARY))
    for r in queries.op7_token_counts(spark, SF).collect():
        text = texts[r.doc_id] or ""
        per = [int(x) for x in r.section_tokens.split(",") if x]
        assert r.n_tokens == len(encoding.encode(text, disallowed_special=())) == sum(per)
        assert r.n_sections == len(per) == len(text.split("\n")) - (text == "" or text.endswith("\n"))


def test_pipeline_against_its_stages(spark):
    """Each stage on its own input: near copies, planted items and secrets are gone from what the last stage gets."""
    import corpus_pipeline as p
    from test_jaccard_join import brute, shingle_set

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        after = {r.doc_id: r for r in kept.collect()}
        assert set(after) <= set(before) and kept.columns == docs.columns
        texts = {k: r.text for k, r in before.items()}
        if name.startswith("n-gram"):
            assert set(after) == {k for k, (_, root) in brute(texts, 5, 80).items() if k == root}
        elif name.startswith("benchmark"):
            items = [shingle_set(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leak = {k for k, t in texts.items() if any(i and 100 * len(i & shingle_set(t, 5)) >= 80 * len(i) for i in items)}
            assert set(after) == set(before) - leak
        elif name.startswith("secret"):
            assert set(after) == set(before)
            assert not any(base_spans(r.text or "") for r in after.values())
    out = p.run(spark, SF).collect()
    assert {r.doc_id for r in out} == set(after)
    assert all(0 <= r.taken <= 2 * r.size for r in out)


def test_secrets_of_a_text_with_many_hits(spark):
    """20,000 hits in one text, of all kinds and with tokens beside, inside and around them, in a few seconds."""
    import random
    import time

    from cellweave.llm.secret_scan import redact_secrets, scan_secrets

    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choices(letters, k=n))
    lines = []
    for i in range(5000):
        lines += [f"token={key(24)}", f"AKIA{key(16).upper()} {key(32)}", "".join(rng.choices("0123456789abcdef", k=32)), f"{key(22)}secret:{key(8)}"]
    made = {1: "\n".join(lines), 2: "plain"}
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    began = time.time()
    got = scan_secrets(docs).collect()
    clean = {r.doc_id: r.text for r in redact_secrets(docs).collect()}
    assert time.time() - began < 60
    check_secrets(got, made)
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got) >= 20_000 and not base_spans(clean[1]) and clean[2] == "plain"
    spans = [s.split(":") for s in next(r.spans for r in got if r.doc_id == 1).split(",")]
    out, at = [], 0
    for _, a, z in ((k, int(a), int(z)) for k, a, z in spans):
        if a >= at:
            out += [made[1][at:a], "[SECRET]"]
        at = max(at, z)
    assert clean[1] == "".join(out) + made[1][at:]
    # tokens that touch no base span, one by one
    base = base_spans(made[1])
    free = [m.span() for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", made[1])]
    edges = sorted((a, z) for _, a, z in base)
    reach, k, want = 0, 0, set()
    for a, z in free:
        while k < len(edges) and edges[k][0] <= a:
            reach, k = max(reach, edges[k][1]), k + 1
        if reach <= a and (k == len(edges) or edges[k][0] >= z):
            want.add((str(a), str(z)))
    assert {(a, z) for kind, a, z in spans if kind == "random"} <= want and len(want) > 4000
