"""Codecs, attribution, chains and joins of the training-data operators against plain Python, and rows that are odd."""

import gzip
import io
import itertools
import math
import random
import zlib

import numpy as np
import pytest


def plain_lzw(data, least, size):
    """A textbook LZW decoder, code by code."""
    clear, out, acc, have, width, table, before = 1 << least, bytearray(), 0, 0, least + 1, [], None
    for byte in data:
        acc |= byte << have
        have += 8
        while have >= width:
            code, acc, have = acc & ((1 << width) - 1), acc >> width, have - width
            if code == clear:
                table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, None
                continue
            if code == clear + 1:
                return bytes(out[:size])
            entry = table[code] if code < len(table) else before + before[:1]
            if before is not None and len(table) < 4096:
                table.append(before + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            out += entry
            before = entry
    return bytes(out[:size])


@pytest.mark.parametrize("size", [1, 2, 63, 254, 255, 256, 257, 511, 4000, 70_000])
def test_lzw_both_ways(size):
    from cellweave.llm.gif_media import lzw_decode, lzw_encode

    rng = random.Random(size)
    for letters in (bytes(range(256)), b"abcd ", b"a"):
        pixels = bytes(rng.choice(letters) for _ in range(size))
        stream = lzw_encode(pixels)
        assert plain_lzw(stream, 8, size) == pixels == lzw_decode(stream, 8, size).tobytes()


def test_gif_frames_palettes_and_disposal():
    from cellweave.llm.gif_media import composed, encode_gif, frame_histograms, grey_palette, read_gif, warm_palette

    rng = random.Random(1)
    payload = bytes(rng.choice(b"\0\0abcxyz\xff") for _ in range(64 * 70))
    width, height, frames = read_gif(encode_gif(payload, rows=16))
    assert (width, height, len(frames)) == (64, 16, 5) and b"".join(f.indices.tobytes() for f in frames) == payload
    assert [f.disposal for f in frames] == [1, 2, 3, 1, 2] and [f.delay for f in frames] == [10] * 5
    assert all((f.palette == (warm_palette() if k % 2 else grey_palette())).all() for k, f in enumerate(frames))
    # pixel by pixel
    canvas = [[(0, 0, 0, 0)] * 64 for _ in range(16)]
    for f, shown, histogram in zip(frames, composed(width, height, frames), frame_histograms(width, height, frames), strict=True):
        saved = [list(r) for r in canvas]
        for y, x in itertools.product(range(f.indices.shape[0]), range(64)):
            if (i := int(f.indices[y, x])) != f.clear:
                canvas[y][x] = (*map(int, f.palette[i]), 255)
        assert shown.tolist() == [[list(p) for p in r] for r in canvas]
        want = [0] * 64
        for p in itertools.chain(*canvas):
            if p[3]:
                want[p[0] // 64 * 16 + p[1] // 64 * 4 + p[2] // 64] += 1
        assert histogram.tolist() == want
        if f.disposal == 2:
            for y, x in itertools.product(range(f.indices.shape[0]), range(64)):
                canvas[y][x] = (0, 0, 0, 0)
        elif f.disposal == 3:
            canvas = saved


def test_damaged_gifs_are_errors(spark):
    from cellweave.llm.gif_media import encode_gif, gif_columns

    good = encode_gif(b"x" * 128)
    df = spark.createDataFrame([(1, good), (2, good[:800]), (3, b"no"), (4, None)], "key long, media binary")
    got = {r.key: r for r in gif_columns(df, "key", "media").collect()}
    assert bytes(got[1].pixels) == b"x" * 128 and got[1].error is None and got[1].frames[0].delay_cs == 10
    assert all(got[k].pixels is None and got[k].error and got[k].frames == [] for k in (2, 3, 4))


def test_arc_versions_and_record_ids(spark):
    from cellweave.llm.warc import convert_pages, read_arc, write_arc

    records = [(b"http://a/%20b", b"20240102030405", b"text/html", b"one\n\n"), (b"http://b", b"20240102", b"text/plain", b"")]
    for version in (1, 2):
        got = list(read_arc(write_arc(version, b"x", records)))
        assert [(f[b"URL"], f[b"Archive-date"], f[b"Content-type"], body) for f, body in got] == records
    rows = [(1, "u", "p" * 200), (2, "u", "p" * 200), (2, None, "q" * 200), (2, "v", "q" * 200), (None, "w", "p" * 200), (None, "w", "p" * 200), (3, "u", "short"), (4, "u", "short"), (5, "u v", None), (6, "u", "q" * 200), (7, "é", "é" * 300_000)]
    back = convert_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(back) == len(rows) and len({r.record_id for r in back}) == len(rows)
    kinds = sorted((r.key or 0, r.record_type, r.refers_to or 0) for r in back)
    assert kinds == sorted([(1, "response", 0), (2, "revisit", 1), (2, "response", 0), (2, "response", 0), (0, "response", 0), (0, "response", 0), (3, "response", 0), (4, "response", 0), (5, "response", 0), (6, "revisit", 2), (7, "response", 0)])
    assert convert_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_are_read_record_by_record():
    from cellweave.llm.warc import read_warc, warc_record

    fields = {b"URL": b"u", b"IP-address": b"0", b"Archive-date": b"20240101000000", b"Content-type": b"t"}
    data = b"".join(warc_record(fields, b"b\r\n\r\n" * k, str(k), None) + b"\n" for k in range(4))
    got = list(read_warc(gzip.open(io.BytesIO(gzip.compress(data)))))
    assert [(h["X-Source-Key"], block) for h, block in got] == [(str(k), b"b\r\n\r\n" * k) for k in range(4)]


def test_chains_against_all_labellings():
    from cellweave.llm.language_crf import Lines

    rng = np.random.default_rng(4)
    text = b"a b c d\ne f\n\ng"
    lines = Lines(np.frombuffer(text, np.uint8), np.array([0, len(text)]), None)
    scores, moves = rng.normal(size=(len(lines.hash), 3)), rng.normal(size=(3, 3))
    got, pairs = lines.marginals(scores, moves)
    want, all_pairs = np.zeros_like(got), np.zeros((3, 3))
    for begin, size in zip(lines.begin.tolist(), lines.size.tolist(), strict=True):
        total, part, moved = 0.0, np.zeros((size, 3)), np.zeros((3, 3))
        for labels in itertools.product(range(3), repeat=size):
            weight = math.exp(sum(scores[lines.word[begin + i], y] for i, y in enumerate(labels)) + sum(moves[a, b] for a, b in itertools.pairwise(labels)))
            total += weight
            for i, y in enumerate(labels):
                part[i, y] += weight
            for a, b in itertools.pairwise(labels):
                moved[a, b] += weight
        want[begin : begin + size] = part / total
        all_pairs += moved / total
    assert np.allclose(got, want) and np.allclose(pairs, all_pairs)


def test_words_of_text_that_switches_language(spark):
    from cellweave.llm.language_crf import CHAIN, fit_language, label_words, predict_language

    rng = random.Random(9)
    ends = {"xx": ["ung", "heit", "lich"], "yy": ["acion", "idad", "oso"]}
    stems = {"xx": ["sch", "wie", "kra", "tau"], "yy": ["que", "llo", "nar", "vid"]}

    def words(lang, n):
        return [rng.choice(stems[lang]) + rng.choice(ends[lang]) for _ in range(n)]

    rows = [(i, " ".join(words(lang, 20)) + "\n" + " ".join(words(lang, 5)), lang) for i, lang in enumerate(["xx", "yy"] * 40)]
    field = fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    truth = ["xx"] * 6 + ["yy"] * 7 + ["xx"] * 5
    mixed = [w for lang, run in itertools.groupby(truth) for w in words(lang, len(list(run)))]
    docs = spark.createDataFrame([(1, " ".join(mixed)), (2, None), (3, ""), (4, "123 !"), (5, " ".join(words("yy", 3 * CHAIN)))], "doc_id long, text string")
    got = label_words(docs.where("doc_id = 1"), field).orderBy("nth").collect()
    assert [r.word for r in got] == mixed and sum(r.lang == t for r, t in zip(got, truth, strict=True)) >= 17
    assert all(" ".join(mixed).encode()[r.start : r.end].decode() == r.word for r in got)
    langs = {r.doc_id: (r.lang_pred, r.score) for r in predict_language(docs, field).collect()}
    assert langs[2] == langs[3] == langs[4] == ("und", 0.0) and langs[5][0] == "yy"
    assert abs(field.moves[0, 0] - field.moves[0, 1]) < 20 and label_words(docs.limit(0), field).count() == 0


def test_token_attribution_one_token_at_a_time(spark):
    from cellweave.llm.token_counts import VOCABULARY, encoder, read_ranks, section_tokens

    encoding, size = encoder(read_ranks(VOCABULARY))
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "\n", " ", "é", "\U0001f600", "word", "\n\n", "中文"]) for _ in range(rng.randrange(60))) for _ in range(60)] + [None, "", "\n", "x" * 50_000]
    rows = [(i, t, rng.choice([None, "", "title\nmore"])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, name string")
    for r in section_tokens(df, fields=("name", "text")).collect():
        parts = [p or "" for p in rows[r.doc_id][:0:-1]]
        x = "\n".join(parts)
        # each byte's character, and each character's section and field
        of_byte = [i for i, c in enumerate(x) for _ in c.encode()]
        section = np.cumsum([0] + [c == "\n" for c in x])[: len(x)]
        fields = [0] * (len(parts[0]) + 1) + [1] * len(parts[1])
        per, by_field, at = {}, [0, 0], 0
        for token in encoding.encode(x, disallowed_special=()):
            chars = sorted({of_byte[b] for b in range(at, at + size[token])})
            at += size[token]
            counts = {}
            for c in chars:
                counts[section[c]] = counts.get(section[c], 0) + 1
            best = min(counts, key=lambda s: (-counts[s], s))
            per[best] = per.get(best, 0) + 1
            by_field[fields[int(np.flatnonzero(section == best)[0])]] += 1
        n = len(set(section.tolist())) if x else 0
        assert r.section_tokens == [per.get(k, 0) for k in range(n)] and r.n_tokens == sum(per.values())
        assert r.field_tokens == by_field


def test_containment_by_index_and_by_joins(spark, monkeypatch):
    from cellweave.llm import decontaminate as d
    from test_jaccard_join import shingle_set

    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 20, 70, 130])))) for i in range(40)] + [(3, "w1 w2 w3"), (None, "w1"), (50, None), (51, "")]
    docs = [(10, None), (11, ""), (None, items[5][1]), (12, items[7][1])]
    for k in range(80):
        words = items[rng.randrange(40)][1].split()
        for _ in range(rng.choice([0, 0, 1, len(words) // 12, len(words) // 4])):
            words[rng.randrange(len(words))] = "q"
        pad = [rng.choice(vocabulary) for _ in range(rng.choice([0, 30, 400]))]
        docs.append((k % 70, " ".join([*pad, *words, *pad])))
    want = sorted(
        (a or -1, i, len(t), len(t & s)) for a, x in docs for i, y in items if i is not None
        for s, t in [(shingle_set(x, 5), shingle_set(y, 5))] if t and 100 * len(t & s) >= 80 * len(t)
    )
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    clean = sorted((a or -1, x or "") for a, x in docs if not any((t := shingle_set(y, 5)) and 100 * len(t & shingle_set(x, 5)) >= 80 * len(t) for i, y in items if i is not None))
    for small in (d.SMALL, 0):
        monkeypatch.setattr(d, "SMALL", small)
        got = sorted((r.doc_id or -1, r.item_id, r.n_item, r.n_shared) for r in d.contained_items(df, bench).collect())
        assert got == want
        assert sorted((r.doc_id or -1, r.text or "") for r in d.decontaminated(df.withColumn("key", d.F.lit(1)), bench).collect()) == clean


def test_battery_against_plain_formulas(spark):
    from cellweave.llm import secret_scan as s
    from pyspark.sql import functions as F

    rng = random.Random(7)
    tokens = ["".join(rng.choice(a) for _ in range(rng.randrange(20, 90))) for a in s.ALPHABETS.values() for _ in range(6)] + ["a" * 40, "abababababababababababab", "getHTTPResponseCodeFromServer", "AAAA" * 8 + "=="]

    def plain(token):
        body = token.rstrip("=")
        alphabet = next((a for a in s.ALPHABETS.values() if set(body) <= set(a)), s.ALPHABETS["base64"])
        x, n, k = [alphabet.index(c) + 1 for c in body], len(body), len(alphabet)
        chi = sum(body.count(c) ** 2 for c in set(body)) * k / n - n
        df, middle = k - 1, (k + 1) / 2
        z = max((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df)), -1e9) / math.sqrt(2 / (9 * df))
        runs = (sum((a > middle) != (b > middle) for a, b in itertools.pairwise(x)) - (n - 1) / 2) / math.sqrt((n - 1) / 4)
        serial = sum((a - middle) * (b - middle) for a, b in itertools.pairwise(x)) / (math.sqrt(n - 1) * (k * k - 1) / 12)
        q = max(z, 0) ** 2 + runs**2 + serial**2
        return -q / 2 + math.log1p(q / 2)

    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", s.log_p(F.col("t")).alias("p"))
    assert all(math.isclose(r.p, plain(r.t), rel_tol=1e-9, abs_tol=1e-9) for r in df.collect())


def test_random_tokens_are_found_and_text_is_left(spark):
    from cellweave.llm.secret_scan import redact_secrets, scan_secrets

    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(60)]
    plain = ["customer_address_validation_service_handler", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "----------------------------------------"]
    rows = [(i, f"see {k} end") for i, k in enumerate(keys)] + [(100 + i, f"see {plain[i % 3]} end") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _spans0", "2 AS _s")
    got = {r.doc_id: r.spans for r in scan_secrets(df).collect()}
    assert sum(got[i] == "random:4:44" for i in range(60)) >= 57 and all(got[100 + i] == "" for i in range(60))
    clean = redact_secrets(df).collect()
    assert all((r._s, r._spans0) == (2, 1) for r in clean) and sum("[SECRET]" in r.text for r in clean) >= 57


def test_forest_walk_against_one_tree_at_a_time():
    from cellweave.llm.quality import fit_forest

    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    forest = fit_forest(x, y)

    def walk(row):
        total = forest.base
        for root in forest.roots:
            at = root
            while forest.feature[at] >= 0:
                at = forest.left[at] + (row[forest.feature[at]] > forest.threshold[at])
            total += forest.value[at]
        return 1 / (1 + math.exp(-total))

    got = forest.score(x)
    assert np.allclose(got, [walk(r) for r in x]) and ((got > 0.5) == y).mean() > 0.9


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "w" * 200_000), (5, "a b c d e f g " * 9000), (5, "a b c d e f g " * 9000), (None, "one two three four five six"), (7, "\U0001f600 é\0x"), (8, "x\ny")]


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op6", "op7", "op8", "op9", "op10"])
def test_odd_rows_and_clashing_names(spark, name):
    from cellweave.llm import decontaminate, gif_media, language_crf, mixing, quality, secret_scan, suffix_dedup, token_counts

    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1 AS key", "2 AS size", "3 AS id", "4 AS n_bytes", "5 AS at", "6 AS weight", "7 AS spans", "8 AS of")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, None)], "item_id long, text string")
    run = {
        "op1": lambda d: suffix_dedup.suffix_dedup(d, keep=False), "op2": lambda d: gif_media.gif_digests(d, "doc_id", "text"), "op3": lambda d: quality.quality_scores(d, quality.fit_quality(d, labels)),
        "op6": lambda d: language_crf.predict_language(d, language_crf.fit_language(d)), "op7": token_counts.section_tokens, "op8": lambda d: decontaminate.decontaminated(d, items),
        "op9": secret_scan.scan_secrets, "op10": lambda d: mixing.mix(d, mixing.label_weights(labels)),
    }[name]
    got = run(docs).collect()
    gone = sum("a b c d e f g" in (t or "") for _, t in ODD) if name == "op8" else 0
    assert len(got) == len(ODD) - gone
    twice = [tuple(r) for r in got if r.doc_id == 5]
    assert len(twice) == (0 if gone else 2) and (name in ("op1", "op10") or len(set(map(str, twice))) <= 1)
    assert run(docs.limit(0)).count() == 0
    if name == "op2":
        for r in got:
            raw = {None: ODD[6][1]}.get(r.doc_id, dict(ODD).get(r.doc_id)) or ""
            padded = raw.encode() + bytes(-len(raw.encode()) % 64 or (0 if raw else 64))
            assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.payload_bytes == len(padded)


def test_shared_folder_is_never_local_to_a_machine_on_a_cluster():
    from types import SimpleNamespace as S

    from cellweave.llm.shared import shared_dir

    cluster = S(conf=S(get=lambda *_: None), sparkContext=S(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster, "x")


def test_labels_other_than_0_and_1_do_not_count(spark):
    from cellweave.llm.quality import fit_quality, quality_scores

    docs = spark.createDataFrame([(i, ("Fine words, in good order. " if i % 2 else "zz !! 99 ## ") * (i + 1)) for i in range(80)], "doc_id long, text string")
    plain = [(i, i % 2) for i in range(60)]
    labels = spark.createDataFrame([*plain, *((i, 5) for i in range(60, 80)), (3, None), (None, 1), (5, -1)], "doc_id long, quality int")
    want = fit_quality(docs, spark.createDataFrame(plain, "doc_id long, quality int"))
    rows = [{r.doc_id: r.score for r in quality_scores(docs, f).collect()} for f in (want, fit_quality(docs, labels))]
    assert rows[0] == rows[1] and all(0 <= x <= 1 for x in rows[0].values()) and (rows[0][61] >= 0.5) and (rows[0][60] < 0.5)
    none = quality_scores(docs, fit_quality(docs, labels.where("quality = 5"))).collect()
    assert {r.score for r in none} == {0.5}
