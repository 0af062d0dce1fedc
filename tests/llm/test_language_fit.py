"""A fit is a task's work, with bounded memory."""

import tracemalloc

import numpy as np

from cellweave.llm import language_crf as L

WORDS = {"en": ["the", "house", "green", "of", "which"], "de": ["das", "haus", "grün", "von", "welches"]}


def lines(lang, k):
    return " ".join(WORDS[lang][(k * 7 + i * i) % 5] for i in range(40))


def test_the_driver_does_not_fit(spark, monkeypatch):
    def fit_here(*_):
        raise AssertionError("the driver got the sample")

    rows = [(k, lines(lang, k), lang) for k, lang in enumerate(["en", "de"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(L, "fit_field", fit_here)
    field = L.fit_language(docs)
    assert field.labels == ["de", "en"]
    assert {r.doc_id: r.lang_pred for r in L.predict_language(docs, field).collect()} == {k: lang for k, _, lang in rows}


def test_a_fit_steps_through_few_chains_at_once(monkeypatch):
    texts = [(lines(lang, k) + "\n").encode() * 20 for k in range(20) for lang in WORDS]
    off = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    chains = L.Lines(np.frombuffer(b"".join(texts), np.uint8), off, None)
    chains.mixed()
    scores, moves = np.random.default_rng(1).random((len(chains.hash), 2)), np.eye(2)
    monkeypatch.setattr(L, "STEPPED", 2000)
    peaks = []
    for solve in (chains.marginals, chains.expected):
        tracemalloc.start()
        got = solve(scores, moves)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        if solve == chains.marginals:
            p, pairs = got
    assert np.allclose(got[0], np.stack([np.bincount(chains.word, p[:, c], len(chains.hash)) for c in (0, 1)], 1))
    assert np.allclose(got[1], pairs)
    assert 4 * peaks[1] < peaks[0]
