import itertools
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from sparrowql.llm import language as L

SYLLABLES = {"en": ["the", "th", "ing", "ou", "ly"], "de": ["sch", "ein", "keit", "ü", "zu"], "fr": ["é", "eau", "ou", "ment", "qu"]}


def body(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    for steps in (1, 2, 5):
        e, moves = rng.random((steps, 1, 3)) + 0.1, rng.random((3, 3)) + 0.1
        total, nodes, pairs = 0.0, np.zeros((steps, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=steps):
            p = np.prod([e[t, 0, y] for t, y in enumerate(path)]) * np.prod([moves[a, b] for a, b in itertools.pairwise(path)])
            total += p
            for t, y in enumerate(path):
                nodes[t, y] += p
            for a, b in itertools.pairwise(path):
                pairs[a, b] += p
        got, got_pairs = L.forward_backward(e.copy(), moves, np.ones(steps, int))
        assert np.allclose(got[:, 0], nodes / total) and np.allclose(got_pairs, pairs / total)
        assert np.allclose(L.marginals(e.copy(), moves, np.ones(steps, int))[:, 0], nodes / total)


def test_chains_of_different_lengths_do_not_mix():
    rng = random.Random(2)
    model = L.fit([(k, body(rng, k, 40)) for k in SYLLABLES for _ in range(60)])
    texts = [body(rng, rng.choice(list(SYLLABLES)), rng.randint(1, 60)) for _ in range(50)]
    together = model.predict(texts)
    for text, lang, score in zip(texts, *together, strict=True):
        alone = model.predict([text])
        assert alone[0] == [lang] and abs(alone[1][0] - score) < 1e-4


def test_code_switched_words():
    rng = random.Random(3)
    model = L.fit([(k, body(rng, k, 40)) for k in SYLLABLES for _ in range(100)])
    gold, words = [], []
    for k in ("en", "de", "fr", "en"):
        part = body(rng, k, 15).split()
        words += part
        gold += [k] * len(part)
    ((_, _, m),) = model.word_labels(model._rows([words]))
    right = sum(model.labels[int(p.argmax())] == k for p, k in zip(m[:, 0], gold, strict=True))
    assert right >= 0.95 * len(gold)


def test_long_chains_go_in_blocks(monkeypatch):
    rng = random.Random(5)
    model = L.fit([(k, body(rng, k, 40)) for k in SYLLABLES for _ in range(60)])
    texts = [body(rng, "en", 500) + " " + body(rng, "fr", 300), body(rng, "de", 3), body(rng, "de", 40)]
    want = {i: m / m.sum() for i, m in model.masses([L.letters(t) for t in texts])}
    for cells in (3 * 700, 200, 3):
        monkeypatch.setattr(L, "CELLS", cells)
        got = {i: m / m.sum() for i, m in model.masses([L.letters(t) for t in texts])}
        assert all(np.allclose(got[i], want[i], atol=1e-4) for i in range(3))


def test_whole_runs_count():
    assert L.letters("a" * 70 + "Bc") == ["a" * 32, "a" * 32, "a" * 6 + "bc"]
    rng = random.Random(6)
    model = L.fit([(k, body(rng, k, 40)) for k in ("de", "fr") for _ in range(60)])
    glued = body(rng, "de", 12).replace(" ", "")[:45] + body(rng, "fr", 400).replace(" ", "")
    assert model.predict([glued])[0] == ["fr"]


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(L, "WEIGHTS", 1 << 18)
    names = [f"l{k}" for k in range(420)]
    rows = [(i, f"{chr(0x4E00 + i % 420) * 3} " * 9, names[i % 420]) for i in range(420 * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = L.training_pieces(docs.union(docs), "doc_id", "text", "lang")
    assert {k for k, _ in pieces} == set(names) and len(pieces) == len(set(pieces))
    model = L.fit(pieces)
    assert model.labels == sorted(names) and len(model.weights) == 1024
    assert model.predict([f"{chr(0x4E00 + 417) * 3} " * 9])[0] == ["l417"]


def test_frames_and_held_out_accuracy(spark):
    rng = random.Random(4)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(600)]
    rows = [(i, body(rng, k, rng.randint(5, 80)), k, 1) for i, k in enumerate(langs)]
    extra = [(None, "the thing", None, 1), (700, None, "en", 1), (701, "12 ² --", "en", 1), (702, "", None, 1), rows[0], (703, "thing " * 9000, None, 1)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score int").selectExpr("*", "1 AS id", "2 AS held", "3 AS share", "4 AS place")
    got = L.language_id(docs).collect()
    assert len(got) == 606 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 80 and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[i] for i in (None, 700, 701, 702, 703)] == ["en", "und", "und", "und", "en"]
    nothing = L.language_id(docs.withColumn("lang", docs.lang.substr(9, 1)).where("doc_id = 700"))
    assert [r.lang_pred for r in nothing.collect()] == ["und"]
    assert L.language_id(docs.limit(0)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="needs the driver's tables")
def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in L.language_id(docs).collect() if r.held_out and r.lang_pred != L.UNKNOWN and truth[r.doc_id]]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held)
    print(f"{right:.3f} of {len(held)}")
    assert len(held) > 150 and right >= 0.95
