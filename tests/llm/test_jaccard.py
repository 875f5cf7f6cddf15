import random
import re

import numpy as np

import corpus_pipeline
from sparrowql.llm import jaccard as J
from sparrowql.llm import simhash


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(texts):
    """A name of each text's class, by the similarity of all pairs."""
    sets, root = [brute_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def near_copies(rng):
    draw = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(n)]
    texts = []
    for _ in range(40):
        base = draw(rng.randint(20, 400))
        texts.append(base)
        for share in (0.01, 0.02, 0.03, 0.05, 0.1):
            copy = list(base)
            for k in rng.sample(range(len(base)), max(1, int(share * len(base)))):
                copy[k] = "other" + str(rng.randrange(99))
            texts.append(copy)
    chain = draw(60)
    texts += [[*chain[k:], *[f"n{i}" for i in range(k)]] for k in range(0, 60, 3)]
    texts += [draw(3), draw(5), ["shared"] * 9]
    out = [" ".join(t) for t in texts]
    return [*out, out[0].upper(), out[7].replace(" ", "\n"), None, "", " \t"]


def test_stage_equals_brute_force(spark):
    texts = near_copies(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    want = brute_classes(texts)
    assert 40 < len(set(want)) < len(texts) - 60
    assert kept == {want.index(c) for c in set(want)}


def test_cells_join_families_and_cross_batches(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    texts = [" ".join([*base[:k], f"v{k}", *base[k + 1 :]]) for k in range(250)] + [" ".join(base[k:] + base[:k]) for k in range(1, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        kept = sorted(r.doc_id for r in J.near_dedup(docs).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_classes(texts)
    assert kept == sorted(want.index(c) for c in set(want))


def test_blocks_lose_no_link(spark, monkeypatch):
    """Small cells and blocks, so that families go through many of them, and no stars that join them before."""
    texts = near_copies(random.Random(6))[:140] + near_copies(random.Random(7))[-30:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, value in {"CELL": 3, "BLOCK_POINTS": 2, "PAIRS": 5, "COLUMNS": 64, "WANTED": 0}.items():
        monkeypatch.setattr(J, name, value)
    monkeypatch.setattr(J, "_verified", lambda pairs, *rest: pairs.limit(0))
    want = brute_classes(texts)
    assert sorted(r.doc_id for r in J.near_dedup(docs).collect()) == sorted(want.index(c) for c in set(want))


def test_long_fingerprints_keep_linked_pairs():
    """Of pairs at a similarity just over 0.8 all stay within the radius, and half-similar ones mostly don't."""
    rng = random.Random(9)
    far = {0.8: [], 0.45: []}
    for similarity, found in far.items():
        for _ in range(300):
            n = rng.randint(J.SURE, 900)
            same = int(n * 2 * similarity / (1 + similarity)) + 1
            a, b = (J.shingles(" ".join(f"{side if k >= same else ''}{k}v{n}" for k in range(n))) for side in "xy")
            a, b = a[rng.randrange(2) :], b
            found.append(sum(int(x).bit_count() for x in J.long_fingerprint(a) ^ J.long_fingerprint(b)))
    assert max(far[0.8]) <= J.RADIUS - 8 and sum(x > J.RADIUS for x in far[0.45]) > 100


def test_pivots_discard_pairs_of_a_cell():
    """Points of two families that share a cell: the table leaves hardly a pair across them, and every near pair."""
    rng = random.Random(10)
    sets = []
    for side in "xy":
        base = [f"{side}{k}" for k in range(300)]
        for k in range(40):
            copy = list(base)
            for at in rng.sample(range(300), 6):
                copy[at] = f"new{rng.randrange(10**6)}"
            sets.append(J.shingles(" ".join(copy)))
    long = np.stack([J.long_fingerprint(s) for s in sets])
    sizes, order = np.array([len(s) for s in sets]), np.argsort([len(s) for s in sets], kind="stable")
    family = np.repeat([0, 1], 40)[order]
    i, j = J.near_rows(np.zeros(80, np.int64), np.arange(80), sizes[order], long[order])
    assert len(i) == 78 and (family[i] == family[j]).all()  # a tree of each family
    table = np.stack([J.distances(long[order], slice(None), r) for r in np.linspace(0, 79, J.REFERENCES).astype(int)])
    a, b = np.triu_indices(80, 1)
    left = (np.abs(table[:, a] - table[:, b]) <= J.RADIUS).all(axis=0)
    assert left[family[a] != family[b]].mean() < 0.1 and left[family[a] == family[b]].all()


def test_cases(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "One  two"), (3, None), (2, ""), (5, "x y z")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, (r.text or "").lower().split()) for r in J.near_dedup(docs).collect()) == [(0, ["one", "two"]), (2, []), (5, ["x", "y", "z"])]
    assert J.near_dedup(docs.limit(0)).count() == 0


def test_repeated_ids_of_different_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (1, b), (3, a), (3, c), (4, c), (None, b), (None, "alone")], "doc_id long, text string")
    want = [(0, "alone"), (1, a), (1, b), (3, c)]
    for dedup in (J.near_dedup, simhash.near_dedup):
        assert sorted((r.doc_id or 0, r.text) for r in dedup(docs).collect()) == want
