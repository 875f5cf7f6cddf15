import random

import numpy as np

from sparrowql.llm import decontamination as D
from sparrowql.llm.passages import align, fit_distances, words


def fit(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_banded_distances_and_alignment_equal_plain_dp():
    rng = random.Random(1)
    for _ in range(300):
        n, band = rng.randint(1, 12), rng.randint(0, 5)
        items = np.array([[rng.randrange(4) for _ in range(n)] for _ in range(5)])
        parts = np.array([[rng.randrange(4) for _ in range(n + 2 * band)] for _ in range(5)])
        for a, b, far in zip(items, parts, fit_distances(items, parts), strict=True):
            want = fit(a.tolist(), b.tolist())
            distance, matched, start, end = align(a, b, 0, 2 * band)
            assert want <= far == distance and 0 <= start <= end <= len(b)
            assert len(matched) <= n and all(x < y for x, y in zip(matched, matched[1:])) and all(start <= x < end for x in matched)
            assert fit(a.tolist(), b[start:end].tolist()) <= distance
        # a copy with edits whose number the band covers
        whole = [rng.randrange(50) for _ in range(30)]
        k = rng.randint(0, 5)
        text = np.array([99] * 7 + edited(rng, whole, k) + [98] * 40)
        distance, _, start, end = align(np.array(whole), text, 2, 12)
        assert distance <= k


def edited(rng, item, k):
    out = list(item)
    new = lambda: f"new{rng.randrange(999)}" if isinstance(item[0], str) else 1000 + rng.randrange(999)
    for _ in range(k):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = new()
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, new())
    return out


def corpus(rng, n_items=40, n_docs=400):
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    draw = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [draw(rng.randint(12, 60)) for _ in range(n_items)]
    docs = []
    for i in range(n_docs):
        body = draw(rng.randint(0, 150))
        if i % 3 == 0:
            item = rng.choice(items)
            at = rng.randint(0, len(body))
            body = body[:at] + edited(rng, item, rng.randint(0, D.edit_bound(len(item)) + 2)) + body[at:]
        docs.append(" ".join(body).title())
    return [" ".join(x) + "." for x in items], docs


def test_recall_against_brute_force():
    rng = random.Random(2)
    items, docs = corpus(rng)
    found = D.Items(list(enumerate(items))).find(docs)
    want = set()
    for d, doc in enumerate(docs):
        tokens = words(doc)
        for p, item in enumerate(items):
            target = words(item)
            if fit(target, tokens) <= D.edit_bound(len(target)):
                want.add((d, p))
    got = {(d, p) for d, x in found.items() for p in x}
    assert len(want) > 80 and len(got & want) >= 0.97 * len(want)
    assert got <= want


def test_long_items_take_the_band_alone():
    """An item of 4,000 words with a tenth of them changed is found within seconds, and not with a quarter changed."""
    rng = random.Random(6)
    item = [f"w{rng.randrange(3000)}" for _ in range(4000)]
    found = D.Items([(1, " ".join(item))])
    for share, hits in ((0.1, 1), (0.25, 0)):
        tokens = list(item)
        for k in rng.sample(range(len(tokens)), int(share * len(tokens))):
            tokens[k] = "changed"
        assert len(found.find(["before it " + " ".join(tokens) + " after it"])) == hits


def test_frames(spark):
    rng = random.Random(3)
    items, _ = corpus(rng, 10, 1)
    filler = " ".join(f"other{i}" for i in range(50))
    docs = spark.createDataFrame(
        [(1, f"{filler} {items[3]} {filler}", "a"), (2, filler, "b"), (None, items[4].upper(), "c"), (4, None, "d"), (5, "", "e"), (1, f"{filler} {items[3]} {filler}", "a"), (6, f"İ {filler * 400} {items[5]}", "f")],
        "doc_id long, text string, item_id string",
    )
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, " ."), (None, items[4])], "item_id int, text string")
    for sizes in ({}, {"block_bytes": 500}, {"block_bytes": 500, "scan_bytes": 1000}):
        rows = D.contaminated(docs, bench, **sizes).collect()
        assert sorted((r.doc_id or 0, r.item_id if r.item_id is not None else -1) for r in rows) == [(0, -1), (0, 4), (1, 3), (1, 3), (6, 5)]
        hit = next(r for r in rows if r.doc_id == 1)
        assert f"{filler} {items[3]}"[hit.start : hit.end] == items[3].rstrip(".") and hit.edits == 0
        left = D.clean(docs, bench, **sizes)
        assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5] and left.columns == docs.columns
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.clean(docs, bench.limit(0)).count() == 7
    assert D.contaminated(docs.limit(0), bench).count() == 0
