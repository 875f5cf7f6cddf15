import random

from sparrowql.llm import licenses as L
from sparrowql.llm.passages import gram_hashes, words


def fit(item, text):
    """Least word edits of item to a piece of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_winnowing_keeps_the_least_of_each_window():
    import numpy as np

    hashes = gram_hashes(np.arange(1, 60), 3)
    kept = L.winnow(hashes, 4)
    assert all(any(k in range(i, i + 4) and hashes[k] == hashes[i : i + 4].min() for k in kept) for i in range(len(hashes) - 3))


def test_templates_are_found_with_edits_and_spans():
    rng = random.Random(1)
    known = L.Templates(L.TEMPLATES)
    filler = " ".join(f"other{i}" for i in range(30))
    for name, text in L.TEMPLATES.items():
        doc = f"{filler}\n{text}\n{filler} İ"
        hits = {h[0]: h for h in known.find(doc)}
        assert hits[name][1] == 1.0 and words(doc[hits[name][2] : hits[name][3]]) == words(text)
        tokens = words(text)
        if len(tokens) > 30:
            for _ in range(len(tokens) // 12):
                tokens[rng.randrange(len(tokens))] = "changed"
            hits = {h[0]: h for h in known.find(f"{filler} {' '.join(tokens)} {filler}")}
            assert hits[name][1] >= 0.8
    assert known.find(filler) == [] and known.find("") == []


def edited(rng, item, k):
    out = list(item)
    for _ in range(k):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice([rng.choice(item), "other"])
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, rng.choice([rng.choice(item), "other"]))
    return out


def test_nothing_within_a_fifth_of_edits_is_missed():
    """Every template, with edits up to the bound at random, against the plain table."""
    known, rng = L.Templates(L.TEMPLATES), random.Random(3)
    for name, text in L.TEMPLATES.items():
        item = words(text)
        for _ in range(30 if len(item) < 60 else 3 if len(item) < 700 else 1):
            k = rng.randint(0, L.edits(len(item)) + 1)
            part = edited(rng, item, k)
            hits = {h[0]: h for h in known.find("some words " + " ".join(part) + " and more")}
            within = k <= L.edits(len(item)) if len(item) > 700 else fit(item, part) <= L.edits(len(item))
            assert not within or name in hits, (name, k)
            assert name not in hits or hits[name][1] >= 0.8
    for name in ("MIT/grant", "Apache-2.0/grant", "CC-BY-NC-4.0/grant"):  # one word changed, at each place
        item = words(L.TEMPLATES[name])
        for at in range(len(item)):
            assert (name in {h[0] for h in known.find(" ".join([*item[:at], "changed", *item[at + 1 :]]))}) == (len(item) >= 5)


def test_small_alphabets_equal_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.choice("abcde") for _ in range(rng.randint(1, 14))]
        text = [rng.choice("abcdefg") for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.7:
            at = rng.randint(0, len(text))
            text[at:at] = edited(rng, item, rng.randint(0, L.edits(len(item)) + 1))
        hits = L.Templates({"x": " ".join(item)}).find(" ".join(text))
        assert hits or fit(item, text) > L.edits(len(item))
        assert all(a[3] <= b[2] for a, b in zip(hits, hits[1:])) and all(h[1] >= 0.8 for h in hits)


def test_all_places():
    item = words("alpha beta gamma delta epsilon zeta eta theta iota kappa")
    known = L.Templates({"x": " ".join(item)})
    assert [(h[1], h[2]) for h in known.find(" ".join(item * 3))] == [(1.0, 0), (1.0, 57), (1.0, 114)]
    assert len(known.find(" ".join([*item, "and", *item[:4], "not", *item[5:]] * 2))) == 4


def test_frames(spark):
    text = L.TEMPLATES["MIT/grant"]
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, "a " * 5000 + text, "y"), (3, None, "z"), (4, "", "z")], "doc_id long, text string, license string")
    rows = L.license_scan(docs).collect()
    assert sorted((r.doc_id or 0, r.license) for r in rows) == [(0, "MIT/grant"), (1, "MIT/grant"), (1, "MIT/grant")]
    assert L.license_scan(docs.limit(0)).count() == 0
