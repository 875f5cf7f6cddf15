import hashlib
import random

import numpy as np
import pytest

from sparrowql.llm import substrings as S


def test_the_cover_covers():
    assert {(a - b) % S.MODULUS for a in S.COVER for b in S.COVER} == set(range(S.MODULUS))
    for i in range(S.MODULUS):
        for j in range(S.MODULUS):
            assert any((i + d) % S.MODULUS in S.COVER and (j + d) % S.MODULUS in S.COVER for d in range(S.MODULUS))


def test_packing():
    rng = np.random.default_rng(1)
    for bits in (8, 36, 64):
        for n in (0, 1, 5, 3000):
            names = np.unique(rng.integers(0, 2**bits, n, dtype=np.uint64, endpoint=False)) if n else np.zeros(0, np.uint64)
            assert (S.unpacked(S.packed(names)) == names).all()


def brute(rows, length=50):
    """n_bytes, n_removed, n_spans and digest of each row (id, text)."""
    least = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - length + 1) if i is not None else ():
            w = data[k : k + length]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1) if i is not None else ():
            if least[data[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        n_spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i if i is not None else -1, len(data), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(rng, n):
    draw = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    shared = [draw(rng.randint(40, 130)) for _ in range(12)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(shared) if rng.random() < 0.4 else draw(rng.randint(0, 80)) for _ in range(rng.randint(0, 7)))
        rows.append((rng.randrange(n), text) if i % 5 == 0 else (i, text))
    rows += [(n + k, rows[k][1]) for k in range(0, 40, 3)]
    rows += [(5 * n, "ab" * 400), (5 * n + 1, "ab" * 300), (4, None), (6, ""), (None, rows[0][1]), (None, None), (7, "x" * 49), (8, "x" * 49), (2, "y" * 50), (9, "y" * 50)]
    rows += [(9 * n + k, "hot copy, longer than fifty bytes, of which there are many rows") for k in range(60)] + [rows[3]] * 4
    rng.shuffle(rows)
    return rows


def test_front_coding():
    rng = np.random.default_rng(2)
    for n in (1, 2, 500):
        rows = np.unique(rng.integers(97, 100, (n, 13), dtype=np.uint8), axis=0)
        assert (S.front_decoded(S.front_coded(rows)) == rows).all()


def test_ranks_follow_the_bytes():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (400, 3), dtype=np.uint8) // 90
    order, rank = S.ranked(rows)
    assert [bytes(rows[k]) for k in order] == sorted(bytes(r) for r in rows)
    names = sorted({bytes(r) for r in rows})
    assert [names.index(bytes(r)) for r in rows] == rank.tolist()


def results(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = S.remove_repeats(docs).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("chunks_")]
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


@pytest.mark.parametrize(
    "sizes",
    [
        {},
        {"CHUNK_BYTES": 700, "RANGE_BYTES": 900, "TUPLE_RANGE_BYTES": 600},  # many chunks and ranges, documents over a chunk, ids over several
        {"CHUNK_BYTES": 1500, "RANGE_BYTES": 900, "TUPLE_RANGE_BYTES": 600, "HASH_BITS": 2, "SPLITTERS": 3},  # all hashes collide: bytes decide
        {"CHUNK_BYTES": 1500, "RANGE_BYTES": 2000, "TUPLE_RANGE_BYTES": 2000, "HOT": 2},  # most tuples are hot
        {"CHUNK_BYTES": 900, "HOT": 0},
    ],
)
def test_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(S, name, value)
    rows = corpus(random.Random(str(sizes)), 150)
    assert results(spark, rows) == brute(rows)


def test_one_id_and_one_line_hold_a_third_of_all(spark, monkeypatch):
    """The rows of the hot id go over many chunks and don't mark each other; the line stands amid different bytes."""
    monkeypatch.setattr(S, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(S, "HOT", 5)
    rng = random.Random(9)
    draw = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    line, passage = "Released under a license that everybody puts at the end.", draw(70)
    rows = [(i, draw(40) + (line if i % 3 else passage) + draw(30)) for i in range(150)]
    rows += [(77, draw(60) + passage + draw(rng.randint(0, 40))) for _ in range(90)]
    assert results(spark, rows) == brute(rows)


def test_kept_bytes_and_empty_table(spark):
    text = "a passage that is longer than fifty bytes, repeated in two documents"
    docs = spark.createDataFrame([(1, f"one {text}"), (2, f"{text} two")], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), r.spans) for r in S.remove_repeats(docs, with_text=True).collect()}
    assert got == {1: (f"one {text}".encode(), ""), 2: (b" two", f"0:{len(text)}")}
    assert S.remove_repeats(docs.limit(0)).count() == 0
