import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparrowql.llm import graph
from sparrowql.llm import simhash as S
from sparrowql.llm.graph import connected_components
from sparrowql.llm.shared import Workspace


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, ids):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprints():
    for text in [None, "", " \x0b", "One", "One two", "ÉA b\x1cc\x85 d\n\x0cE f g", "a b c " * 50, "w " * 70000]:
        assert S.fingerprint(text) == brute_fingerprint(text)


def points(rng, n):
    out = [rng.getrandbits(64) for _ in range(n)]
    for x in out[: n // 2]:
        y = x
        for _ in range(rng.randint(1, 5)):
            y ^= 1 << rng.randrange(64)
        out.append(y)
    base = rng.getrandbits(64)  # a dense group: a path and a ball
    for _ in range(300):
        out.append(base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    return list(dict.fromkeys(out))


def test_links_are_complete(spark, monkeypatch):
    rng = random.Random(4)
    fps = points(rng, 300)
    rows = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    want = brute_classes(fps, list(range(len(fps))))
    for most in (1000, 20):
        monkeypatch.setattr(S, "MAX_CELL", most)
        work = Workspace(spark, "test")
        edges = S.link_edges(spark.createDataFrame(rows, "fp long"), work)
        parts = {r.node: r.component for r in connected_components(edges, work).collect()}
        names = {}
        for (fp,), w in zip(rows, want, strict=True):
            assert names.setdefault(w, parts.get(fp, fp)) == parts.get(fp, fp)
        assert len(set(names.values())) == len(names)


def test_pivots_discard_most_pairs_before_verification():
    """Of the pairs of a cell few are left to be verified, and no link is among the others."""
    rng = random.Random(12)
    same = rng.getrandbits(16)  # what the cell's points share
    fps = np.array([same << 48 | rng.getrandbits(48) for _ in range(300)], np.uint64)
    fps = np.concatenate([fps, fps[:60] ^ np.uint64(5)])
    i, j = np.triu_indices(len(fps), 1)
    table = np.bitwise_count(fps ^ S.pivot_fingerprints()[:, None]).astype(np.int16)
    left = np.all([np.abs(column[i] - column[j]) <= S.RADIUS for column in table], axis=0)
    linked = np.bitwise_count(fps[i] ^ fps[j]) <= S.RADIUS
    assert left.sum() < 0.01 * len(i) and not (linked & ~left).any() and linked.sum() >= 60
    got = S.linked_pairs(fps, table, i, j)
    assert (got[0] == i[linked]).all() and (got[1] == j[linked]).all()


def test_components_of_a_long_path(spark, monkeypatch):
    edges = spark.range(120).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.union(edges.select("b", "a")).union(spark.range(200, 202).select("id", "id"))
    for few in (1000, 0):
        monkeypatch.setattr(graph, "FEW_EDGES", few)
        got = connected_components(edges, Workspace(spark, "test")).collect()
        assert sorted(r.node for r in got) == list(range(121)) and {r.component for r in got} == {0}
        assert connected_components(edges.limit(0), Workspace(spark, "test")).count() == 0


def test_documents(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(120)) for _ in range(60)]
    texts += [t + " end" for t in texts[:20]] + texts[5:10] + [None, "", "  "] + ["hot copy of a text"] * 40
    ids = [i if i % 11 else None for i in range(1, len(texts) + 1)]
    docs = spark.createDataFrame([(i, t, None, 1, 2) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, _fp string, class int, _keep int")
    got = sorted((r.doc_id or -1, r._fp, r._component) for r in S.simhash_components(docs).collect())
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_classes(fps, ids)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    assert got == sorted((i or -1, f, c) for i, f, c in zip(ids, signed, want, strict=True))
    kept = S.near_dedup(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == sorted({c for c in want if c})
    assert kept[0].asDict().keys() == {"doc_id", "text", "_fp", "class", "_keep"}
    assert S.near_dedup(docs.union(docs)).count() == len(kept)
    alone = S.near_dedup(docs.where("doc_id is null")).collect()
    nameless = [f for f, i in zip(fps, ids, strict=True) if i is None]
    assert len(alone) == len(set(brute_classes(nameless, range(len(nameless)))))
    assert S.simhash_components(docs.limit(0)).count() == 0
