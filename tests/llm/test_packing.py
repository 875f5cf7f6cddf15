import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparrowql.llm.packing import Tree, gapless, pack, pack_into, shard


def plain_bfd(items, capacity):
    bins = []
    for size in sorted(items, reverse=True):
        fit = [i for i, room in enumerate(bins) if room >= size]
        if not fit:
            bins.append(capacity)
            fit = [len(bins) - 1]
        best = min(fit, key=lambda i: (bins[i], i))
        bins[best] -= size
    return bins


def test_runs_equal_plain_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(60):
        items = [rng.choice([1, 2, 3, 7, 20, 21, 33, 50]) for _ in range(rng.randint(1, 200))]
        capacity = rng.randint(50, 120)
        runs = pack(list(Counter(items).items()), capacity)
        room = defaultdict(lambda: capacity)
        for size, _, count, bin_ in runs:
            room[bin_] -= size * count
        assert sorted(room.values()) == sorted(plain_bfd(items, capacity))
        for size, want in Counter(items).items():
            mine = sorted((a, a + c) for s, a, c, _ in runs if s == size)
            assert mine[0][0] == 0 and mine[-1][1] == want and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))


def test_tree_takes_the_tightest():
    rng = random.Random(2)
    tree, keys = Tree(), []
    for i in range(500):
        keys.append((rng.randint(0, 90), i))
        tree.add(keys[-1])
    for _ in range(500):
        room = rng.randint(0, 90)
        want = min((k for k in keys if k[0] >= room), default=None)
        assert tree.take(room) == want
        if want:
            keys.remove(want)


def test_least_capacity():
    runs = pack_into([(10, 8), (1, 16)], 8)
    room = Counter()
    for size, _, count, b in runs:
        room[b] += size * count
    assert sorted(room.values()) == [12] * 8


def test_shards(spark):
    rng = random.Random(3)
    texts = [("é" if i % 2 else "x") * rng.randint(0, 300) for i in range(2000)] + ["hot copy " * 9] * 400 + [None, "", "y" * 40000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, size string")
    rows = shard(docs).collect()
    assert len(rows) == len(texts)
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[texts[r.doc_id] or ""].add(r.shard)
    assert set(load) == set(range(8)) and max(load.values()) < 1.02 * min(load.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(s) == 1 for s in where.values())  # the hot group fits into a shard
    assert shard(docs.limit(0)).count() == 0


def test_only_groups_over_a_shard_are_split(spark):
    """Groups of 0.3, 0.7 (two of them) and 1.4 of a shard, one of them under one id, amid small ones."""
    share, rng = 100_000, random.Random(5)
    groups = {"c" * 99: 0.3, "g" * 499: 0.7, "h" * 499: 0.7, "o" * 199: 1.4}
    texts = [t for t, part in groups.items() for _ in range(int(part * share / (len(t) + 1)))]
    texts += [f"{k}".ljust(rng.randint(20, 400), "s") for k in range(5000)]
    total = 0
    for n, t in enumerate(texts):
        total += len(t) + 1
        if total >= 8 * share:
            break
    texts = texts[: n + 1]
    ids = [7 if t.startswith("o") else k for k, t in enumerate(texts)]
    rows = shard(spark.createDataFrame([(i, t) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string")).collect()
    of, load, crc = defaultdict(set), Counter(), {zlib.crc32(t.encode()): t for t in texts}
    for r in rows:
        of[crc[r.text_crc32]].add(r.shard)
        load[r.shard] += r["size"]
    assert {t[0]: len(s) for t, s in of.items() if t in groups and len(s) > 1}.keys() == {"o"}
    assert all(len(s) == 1 for t, s in of.items() if t[0] != "o")
    assert len(rows) == len(texts) and max(load.values()) < 1.01 * min(load.values())


def test_repeated_rows_and_gapless(spark):
    docs = spark.createDataFrame([(1, "a")] * 5 + [(None, None)] * 3, "doc_id long, text string")
    rows = shard(docs).collect()
    assert len(rows) == 8
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("k"))
    got = gapless(df, ["k"], [F.col("id")], F.col("id"), 1000, "n").collect()
    assert all(sorted(r.n for r in got if r.k == k) == list(range(len([r for r in got if r.k == k]))) for k in range(3))
