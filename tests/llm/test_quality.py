import math
import re
from collections import Counter

from pyspark.sql import functions as F

from sparrowql.llm import quality as Q

TEXTS = [
    None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c a b", "x " * 80, "one\n\none\n two\r\none\r\n", "É#&|< ok\x0bé\x0c€ $%",
    " ".join(f"w{i % 37}" for i in range(300)), "the cat sat the cat sat on the cat", "long" * 5000,
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    at = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(at), n < 50 or 100 * len(at) > 50 * n)


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in Q.COUNTS) for r in Q.quality_counts(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_binomial_tail_is_exact(spark):
    rows = [(k, n) for n in (1, 10, 400, 3000) for k in (0, 1, 3, 7)]
    df = spark.createDataFrame(rows, "k long, n long")
    for r in df.select("k", "n", Q.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        want = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)) if r.k <= r.n * 0.01 else 1.0
        assert math.isclose(r.p, want, rel_tol=1e-9)


def body(i, junk):
    return " ".join(f"word{i}x{k}" + ("***" if junk else "") for k in range(60))


def test_cutoffs_spare_good_rows_and_cases_hold(spark):
    rows = [(i, body(i, i % 10 == 0), "en" if i % 3 else None, "s") for i in range(3000)]
    docs = spark.createDataFrame([*rows, (None, None, None, None), rows[0]], "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(3000)] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = Q.quality_rules(docs, labels, alpha=0.05)
    rows = out.collect()
    assert len(rows) == 3002 and "_kept" in out.columns
    assert all(r["_kept"] == (r["doc_id"] is not None and r["doc_id"] % 10 > 0) for r in rows)
    # without labels only the base rules hold
    assert Q.quality_rules(docs, labels.limit(0)).where("_kept").count() == 3001
    assert Q.quality_rules(docs.limit(0), labels).count() == 0
    assert Q.stage(spark, docs, labels).columns == docs.columns


def test_every_label_counts(spark):
    # a language of few labels passes only if none is left out, however many labels there are
    rows = [(i, body(i, i % 10 == 0), "en") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = [(i, int(i % 10 > 0)) for i in range(2400)]
    labels = spark.createDataFrame(few, "doc_id long, quality int").union(spark.range(10_000, 90_000).selectExpr("id", "1"))
    bad = Q.quality_rules(docs, labels).where("not kept")
    assert {r.doc_id for r in bad.collect()} == set(range(0, 2400, 10))


def test_null_and_empty_strata_are_two_and_small_ones_are_pooled(spark):
    kinds = [None, "", "de", "fr"]
    rows = [(i, body(i, i % 10 == 0), kinds[min(i % 8, 3)]) for i in range(4000)]  # 500 rows of each of the first three, 2,500 of the last
    docs = spark.createDataFrame([*rows, (9000, body(9000, True), "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(4000)], "doc_id long, quality int")
    work = Q.Workspace(spark, "test")
    measured = Q.quality_counts(docs.selectExpr("doc_id AS _id", "lang AS _stratum", "text AS _body"), "_body").drop("_body")
    alpha = 0.03  # a stratum of its own needs 1,236 good labels; the three small ones have 1,350 together
    got = {r.stratum: r.cutoffs for r in Q.calibrate(measured, labels, work, alpha=alpha).collect()}
    assert got.keys() == set(kinds) and got[None] == got[""] == got["de"] and "symbols" in got["fr"]
    left_out = {r.doc_id for r in Q.quality_rules(docs, labels, alpha=alpha).where("not kept").collect()}
    assert left_out == set(range(0, 4000, 10))  # the document of a stratum without labels is kept
    few = labels.where("doc_id % 8 <> 2")
    assert {r.stratum for r in Q.calibrate(measured, few, Q.Workspace(spark, "test"), alpha=alpha).collect()} == {"fr"}
    apart = Q.calibrate(measured.where("_stratum IS NULL OR _stratum = ''"), labels, Q.Workspace(spark, "test"), alpha=0.1)
    assert {r.stratum for r in apart.collect()} == {None}  # the empty one holds no bad row, and isn't the null one
