from pathlib import Path

import pytest

from sparrowql.llm import urls as U


def brute(url, listed):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in U.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    rule = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    plain = host.removeprefix("www.")
    found = any(plain == x or plain.endswith("." + x) for x in listed)
    return host, path, rule and rule[0] + rule[1], rule[2] if rule else "block" if found else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://a.NET/es/1", "http://x.example.com/en/9", "http://www.example.com/en/", "http://Example.com/en?x", "http://example.com",
    "http://spam-farm.example.org/en/2", "https://m.spam-farm.example.org/q?z#y", "http://www.cheap-pills.example.net/de/1", "http://notspam-farm.example.org/", "ftp://net/fr/",
    "http://a.b?c://d/e", "http://É.net/es/\nx", "x" * 50000 + "://a.com/" + "y" * 50000,
]


def test_equals_brute_force(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] * 2 + [(None, URLS[9], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    listed = spark.createDataFrame([(x,) for x in (*U.LISTED, None, "")], "url string")
    got = U.judged_pages(pages, listed).collect()
    assert len(got) == len(rows)
    want = {(i, *brute(u, U.LISTED)) for i, u, _ in rows}
    assert {tuple(r) for r in got} == want


def test_bloom_has_no_false_negatives_and_the_join_removes_false_positives(spark):
    listed = spark.createDataFrame([(f"http://h{i}.example.org/p/{i}/",) for i in range(3000)], "url string")
    pages = spark.createDataFrame([(i, f"https://www.h{i}.example.org/p/{i}?q") for i in range(0, 9000, 3)], "page_id long, url string")
    out = U.url_filter(pages, listed)
    assert {r.page_id for r in out.where("_verdict = 'block'").collect()} == set(range(0, 3000, 3))
    assert U.url_filter(pages, listed.limit(0)).where("_verdict = 'block'").count() == 0
    assert U.url_filter(pages.limit(0), listed).count() == 0
    assert out.columns == [*pages.columns, "_host", "_path", "_rule", "_verdict"]
    taken = U.url_filter(pages.selectExpr("*", "1 AS _host", "2 AS _url", "3 AS _listed_url", "4 AS _row"), listed)
    assert taken.columns[-4:] == ["__host", "_path", "_rule", "_verdict"] and taken.where("_verdict = 'block'").count() == 1000


def test_long_lists_keep_a_filter_that_filters(spark):
    """Over a million keys: the filter grows with them, so few strangers pass it."""
    listed = spark.range(1_050_000).selectExpr("concat('h', id, '.example.org') AS url")
    pages = spark.range(0, 6_000_000, 1500).selectExpr("id AS page_id", "concat('http://h', id, '.example.org/x') AS url")
    out = U.url_filter(pages, listed).where("_verdict = 'block'")
    assert [r.page_id for r in out.select("page_id").sort("page_id").collect()] == list(range(0, 1_050_000, 1500))


def test_the_filter_grows_with_the_list(spark, monkeypatch):
    listed = spark.range(20_000).selectExpr("concat('h', id, '.example.org') AS url")
    n_blocks = U.blocks_for(20_000)
    assert n_blocks * U.KEYS_A_BLOCK >= 20_000 and U.blocks_for(10**9) * U.KEYS_A_BLOCK >= 10**9
    full = U.bloom_blocks(U.list_keys(listed), n_blocks).selectExpr("avg(bit_count(w0) + bit_count(w1) + bit_count(w2) + bit_count(w3)) / 256").first()[0]
    assert full**8 < 0.002  # the chance that a stranger passes
    monkeypatch.setattr(U, "MOST_BLOCKS", 0)  # the filter isn't broadcast
    pages = spark.range(0, 60_000, 100).selectExpr("id AS page_id", "concat('http://h', id, '.example.org/x') AS url")
    assert U.url_filter(pages, listed).where("_verdict = 'block'").count() == 200


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="needs the driver's tables")
def test_the_query_runs_no_python(spark):
    from sparrowql.llm import queries

    plan = queries.op10_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan
