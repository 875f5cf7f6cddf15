"""URL filters: a blocked Bloom filter, then an exact hash join, in DataFrame functions only.

A url is listed if the list holds one of its canonical keys: its canonical URL
(host without ``www.``, path without trailing slash) or ``host/`` for its host
or a parent domain. Keys are tested against a blocked Bloom filter: one block of
256 bits a key, eight bits within it, and a block for every ``KEYS_A_BLOCK`` keys
of the list, however long it is. Up to ``MOST_BLOCKS`` blocks are broadcast; a
larger filter is met by a plain join on the block. Possible hits go to an exact
join, which removes false positives.

Rules (host, path prefix, verdict) come before the list: a rule fits its host
and all subdomains if the path starts with the rule's, and the longest wins.

Cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and isn't listed, so it is allowed; repeated urls are judged once and get
the same verdict; null or empty list entries are ignored; an empty list allows
all that no rule blocks; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowql.llm.shared import unique_name

#: Blocks of a filter that is broadcast at most, 40 bytes each.
MOST_BLOCKS = 1 << 18
#: Listed keys a block; eight bits of 256 each.
KEYS_A_BLOCK = 16
WORDS, BITS_A_KEY = 4, 8
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _CAPITALS, _SMALL)


def url_path(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical_host(host: Column) -> Column:
    """Without user, port, leading ``www.`` and trailing dots."""
    plain = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\.+$", ""), r"^www\.(?=.)", "")


def own_key(host: Column, path: Column) -> Column:
    """The url's own key; null without a host."""
    host = canonical_host(host)
    return F.when(host != "", F.concat(host, F.regexp_replace(path, r"/+$", ""), F.lit("/")))


def canonical_keys(host: Column, path: Column) -> Column:
    """Every key by which a list may hold the url, the url's own first."""
    labels = F.split(canonical_host(host), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")),
    )
    keys = F.array_distinct(F.concat(F.array(own_key(host, path)), parents))
    return F.when(canonical_host(host) == "", F.array().cast("array<string>")).otherwise(keys)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for name, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _bits(key: Column) -> list[tuple[int, Column]]:
    """(word, single-bit mask) of a key: two bits in each word of its block."""
    other = F.xxhash64(F.lit("bits"), key)
    return [
        (i % WORDS, F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(other, 6 * i).bitwiseAND(63).cast("int")))
        for i in range(BITS_A_KEY)
    ]


def blocks_for(n_keys: int) -> int:
    """Blocks of a filter, a power of two."""
    return 1 << (n_keys // KEYS_A_BLOCK).bit_length()


def bloom_blocks(listed_keys: DataFrame, n_blocks: int) -> DataFrame:
    """``block`` and its words, for distinct keys in column ``key``."""
    words = [
        F.bit_or(_union([m for w, m in _bits(F.col("key")) if w == word])).alias(f"w{word}") for word in range(WORDS)
    ]
    return listed_keys.groupBy(_block(F.col("key"), n_blocks).alias("block")).agg(*words)


def _union(masks: list[Column]) -> Column:
    out = masks[0]
    for m in masks[1:]:
        out = out.bitwiseOR(m)
    return out


def list_keys(listed: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct canonical keys of listed urls; an entry without ``://`` is a host with or without path."""
    url = F.col(url_col)
    rest = F.when(F.instr(url, "://") > 0, url_rest(url)).otherwise(url)
    key = own_key(url_host(rest), url_path(rest))
    return listed.where(url.isNotNull()).select(key.alias("key")).where("key is not null").distinct()


def listed_urls(urls: DataFrame, listed: DataFrame, url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """Distinct urls (column ``_listed_url``) of which the list holds a key."""
    keys = list_keys(listed, listed_col)
    n_blocks = blocks_for(keys.count())
    blocks = bloom_blocks(keys, n_blocks)
    if n_blocks <= MOST_BLOCKS:
        blocks = F.broadcast(blocks)
    rest = url_rest(F.col(url_col))
    own = urls.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("_listed_url"), F.explode(canonical_keys(url_host(rest), url_path(rest))).alias("_key"))
    own = own.withColumn("_block", _block(F.col("_key"), n_blocks))
    hit = F.col("_block") == F.col("block")
    for word, mask in _bits(F.col("_key")):
        hit = hit & (F.col(f"w{word}").bitwiseAND(mask) != 0)
    possible = own.join(blocks, hit).select("_listed_url", "_key").distinct()
    return possible.join(keys, F.col("_key") == F.col("key"), "left_semi").select("_listed_url").distinct()


def url_filter(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """The input rows with ``_host``, ``_path``, ``_rule`` and ``_verdict`` (with more underscores where these are taken)."""
    hits = listed_urls(pages.select(url_col), listed, url_col, listed_col)
    rest = url_rest(F.coalesce(F.col("_url"), F.lit("")))
    df = pages.select(F.struct("*").alias("_row"), F.col(url_col).alias("_url")).join(hits, F.col("_url") == F.col("_listed_url"), "left")
    df = df.select("_row", "_listed_url", url_host(rest).alias("host"), url_path(rest).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("_listed_url").isNotNull(), "block").otherwise("allow")
    added = {"_host": F.col("host"), "_path": F.col("path"), "_rule": rule, "_verdict": F.coalesce(verdict, method)}
    return df.select("_row.*", *[c.alias(unique_name(pages.columns, name)) for name, c in added.items()])


#: The rules of the query (host, path, verdict) and its listed hosts.
RULES: tuple[Rule, ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UNWANTED = ("spam-farm", "cheap-pills", "casino-win", "adult-x", "ads-track", "free-bets")
LISTED = tuple(f"{name}.example.{top}" for name in UNWANTED for top in ("com", "net", "org"))


def judged_pages(pages: DataFrame, listed: DataFrame) -> DataFrame:
    out = url_filter(pages.select("page_id", "url"), listed, RULES)
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


#: The same in DuckDB, with the list's keys written out.
ORACLE_SQL = """
WITH r AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), j AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
    regexp_matches(host, '(^|\\.)(spam-farm|cheap-pills|casino-win|adult-x|ads-track|free-bets)\\.example\\.(com|net|org)$') AS listed FROM p
)
SELECT page_id, host, path, rule, CASE rule WHEN 'www.example.com/en/' THEN 'allow' WHEN 'example.com/en/' THEN 'block'
  WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block' WHEN 'com/' THEN 'allow' ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict FROM j
"""
