"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base counts come from array functions over each whole text. The thresholds of
six further rules are calibrated on every labelled document: for each stratum and
rule, cutoffs are tested from the laxest to the strictest, and a cutoff passes
while the exact binomial tail P(Bin(n, alpha / rules) <= false rejections) is
at most delta / (strata * rules). Testing in a fixed order and stopping at the
first failure keeps the family-wise error of a stratum's sequence; the division
corrects for the number of sequences. Among the cutoffs that pass, the one with
the largest gain (share of bad rows rejected less ``GAIN`` times the share of
good rows) is taken, the laxest on ties; a rule without gain isn't used.

Strata with so few good labels that no test of theirs could pass, even without a
false rejection, are pooled and calibrated as one; there the bound holds for the
pool as a whole, not for each stratum in it. Where the pool is too small as well,
its strata get no cutoffs.

Cases: a null text has no words and fails the base rules; the null stratum and
the empty one are two; strata without any label get no cutoffs, so only the
base rules reject there; repeated rows are judged alike; without labels only
the base rules hold; an empty table gives an empty table. Labels that are null
or whose document is missing are ignored, and several labels of one document
count as its least. Rows of one id are one label each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowql.llm.shared import Workspace, unique_name

#: False rejections that a stratum allows, and the risk of allowing more.
ALPHA, DELTA = 0.02, 0.05
GAIN = 10.0
CUTOFFS = 32

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
_SPACES = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHOUTS = "!?"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def quality_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows with COUNTS and the measures of the rules (a struct ``measures``).

    Each step is a projection of its own, so no array is computed twice.
    """
    df = docs.select("*", F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    words = F.array_remove(F.split(F.translate("_text", _SPACES, " " * len(_SPACES)), " "), "")
    lines = F.filter(F.split("_text", "\n"), lambda x: _without(x, _SPACES + " ") != "")
    df = df.select("*", words.alias("_words"), lines.alias("_lines"))
    df = df.select(
        "*",
        F.size("_words").cast("long").alias("_n_words"),
        F.size("_lines").alias("_n_lines"),
        F.when(
            F.size("_words") >= 3,
            F.transform(
                F.expr("slice(_words, 1, size(_words) - 2)"),
                lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
            ),
        ).alias("_windows"),
    )
    # windows sorted by hash, then those equal to a neighbour, as sorted positions
    df = df.select(
        "*",
        F.when(
            F.size("_windows") > F.size(F.array_distinct("_windows")),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    ).drop("_windows")
    near = lambda e, k: F.get("_sorted", k)["h"] == e["h"]
    df = df.select(
        "*",
        F.sort_array(
            F.transform(
                F.filter("_sorted", lambda e, k: F.coalesce(near(e, k - 1), F.lit(False)) | F.coalesce(near(e, k + 1), F.lit(False))),
                lambda e: e["i"],
            )
        ).alias("_at"),
    ).drop("_sorted")
    # a window adds three words, or as many as lie after the window before it
    added = F.transform("_at", lambda p, k: F.coalesce(F.least(F.lit(3), p - F.get("_at", k - 1)), F.lit(3)))
    length = F.length("_text")
    chars = F.length(_without(F.col("_text"), _SPACES + " "))
    df = df.select(
        *docs.columns,
        F.col("_n_words").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        (length - F.length(_without(F.col("_text"), _SYMBOLS))).cast("long").alias("n_symbols"),
        (F.col("_n_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(added, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("_n_lines"),
        (length - F.length(_without(F.col("_text"), _CAPITALS))).alias("_capitals"),
        (length - F.length(_without(F.col("_text"), _SHOUTS))).alias("_shouts"),
    )
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    measures = {
        "symbols": per_word("n_symbols"),
        "shouts": per_word("_shouts"),
        "capitals": F.col("_capitals") / F.greatest("word_chars", F.lit(1)),
        "dup_lines": F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1)),
        "repeats": per_word("n_repeat_words"),
        "long_words": per_word("word_chars") / 32,
    }
    return df.select(
        *docs.columns,
        *COUNTS[:5],
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.struct(*[F.least(v.cast("double"), F.lit(1.0)).alias(k) for k, v in measures.items()]).alias("measures"),
    )


RULES = ("symbols", "shouts", "capitals", "dup_lines", "repeats", "long_words")


def binomial_tail(k: Column, n: Column, p: float | Column) -> Column:
    """P(Bin(n, p) <= k) by exact summation in log space; 1 where k > n * p."""
    p = F.lit(p) if isinstance(p, float) else p
    odds = F.log(p) - F.log(1 - p)
    first = n * F.log(1 - p)
    start = F.struct(first.alias("term"), F.exp(first).alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log(n - i + 1) - F.log(i.cast("double")) + odds
        return F.struct(term.alias("term"), (a["total"] + F.exp(term)).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(steps, start, step, lambda a: a["total"]))


def calibrate(
    measured: DataFrame,
    labels: DataFrame,
    work: Workspace,
    id_col: str = "doc_id",
    label_col: str = "quality",
    alpha: float = ALPHA,
    delta: float = DELTA,
) -> DataFrame:
    """One row a stratum: ``stratum`` and ``cutoffs`` (map of rule to cutoff).

    ``measured`` has _id, _stratum, base_failed and measures of every document;
    every labelled one among them is tallied.
    """
    good = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    good = good.groupBy(F.col(id_col).alias("_label_id")).agg((F.min(label_col) > 0).alias("_good"))
    taken = measured.where(~F.col("base_failed")).select("_id", "_stratum", "measures")
    measured = taken.join(good, F.col("_id") == F.col("_label_id")).select("_stratum", "_good", "measures")
    # how many cutoffs a value exceeds: cutoff c rejects it if that number is over c
    level = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), F.ceil(F.col(f"measures.{r}") * CUTOFFS).cast("int").alias("level")) for r in RULES])
    )
    tally = (
        measured.select("_stratum", "_good", level.alias("x"))
        .groupBy("_stratum", "x.rule", "x.level")
        .agg(F.count(F.when(F.col("_good"), 1)).alias("good"), F.count(F.when(~F.col("_good"), 1)).alias("bad"))
    )
    tally = work.save(tally, "tally")  # read several times, and small
    own = tally.where(F.col("rule") == RULES[0]).groupBy(F.col("_stratum").alias("own")).agg(F.sum("good").alias("n"))
    strata = own.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata"))
    least = F.log(F.col("strata") * (len(RULES) / delta)) / -math.log(1 - alpha / len(RULES))
    own = own.crossJoin(F.broadcast(strata)).select("own", (F.col("n") < least).alias("pooled"), "strata")  # one row
    own = work.save(own, "strata")
    tally = tally.join(F.broadcast(own), F.col("_stratum").eqNullSafe(F.col("own")))
    tally = tally.withColumn("_stratum", F.when(~F.col("pooled"), F.col("_stratum")))
    tests = tally.groupBy("pooled", "_stratum", "rule", "strata").agg(
        F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.collect_list(F.struct("level", "good", "bad")).alias("levels")
    )
    over = lambda name: F.aggregate(
        F.filter("levels", lambda x: x["level"] > F.col("cutoff")), F.lit(0).cast("long"), lambda a, x: a + x[name]
    )
    tests = tests.select(
        "*", F.explode(F.sequence(F.lit(CUTOFFS - 1), F.lit(0), F.lit(-1))).alias("cutoff")
    ).select("pooled", "_stratum", "rule", "strata", "cutoff", "n_good", "n_bad", over("good").alias("k_good"), over("bad").alias("k_bad"))
    passes = binomial_tail(F.col("k_good"), F.col("n_good"), alpha / len(RULES)) <= F.lit(delta / len(RULES)) / F.col("strata")
    gain = F.col("k_bad") / F.greatest("n_bad", F.lit(1)) - GAIN * F.col("k_good") / F.greatest("n_good", F.lit(1))
    tests = tests.select("pooled", "_stratum", "rule", "cutoff", passes.alias("passes"), gain.alias("gain"))
    chosen = tests.groupBy("pooled", "_stratum", "rule").agg(
        F.coalesce(F.max(F.when(~F.col("passes"), F.col("cutoff"))), F.lit(-1)).alias("failed"),
        F.collect_list(F.struct("gain", "cutoff")).alias("all"),
    )
    best = F.array_max(F.filter("all", lambda x: (x["cutoff"] > F.col("failed")) & (x["gain"] > 0)))
    chosen = chosen.select("pooled", "_stratum", "rule", best["cutoff"].alias("cutoff")).where(F.col("cutoff").isNotNull())
    chosen = chosen.groupBy(F.col("pooled").alias("of_pool"), "_stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", (F.col("cutoff") / CUTOFFS).alias("cutoff")))).alias("cutoffs")
    )
    same = (F.col("pooled") == F.col("of_pool")) & F.when(~F.col("pooled"), F.col("own")).eqNullSafe(F.col("_stratum"))
    return own.join(F.broadcast(chosen), same).select(F.col("own").alias("stratum"), "cutoffs")


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    carry: list[str] | None = None,
    **limits,
) -> DataFrame:
    """The input rows with COUNTS, ``failed_rules`` (array) and ``kept``.

    Of the input's columns those in ``carry`` are given, all by default. They are
    written once with the counts, which calibration and verdict share; texts
    aren't shuffled. Cutoffs are a broadcast of a row for each stratum that has any.
    """
    carry = carry or docs.columns
    work = Workspace(docs.sparkSession, "quality")
    names = {c: unique_name(carry, c) for c in (*COUNTS, "failed_rules", "kept")}
    body = docs.select(
        F.struct(*carry).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_body"), F.col(stratum_col).alias("_stratum")
    )
    measured = work.save(quality_counts(body, "_body").drop("_body"), "measured")
    cutoffs = calibrate(measured, labels, work, id_col, **limits)
    judged = measured.join(F.broadcast(cutoffs), F.col("_stratum").eqNullSafe(F.col("stratum")), "left")
    failed = F.filter(
        F.array(*[F.when(F.col(f"measures.{r}") > F.try_element_at("cutoffs", F.lit(r)), F.lit(r)) for r in RULES]), lambda x: x.isNotNull()
    )
    judged = judged.select("_row", *COUNTS, failed.alias("failed_rules"))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return judged.select("_row.*", *[(F.col(c) if c != "kept" else kept).alias(n) for c, n in names.items()])


def stage(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that the rules keep."""
    judged = quality_rules(docs, labels)
    return judged.where(F.col(unique_name(docs.columns, "kept"))).select(*docs.columns)


def oracle_sql(alpha: float = ALPHA) -> str:
    """The query in DuckDB: counts, calibration and verdicts."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents
), w AS (SELECT rn, unnest(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS word,
    generate_subscripts(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), 1) AS pos FROM d
), tri AS (SELECT rn, pos, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rn ORDER BY pos)
), twice AS (SELECT rn, pos, count(*) OVER (PARTITION BY rn, a, b, c) AS n FROM tri WHERE c IS NOT NULL
), rep AS (SELECT rn, count(DISTINCT pos + k) AS n_repeat_words FROM twice, range(3) AS r(k) WHERE n > 1 GROUP BY rn
), nw AS (SELECT rn, count(*) AS n_words FROM w GROUP BY rn
), ln AS (SELECT rn, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d
), f AS (
  SELECT d.rn, doc_id, stratum, coalesce(n_words, 0) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(t, '[^!?]', '', 'g')) AS shouts, len(l) AS n_lines
  FROM d JOIN ln USING (rn) LEFT JOIN nw USING (rn) LEFT JOIN rep USING (rn)
), m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [
    {{'rule': 'symbols', 'v': n_symbols / greatest(n_words, 1)}}, {{'rule': 'shouts', 'v': shouts / greatest(n_words, 1)}},
    {{'rule': 'capitals', 'v': capitals / greatest(word_chars, 1)}}, {{'rule': 'dup_lines', 'v': n_dup_lines / greatest(n_lines, 1)}},
    {{'rule': 'repeats', 'v': n_repeat_words / greatest(n_words, 1)}}, {{'rule': 'long_words', 'v': word_chars / greatest(n_words, 1) / 32}}] AS ms FROM f
), lab AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), lv AS (SELECT stratum, good, x.rule AS rule, ceil(least(x.v, 1.0) * {CUTOFFS}) AS level FROM (SELECT stratum, good, unnest(ms) AS x FROM m JOIN lab USING (doc_id) WHERE NOT base_failed)
), own AS (SELECT stratum AS own, count(*) FILTER (good AND rule = '{RULES[0]}') AS n, count(*) OVER () AS strata FROM lv GROUP BY stratum
), pl AS (SELECT own, n < ln(strata * {len(RULES) / DELTA!r}) / {-math.log(1 - alpha / len(RULES))!r} AS pooled, strata FROM own
), ts AS (SELECT pooled, CASE WHEN NOT pooled THEN stratum END AS stratum, rule, any_value(strata) AS strata, c AS cutoff, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS n_bad, count(*) FILTER (good AND level > c) AS k,
    count(*) FILTER (NOT good AND level > c) AS k_bad FROM lv JOIN pl ON stratum IS NOT DISTINCT FROM own, range({CUTOFFS}) AS r(c) GROUP BY ALL
), ps AS (SELECT *, CASE WHEN k > n * {alpha / len(RULES)!r} THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln({alpha / len(RULES)!r}) + (n - i) * ln(1 - {alpha / len(RULES)!r})))) END <= {DELTA / len(RULES)!r} / strata AS passes,
    k_bad / greatest(n_bad, 1) - {GAIN} * k / greatest(n, 1) AS gain FROM ts
), best AS (SELECT pooled, stratum, rule, arg_max(cutoff, (gain, cutoff)) AS cutoff FROM (
    SELECT *, coalesce(max(cutoff) FILTER (NOT passes) OVER (PARTITION BY pooled, stratum, rule), -1) AS failed FROM ps) WHERE cutoff > failed AND gain > 0 GROUP BY pooled, stratum, rule
), v AS (SELECT rn, string_agg(x.rule, ',' ORDER BY list_position({list(RULES)}, x.rule)) AS failed_rules FROM (SELECT rn, stratum, unnest(ms) AS x FROM m) AS e
    JOIN pl ON e.stratum IS NOT DISTINCT FROM own
    JOIN best ON x.rule = best.rule AND pl.pooled = best.pooled AND (CASE WHEN NOT pl.pooled THEN own END) IS NOT DISTINCT FROM best.stratum WHERE least(x.v, 1.0) > cutoff / {CUTOFFS}.0 GROUP BY rn)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(failed_rules, '') AS failed_rules,
  NOT base_failed AND failed_rules IS NULL AS kept FROM m LEFT JOIN v USING (rn)
"""
