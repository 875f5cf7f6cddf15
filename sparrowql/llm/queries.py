"""The queries of the ten operators and of the pipeline, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowql.llm.bpe import bpe_digests
from sparrowql.llm import decontamination, language, licenses, packing, quality, secrets, simhash, substrings, urls
from sparrowql.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.shard(table(spark, sf_dir, "documents"), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    fingerprint = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    return out.select("doc_id", fingerprint.alias("fingerprint"), F.col("_component").alias("component_id"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 without what the method adds."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return judged.select("doc_id", *quality.COUNTS, F.array_join("failed_rules", ",").alias("failed_rules"), "kept")


#: Share of false rejections at which the few labels of small tables give cutoffs.
WIDE_ALPHA = 0.2


def quality_rules_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 with a bound so wide that cutoffs act on small tables too."""
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"], alpha=WIDE_ALPHA)
    return judged.select("doc_id", *quality.COUNTS, F.array_join("failed_rules", ",").alias("failed_rules"), "kept")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, urls.LISTED))).alias("url"))
    return urls.judged_pages(table(spark, sf_dir, "pages"), listed)


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_language_id": op3_language_id,
        "op4_sharding": op4_sharding,
        "op5_simhash": op5_simhash,
        "op6_secret_scan": op6_secret_scan,
        "secret_base": secret_base,
        "op7_quality_rules": op7_quality_rules,
        "quality_rules_wide": quality_rules_wide,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_license_scan": op9_license_scan,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": substrings.ORACLE_SQL,
        "secret_base": secrets.BASE_SQL,
        "op7_quality_rules": quality.oracle_sql(),
        "quality_rules_wide": quality.oracle_sql(WIDE_ALPHA),
        "op10_url_filter": urls.ORACLE_SQL,
    }
