"""A training-corpus pipeline of five operators, each stage written and read again.

quality rules -> SimHash near-dedup at a Jaccard similarity of 0.8 -> benchmark
decontamination -> secret scans -> byte-level BPE. Every stage works on all that
the one before it kept.

Cases: a null or empty text has too few words, so the first stage rejects it, and
the later ones take it as empty; repeated rows and rows of one id are rows of their
own until near-dedup, which keeps one row of each class, of its least id (any of
equal ones, and any row of a class without ids); very long texts are worked on
whole; an empty table gives an empty table; columns of any other name are carried along, and the
last stage's own get underscores before their names where these are taken.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparrowql.llm import bpe, decontamination, jaccard, quality, secrets
from sparrowql.llm.shared import Workspace, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and the calibrated cutoffs."""
    return quality.stage(spark, docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word Jaccard of 0.8 or more), that of the least id."""
    return jaccard.stage(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontamination.stage(spark, docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark."""
    return secrets.stage(spark, docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, their number, and whether they decode to the text."""
    return bpe.tokenized(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("tokenize", tokenize),
]

#: SQL can express neither near-dedup, embeddings, compression nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
        work.keep(name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
