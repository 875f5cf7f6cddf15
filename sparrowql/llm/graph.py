"""Connected components of a distributed edge list.

Repeated edges, loops and edges of either direction are fine; a node without an
edge gets no row; an empty list gives an empty result. Edges have no nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowql.llm.shared import Workspace


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


#: Distinct edges that one task joins at most (16 bytes each); beyond that star rounds do it.
FEW_EDGES = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (a, b) of a task."""
    held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)  # sorted, so the least row is the least node
        label = forest(len(nodes), place[: len(a)], place[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def connected_components(edges: DataFrame, work: Workspace, label: str = "components") -> DataFrame:
    """(node, component) for each node with an edge; a component's name is its least node.

    ``edges`` has long columns a and b, without nulls. Up to ``FEW_EDGES`` edges, as
    counted, are joined by one task. More go through rounds of large-star and
    small-star, which need a logarithmic number of rounds in practice; each is
    written to the shared folder. A node with very many neighbours is met by
    partial minima before any shuffle, and joins are plain, so that Spark can
    split a hot node.
    """

    def pairs(df: DataFrame, low, high) -> DataFrame:
        return df.select(low.alias("a"), high.alias("b")).where("a <> b").distinct()

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        joined = both.where("b > a").join(least, F.col("a") == F.col("n"))
        return pairs(joined, F.col("m"), F.col("b"))

    def small_star(e: DataFrame) -> DataFrame:
        # a < b: b's smaller neighbours, and b itself, are joined to the least of them
        least = e.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("n"), "m")
        joined = e.join(least, F.col("b") == F.col("n"))
        moved = joined.select(F.col("m").alias("x"), F.col("a").alias("y")).union(least.select(F.col("m").alias("x"), F.col("n").alias("y")))
        return pairs(moved, F.col("x"), F.col("y"))

    e = work.save(pairs(edges, F.least("a", "b"), F.greatest("a", "b")), f"{label}-0")
    if e.count() <= FEW_EDGES:
        return e.coalesce(1).mapInArrow(_joined, "node long, component long")
    k, seen = 0, None
    while True:
        e = work.save(small_star(large_star(e)), f"{label}-{k + 1}")
        if k:
            work.drop(f"{label}-{k}")
        k += 1
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
