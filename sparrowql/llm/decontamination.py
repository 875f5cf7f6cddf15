"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document holds an item if some part of it is within ``edit_bound`` word edits
of the item (a fifth of its words). Words are lower-cased runs of ``\\w``; of an item's
places in a text that of the least distance counts, and of these the first.

1. Windows: of an item of n words with at most E edits, one of E + 1 equal
   pieces stays intact, so every true window holds a gram of n // (E + 1) words
   of the item at its offset. Such grams place the item-sized windows; windows
   without any can't be within the word bound, so nothing is lost by leaving them.
2. CGK: a random walk copies a window's word or moves on, by a random bit for
   each (step, word), and maps edit distance to Hamming distance. Windows and
   items use the same ``EMBEDDINGS`` walks.
3. LSH: ``REPEATS`` samples of ``SAMPLED`` symbols of an embedding; a window is
   a candidate for each item with which it agrees on one sample.
4. Candidates are verified by exact banded edit distance.

Items are cut into blocks of about ``BLOCK_BYTES`` of text, which are broadcast;
a task holds one block at a time and takes its texts through all of them, so
documents are only mapped, once for each ``SCAN_BYTES`` of benchmark. Null or
wordless items and texts match nothing; repeated items each match; repeated rows
and null ids are judged like any other; empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparrowql.llm.passages import Seeds, Vocabulary, align, fit_distances, gram_hashes, joined, part_of, word_spans, words
from sparrowql.llm.shared import slices, trimmed, with_fields

#: Share of an item's words that edits may touch.
EDITS = 0.2
EMBEDDINGS, REPEATS, SAMPLED = 4, 24, 3
#: Text of a block of items, text of all blocks that are broadcast for one scan, and text that a task takes through several blocks at once.
BLOCK_BYTES, SCAN_BYTES, PART_BYTES = 4_000_000, 128_000_000, 32_000_000
#: Rows of matrices at once.
ROWS = 20_000


def edit_bound(n: int) -> int:
    return int(n * EDITS)


def cgk(x: np.ndarray, lengths: np.ndarray, walk: int) -> np.ndarray:
    """Embeddings (rows, 3 * width) of rows of word numbers; -1 where a row has ended."""
    count, width = x.shape
    padded = np.concatenate([x, np.full((count, 1), -1, x.dtype)], axis=1)
    out = np.empty((count, 3 * width), x.dtype)
    at, row = np.zeros(count, np.int64), np.arange(count)
    for t in range(3 * width):
        word = padded[row, at]
        out[:, t] = word
        mixed = (word.astype(np.uint64) + np.uint64((t * 4 + walk + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        at += ((mixed >> np.uint64(43)) & np.uint64(1)).astype(np.int64)
        np.minimum(at, lengths, out=at)
    return out


def lsh_keys(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(rows, EMBEDDINGS * REPEATS) keys; rows of one length sample the same steps."""
    rng = np.random.default_rng(11)
    share = rng.random((EMBEDDINGS, REPEATS, SAMPLED))
    keys = np.empty((len(x), EMBEDDINGS * REPEATS), np.uint64)
    row = np.arange(len(x))
    for walk in range(EMBEDDINGS):
        embedded = cgk(x, lengths, walk)
        for r in range(REPEATS):
            h = (lengths.astype(np.uint64) * np.uint64(977) + np.uint64(walk * REPEATS + r)) * np.uint64(0x9E3779B97F4A7C15)
            for s in range(SAMPLED):
                # a walk of n words takes 2 * n steps on average
                symbol = embedded[row, (share[walk, r, s] * 2 * lengths).astype(np.int64)]
                h = (h ^ symbol.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            keys[:, walk * REPEATS + r] = h
    return keys


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[object, str]]):
        tokens = [(i, words(t)) for i, t in items if t]
        tokens = [(i, w) for i, w in tokens if w]
        self.names = [i for i, _ in tokens]
        self.tokens = [w for _, w in tokens]
        self.vocabulary = Vocabulary([w for _, w in tokens])
        self.codes = [self.vocabulary.encode(w) for _, w in tokens]
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        entries: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for p, code in enumerate(self.codes):
            k = max(1, len(code) // (edit_bound(len(code)) + 1))
            k = min(k, 8)  # a longer intact piece holds grams of eight words
            entries[k] += [(int(h), p, at) for at, h in enumerate(gram_hashes(code, k))]
        self.seeds = [Seeds(e, k) for k, e in sorted(entries.items())]
        self.buckets = np.zeros(0, np.uint64)
        self.bucket_items = np.zeros(0, np.int64)
        if self.codes:
            keys, of = [], []
            for n in np.unique(self.sizes):
                same = np.flatnonzero(self.sizes == n)
                found = lsh_keys(np.stack([self.codes[p] for p in same]), np.full(len(same), n))
                keys.append(found.ravel())
                of.append(np.repeat(same, found.shape[1]))
            flat = np.concatenate(keys)
            order = np.argsort(flat, kind="stable")
            self.buckets, self.bucket_items = flat[order], np.concatenate(of)[order]

    def find(self, texts: list[str]) -> dict[int, dict[int, tuple[int, int, int]]]:
        """text -> item -> (distance, first word, end word) of the best window."""
        codes = [self.vocabulary.encode(words(text)) for text in texts]
        x, ends = joined(codes)
        windows = [seeds.starts(x, ends)[0] for seeds in self.seeds]
        out: dict[int, dict[int, tuple[int, int, int]]] = defaultdict(dict)
        if not windows:
            return out
        w = np.concatenate(windows)
        size = self.sizes[w[:, 1]]
        for n in np.unique(size):
            part = w[size == n]
            for k in range(0, len(part), ROWS):
                self._verify(codes, *self._candidates(codes, part[k : k + ROWS], int(n)), out)
        return out

    def _candidates(self, codes: list[np.ndarray], windows: np.ndarray, n: int) -> tuple[np.ndarray, int]:
        """Rows (text, item, start) of which a key is in the item's bucket."""
        x = np.stack([part_of(codes[d], s, s + n) for d, _, s in windows.tolist()])
        keys = lsh_keys(x, np.full(len(x), n))
        low = np.searchsorted(self.buckets, keys.ravel())
        high = np.searchsorted(self.buckets, keys.ravel(), side="right")
        count = high - low
        entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        row = np.repeat(np.repeat(np.arange(len(x)), keys.shape[1]), count)
        same = self.sizes[self.bucket_items[entry]] == n  # windows have an item's size
        pairs = np.unique(np.stack([row[same], self.bucket_items[entry[same]]], axis=1), axis=0)
        return np.stack([windows[pairs[:, 0], 0], pairs[:, 1], windows[pairs[:, 0], 2]], axis=1), n

    def _verify(self, codes: list[np.ndarray], pairs: np.ndarray, n: int, out: dict) -> None:
        bound = edit_bound(n)
        for k in range(0, len(pairs), ROWS):
            part = pairs[k : k + ROWS]
            items = np.stack([self.codes[p] for p in part[:, 1].tolist()])
            distance = fit_distances(items, np.stack([part_of(codes[d], s - bound, s + n + bound) for d, _, s in part.tolist()]))
            near = distance <= bound
            for (d, p, s), far in sorted(zip(part[near].tolist(), distance[near].tolist(), strict=True), key=lambda x: (x[1], x[0][2])):
                if p not in out[d] or far < out[d][p][0]:
                    _, _, first, end = align(self.codes[p], codes[d], s - bound, s + bound)
                    out[d][p] = (far, max(0, first), min(end, len(codes[d])))


def _scans(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, scan_bytes: int) -> Iterator[list[Broadcast]]:
    """The items in blocks by a hash of the text, as many at a time as one scan takes."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = -(-total // block_bytes)
    together = max(1, scan_bytes // block_bytes)
    for first in range(0, n, together):
        blocks = []
        for k in range(first, min(n, first + together)):
            block = items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k) if n > 1 else items
            blocks.append(spark.sparkContext.broadcast(Items([(r.i, r.t) for r in block.collect()])))
        yield blocks


def _found(parts: Iterator[pa.RecordBatch], text_col: str, blocks: list[Broadcast]) -> Iterator[tuple[pa.RecordBatch, list[str], dict[int, list]]]:
    """(slice, its texts, text -> (item, its words, distance, first word, end word)) of all blocks."""
    for batch in parts:
        for part in slices(batch, text_col, PART_BYTES if len(blocks) > 1 else 4_000_000):
            texts = [t or "" for t in part.column(text_col).to_pylist()]
            found: dict[int, list] = defaultdict(list)
            for block in blocks:
                items = block.value
                for d, places in items.find(texts).items():
                    found[d] += [(items.names[p], len(items.codes[p]), *place) for p, place in sorted(places.items())]
                if len(blocks) > 1:
                    vars(block).pop("_value", None)  # else a worker would keep every block
            yield part, texts, found


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    scan_bytes: int = SCAN_BYTES,
) -> DataFrame:
    """A row for each document and item that it holds.

    Columns: the ids, ``edits``, ``item_words``, ``start`` and ``end`` (code
    points of the best place).
    """
    item_kind = benchmark.schema[item_col].dataType
    schema = with_fields(docs.select(id_col).schema).add(item_col, item_kind)
    schema = with_fields(schema, edits="int", item_words="int", start="int", end="int")
    kinds = [to_arrow_type(item_kind), *[pa.int32()] * 4]
    out = None
    for blocks in _scans(benchmark, item_col, item_text_col, block_bytes, scan_bytes):

        def run(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for part, texts, found in _found(batches, text_col, blocks):
                rows = []
                for d in sorted(found):
                    spans = word_spans(texts[d])
                    rows += [(d, name, far, n, spans[a][0], spans[b - 1][1]) for name, n, far, a, b in found[d] if b > a]
                if rows:
                    ids = part.column(id_col).take(pa.array([r[0] for r in rows], pa.int64()))
                    columns = [ids, *[pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds)]]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

        one = docs.select(id_col, text_col).mapInArrow(trimmed(run), schema)
        out = one if out is None else out.union(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, scan_bytes: int = SCAN_BYTES
) -> DataFrame:
    """The input rows that hold no item."""
    for blocks in _scans(benchmark, item_text_col, item_text_col, block_bytes, scan_bytes):

        def run(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for part, _, found in _found(batches, text_col, blocks):
                yield part.filter(pa.array([not found.get(d) for d in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(trimmed(run), docs.schema)
    return docs


def stage(spark, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark item."""
    return clean(docs, benchmark)
