"""Byte-level BPE encoding and decoding by padded numpy matrices.

Unique pieces are dealt into buckets by byte length. A bucket is a matrix with
one row a piece, padded with -1. In each round every row merges its leftmost
pair of the least rank: pair ranks come from an open-addressing hash table that
is probed for all rows at once, and finished rows are compacted away. Rows
longer than ``MATRIX_LIMIT`` bytes would need a quadratic number of cell moves,
so they go through a heap over a linked list, which makes the same merges in
the same order.

Null texts count as empty and give no ids. The operator is a map over rows: it
keeps every input column, repeats and nulls included, and shuffles nothing; an empty
table gives an empty table. The rank file is read on the driver and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from sparrowql.llm.shared import slices, trimmed, unique_name, with_fields

#: Rows up to this many bytes go through matrices.
MATRIX_LIMIT = 1024
#: Matrix cells of one slice of a bucket, which bounds a task's memory.
SLICE_CELLS = 2_000_000
#: Pieces whose ids a task keeps between batches.
CACHE_PIECES = 100_000
_NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> merged id, with vectorised linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int32)
        todo = np.arange(len(keys))
        slot = self._home(keys)
        while len(todo):
            free = self.keys[slot] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]] = keys[todo[put]]
            self.values[slot[put]] = values[todo[put]]
            todo, slot = todo[~put], (slot[~put] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, ``_NONE`` where the pair has none or either is padding."""
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._home(keys[todo])
        while len(todo):
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (found >= 0)
            todo, slot = todo[more], (slot[more] + 1) & self.mask
        return out


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        """``ranks``: the bytes of a rank file."""
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        self.vocabulary: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.cache: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, in the order given."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) > MATRIX_LIMIT:
                out[i] = self._by_heap(piece)
            else:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, SLICE_CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._by_matrix([pieces[i] for i in part]), strict=True):
                    out[i] = ids
        return out  # type: ignore[return-value]

    def _by_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[
            np.frombuffer(b"".join(pieces), np.uint8)
        ]
        out: list[np.ndarray] = [ids[0, :0]] * len(pieces)
        row = np.arange(len(pieces))
        ranks = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(row):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            k = np.arange(len(row))
            least = ranks[k, at] if ranks.shape[1] else np.full(len(row), _NONE)
            done = least == _NONE
            if done.any():
                for i, line, n in zip(row[done], ids[done], lengths[done], strict=True):
                    out[i] = line[:n]
                keep = ~done
                row, lengths, at, least = row[keep], lengths[keep], at[keep], least[keep]
                width = int(lengths.max()) if len(row) else 1
                ids, ranks = ids[keep, :width], ranks[keep, : width - 1]
                if not len(row):
                    break
                k = np.arange(len(row))
            # the merged id takes the left cell, and what follows moves one cell left
            ids[k, at] = least
            cells = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cells + (cells > at[:, None]), axis=1)
            cells = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, cells + (cells > at[:, None]), axis=1)
            lengths = lengths - 1
            for near in (at - 1, at):
                ok = np.flatnonzero((near >= 0) & (near < ranks.shape[1]))
                ranks[ok, near[ok]] = self.pairs.find(ids[ok, near[ok]], ids[ok, near[ok] + 1])
        return out

    def _by_heap(self, piece: bytes) -> np.ndarray:
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        ranks, end = self.ranks, len(parts)
        heap = [
            (rank, i)
            for i in range(end - 1)
            if (rank := ranks.get(piece[i : i + 2])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else end
            if j >= end or ranks.get(parts[i] + parts[j]) != rank:  # type: ignore[operator]
                continue
            parts[i], parts[j] = parts[i] + parts[j], None  # type: ignore[operator]
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else end
                if b < end and (r := ranks.get(parts[a] + parts[b])) is not None:  # type: ignore[operator]
                    heapq.heappush(heap, (r, a))
        return np.array([ranks[p] for p in parts if p is not None], np.int32)

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        new = list({p for pieces in split for p in pieces if p not in self.cache})
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache = {}
            new = list({p for pieces in split for p in pieces})
        coded = self.encode_pieces([p.encode() for p in new])
        self.cache.update(zip(new, (x.astype("<u4").tobytes() for x in coded), strict=True))
        get = self.cache.__getitem__
        for pieces in split:
            yield b"".join(map(get, pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def _shipped(docs: DataFrame, rank_path: str) -> Broadcast:
    """The rank file, read on the driver alone; some megabytes."""
    return docs.sparkSession.sparkContext.broadcast(Path(rank_path).read_bytes())


def bpe(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "token_ids",
    decoded_col: str = "decoded",
) -> DataFrame:
    """Add each row's token ids (array of int) and the text decoded from them.

    The decoded column is binary. The two columns get underscores before their
    names where the input has such columns already.
    """
    names = docs.columns
    ids_col, decoded_col = unique_name(names, ids_col), unique_name(names, decoded_col)
    schema = with_fields(docs.schema, **{ids_col: "array<int>", decoded_col: "binary"})
    ranks = _shipped(docs, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                ids = [np.frombuffer(x, "<u4") for x in coder.encode_texts(texts)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                columns = [
                    *part.columns,
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array([coder.decode(x) for x in ids], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*names, ids_col, decoded_col])

    return docs.mapInArrow(trimmed(run), schema)


def bpe_digests(
    docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: n_tokens, and SHA-256 of its ids and of what they decode to."""
    schema = with_fields(
        docs.select(id_col).schema, n_tokens="long", ids_sha256="string", decoded_sha256="string"
    )
    ranks = _shipped(docs, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                n, ids_sha, decoded_sha = [], [], []
                for ids in coder.encode_texts(texts):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    decoded = coder.decode(np.frombuffer(ids, "<u4"))
                    decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                columns = [part.column(id_col), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(id_col, text_col).mapInArrow(trimmed(run), schema)


def tokenized(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The input rows with ``token_ids``, ``n_tokens`` and ``round_trip`` (whether the ids decode to the text)."""
    names = docs.columns
    added = {unique_name(names, n): k for n, k in (("token_ids", "array<int>"), ("n_tokens", "long"), ("round_trip", "boolean"))}
    schema = with_fields(docs.schema, **added)
    ranks = _shipped(docs, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in coder.encode_texts(texts)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns = [
                    *part.columns,
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array([coder.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return docs.mapInArrow(trimmed(run), schema)
