"""Removal of repeated substrings by a distributed difference cover.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a
document with a smaller id is removed. Suffixes are ordered only as far as
``LENGTH`` bytes, which is all that the comparison of neighbours needs, and bytes
alone decide.

1. Sample: positions whose residue modulo 21 is in a difference cover of five
   residues. Any two windows at positions i and j have a shift below 21 that
   brings both into the sample, so two equal windows of 50 bytes hold a pair of
   equal sampled tuples of 30 bytes.
2. Sift: tuples that occur in one document alone can't matter. Each chunk of
   documents sends the sorted distinct hashes of its tuples to the range of hashes
   they fall in; there the chunks' lists meet, and each hash comes back with a bit,
   whether another chunk has it. Equal hashes of different tuples only let a tuple through.
3. Sort and name: what is left goes, with the 20 bytes on either side, to the
   range of tuples it falls in, in sorted lists with common prefixes left out.
   There the tuples of all chunks are sorted by their bytes, and their ranks are
   their names.
4. Recurse on names: a sampled suffix of 30 + j bytes is named by the rank of the
   pair (name of 30 + j - 1 bytes, next byte), up to 50 bytes.
5. Merge: a window that starts k bytes before its sample is the pair of those k
   bytes, named likewise, and the name of the sample's suffix of 50 - k bytes. For each shift k,
   the windows of that shift, sampled (k = 0) or not, are sorted by these pairs, which is the order of
   their bytes.
6. Compare: equal neighbours in such an order, one of which comes from a smaller
   document, mark a window. Two equal windows have a shift in common, so one order sees them both.

A tuple with more than ``HOT`` places in some chunk (a common line amid different
texts) would fill its range. Its windows are sent instead of the tuple, each to a range by
a hash of its own bytes, and are sorted there.

Chunks hold documents of neighbouring ids, or pieces of the rows of one id, so
order between chunks decides order between documents. A chunk sends a string
once, however often it has it, and order within a chunk is found there by the same steps. Whole copies
are found first, by SHA-256, and stay out of the exchange.

Cases: a null text counts as empty; a null id is neither smaller nor larger
than another, so such rows stay whole and mark nothing; rows of one id, however
many, don't mark each other; a text longer than a chunk makes its chunk as long; an
empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowql.llm.shared import Workspace, release, trimmed

LENGTH = 50
#: A perfect difference set: every residue is a difference of two members.
MODULUS, COVER = 21, (3, 6, 7, 12, 14)
TUPLE = LENGTH - MODULUS + 1
#: Bytes on either side of a tuple that its windows may hold, and a row of the exchange: tuple, left and right bytes, and how many of these there are.
SIDE = LENGTH - TUPLE
ROW = TUPLE + 2 * SIDE + 2
#: Places of a tuple in a chunk from which on its windows are sent alone.
HOT = 64
#: Bits of a hash, which else follow from the input's size.
HASH_BITS: int | None = None
#: Bytes of a chunk's documents and of input for a range of hashes, which grow with the root of the input; bytes of input for a range of tuples.
CHUNK_BYTES, MOST_CHUNK_BYTES, RANGE_BYTES, MOST_RANGE_BYTES, TUPLE_RANGE_BYTES = 4_000_000, 16_000_000, 8_000_000, 64_000_000, 32_000_000
#: Splitters between ranges of tuples at most, and sampled tuples for each; beyond that ranges are split by a hash of the tuple.
SPLITTERS, SAMPLES_A_SPLITTER = 4096, 16
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def windows_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each position, as one number (little-endian)."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))).view("<u8").ravel()


def names_of(eights: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of ``length`` bytes (8 at least) from each position."""
    h = np.full(len(at), length, np.uint64)
    for o in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        h = (h ^ eights[at + o]) * _MIX
        h ^= h >> _TURN
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def packed(sorted_names: np.ndarray) -> bytes:
    """Sorted distinct numbers as byte planes of their deltas, the high planes compressed."""
    if not len(sorted_names):
        return b""
    deltas = np.diff(sorted_names, prepend=np.uint64(0))
    planes = deltas.astype("<u8").view(np.uint8).reshape(-1, 8).T
    plain = max(0, (int(np.median(deltas)).bit_length() - 2) // 8)  # planes of bytes that are as good as random
    head = np.array([len(sorted_names), plain], "<u4").tobytes()
    return head + planes[:plain].tobytes() + zstandard.ZstdCompressor(level=3).compress(planes[plain:].tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n, plain = (int(x) for x in np.frombuffer(blob[:8], "<u4"))
    rest = zstandard.ZstdDecompressor().decompress(blob[8 + plain * n :], max_output_size=8 * n)
    planes = np.frombuffer(blob[8 : 8 + plain * n] + rest, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


class Chunk:
    """Documents in order of their ids, with their bytes joined; ``copies`` are places of whole copies."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, data: np.ndarray, copies: list[int]):
        self.ids, self.lengths, self.data = ids, lengths.astype(np.int64), data
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.copy = np.zeros(len(ids), bool)
        self.copy[np.array(copies, np.int64)] = True
        self.rank = np.cumsum(np.r_[False, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
        self.eights = windows_of(data)
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), self.lengths)  # of each byte
        # bytes of the document from each position on; none where it can't hold or mark a window
        taking_part = np.where(self.copy | (self.lengths < LENGTH), 0, self.starts + self.lengths)
        self.room = np.repeat(taking_part, self.lengths) - np.arange(len(data))

    def samples(self) -> np.ndarray:
        cover = np.zeros(MODULUS, bool)
        cover[list(COVER)] = True
        n = len(self.data)
        return np.flatnonzero(np.tile(cover, n // MODULUS + 1)[:n] & (self.room >= TUPLE))

    def anchors(self, at: np.ndarray) -> np.ndarray:
        """The rows (see ROW) of the tuples at these positions; bytes outside the document are 0."""
        left = np.minimum(at - self.starts[self.doc[at]], SIDE)
        right = np.minimum(self.room[at] - TUPLE, SIDE)
        around = self.padded(SIDE, SIDE + TUPLE)[at]
        out = np.empty((len(at), ROW), np.uint8)
        step = np.arange(SIDE)
        out[:, :TUPLE] = around[:, SIDE : SIDE + TUPLE]
        out[:, TUPLE : TUPLE + SIDE] = around[:, :SIDE] * (step >= SIDE - left[:, None])
        out[:, TUPLE + SIDE : -2] = around[:, SIDE + TUPLE :] * (step < right[:, None])
        out[:, -2], out[:, -1] = left, right
        return out

    def padded(self, before: int, after: int) -> np.ndarray:
        """For each position, the bytes from ``before`` before it to ``after`` after it."""
        whole = np.concatenate([np.zeros(before, np.uint8), self.data, np.zeros(after, np.uint8)])
        return np.lib.stride_tricks.sliding_window_view(whole, before + after)

    def windows(self, at: np.ndarray) -> np.ndarray:
        """Starts of all windows that hold the tuples at these positions."""
        starts = np.unique((at[:, None] - np.arange(SIDE + 1)).ravel())
        starts = starts[starts >= 0]
        # a start in the document before has its room there, which ends before the tuple
        return starts[self.room[starts] >= LENGTH]


class Hashes:
    """Hashes of positions of a chunk: sorted and distinct, with the way back."""

    def __init__(self, chunk: Chunk, at: np.ndarray, length: int, bits: int, most: int = HOT):
        values = names_of(chunk.eights, at, length) >> np.uint64(64 - bits)
        self.bits = bits
        self.distinct, self.place, count = np.unique(values, return_inverse=True, return_counts=True)
        self.hot = count > most
        rank = chunk.rank[chunk.doc[at]]
        low = np.full(len(self.distinct), np.iinfo(np.int64).max)
        high = np.full(len(self.distinct), -1)
        np.minimum.at(low, self.place, rank)
        np.maximum.at(high, self.place, rank)
        self.several = low < high  # documents of this chunk have it

    def parts(self, n_ranges: int) -> Iterator[tuple[int, bytes]]:
        """(range, packed hashes and which are hot) of the ranges of hashes that have any."""
        of = range_of(self.distinct, self.bits, n_ranges)
        edges = np.searchsorted(of, np.arange(n_ranges + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            hot = np.flatnonzero(self.hot[edges[k] : edges[k + 1]]).astype("<u4").tobytes()
            yield k, len(hot).to_bytes(4, "little") + hot + packed(self.distinct[edges[k] : edges[k + 1]])

    def flags(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each position's hash is in another document, and whether it is hot anywhere."""
        twin, hot = self.several, self.hot
        if answers:
            found = [unflagged(part["flags"], part["n"]) for part in sorted(answers, key=lambda x: x["k"])]
            elsewhere, hot = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(elsewhere) != len(twin):
                raise RuntimeError("a chunk's hashes and their answers differ: the chunk table changed meanwhile")
            twin = twin | elsewhere
        return twin[self.place], hot[self.place]


def flagged(*flags: np.ndarray) -> bytes:
    return b"".join(np.packbits(f).tobytes() for f in flags)


def unflagged(data: bytes, n: int) -> list[np.ndarray]:
    """The lists of n flags each."""
    return [x[:n].astype(bool) for x in np.unpackbits(np.frombuffer(data, np.uint8)).reshape(-1, -(-n // 8) * 8)]


def range_of(names: np.ndarray, bits: int, n_ranges: int) -> np.ndarray:
    top = min(bits, 32)
    return ((names >> np.uint64(bits - top)) * np.uint64(n_ranges) >> np.uint64(top)).astype(np.int64)


def hash_answers(lists: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """(number of hashes, flags) for each chunk's hashes in one range: whether another chunk has one, and whether it is hot."""
    values, hot = [], []
    for _, blob in lists:
        end = 4 + int.from_bytes(blob[:4], "little")
        values.append(unpacked(blob[end:]))
        hot.append(np.zeros(len(values[-1]), bool))
        hot[-1][np.frombuffer(blob[4:end], "<u4")] = True
    every, hot_ = np.concatenate(values), np.concatenate(hot)
    _, place, count = np.unique(every, return_inverse=True, return_counts=True)
    twin = (count > 1)[place]
    if hot_.any():
        any_hot = np.zeros(len(count), bool)
        any_hot[place[hot_]] = True
        hot_ = any_hot[place]
    ends = np.cumsum([0, *map(len, values)]).tolist()
    return [(b - a, flagged(twin[a:b], hot_[a:b])) for a, b in zip(ends, ends[1:])]


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of numbers, in the same order."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their bytes, and each row's rank among the distinct ones."""
    words = words_of(rows)
    order = np.lexsort(words.T[::-1])
    words = words[order]
    rank = np.empty(len(rows), np.uint64)
    rank[order] = np.cumsum(np.r_[False, (words[1:] != words[:-1]).any(axis=1)]) if len(rows) else 0
    return order, rank


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def smaller_exists(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether a row's key is also that of a row of smaller ``order``; rows come by ascending order."""
    if not len(key):
        return np.zeros(0, bool)
    by = np.argsort(key, kind="stable")
    key, order = key[by], order[by]
    new = np.r_[True, key[1:] != key[:-1]]
    least = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # the first of each run of equal keys
    out = np.empty(len(key), bool)
    out[by] = order > least
    return out


def window_marks(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each row (see ROW) and shift k, whether the window k bytes before its tuple occurs with a smaller ``order``.

    Rows come by ascending order.
    """
    out = np.zeros((len(rows), SIDE + 1), bool)
    if len(rows) < 2:
        return out
    left, right, has = rows[:, TUPLE : TUPLE + SIDE], rows[:, TUPLE + SIDE : -2], rows[:, -2:].astype(np.int64)
    suffix = [ranked(rows[:, :TUPLE])[1]]  # names of the sampled suffixes of TUPLE + j bytes
    for j in range(SIDE):
        suffix.append(_dense(suffix[-1] << np.uint64(8) | right[:, j]))
    before = np.zeros(len(rows), np.uint64)  # names of the k bytes before
    for k in range(SIDE + 1):
        if k:
            before = _dense(left[:, SIDE - k].astype(np.uint64) << np.uint64(32) | before)
        valid = np.flatnonzero((has[:, 0] >= k) & (has[:, 1] >= SIDE - k))
        if len(valid) > 1:
            out[valid, k] = smaller_exists(before[valid] << np.uint64(32) | suffix[SIDE - k][valid], order[valid])
    return out


class Strings:
    """Rows of bytes of a chunk: sorted and distinct, with the way back, in parts that are sent."""

    def __init__(self, rows: np.ndarray, part_of: Callable[[np.ndarray], np.ndarray]):
        order, rank = ranked(rows)
        self.place = rank.astype(np.int64)
        first = order[np.flatnonzero(np.r_[True, np.diff(self.place[order]) > 0])] if len(rows) else order
        self.distinct = rows[first]
        self.part = part_of(self.distinct)
        self.by_part = np.argsort(self.part, kind="stable")

    def parts(self) -> Iterator[tuple[int, bytes]]:
        of = self.part[self.by_part]
        edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else []
        for a, b in zip(edges[:-1], edges[1:]):
            yield int(of[a]), front_coded(self.distinct[self.by_part[a:b]])

    def flags(self, answers: list[dict], width: int) -> np.ndarray:
        """The answers (a row of ``width`` flags each) for each of the rows."""
        found = [unflagged(part["flags"], part["n"] * width)[0].reshape(-1, width) for part in sorted(answers, key=lambda x: x["k"])]
        out = np.zeros((len(self.distinct), width), bool)
        if sum(map(len, found)) != len(out):
            raise RuntimeError("a chunk's strings and their answers differ: the chunk table changed meanwhile")
        if found:
            out[self.by_part] = np.concatenate(found)
        return out[self.place]


def front_coded(rows: np.ndarray) -> bytes:
    """Sorted rows as the lengths of the prefixes they share with the row before and the bytes behind these, compressed."""
    shared = np.zeros(len(rows), np.uint8)
    shared[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
    rest = rows[np.arange(rows.shape[1]) >= shared[:, None]]
    small = zstandard.ZstdCompressor(level=3).compress(shared.tobytes() + rest.tobytes())
    return b"".join(n.to_bytes(4, "little") for n in (len(rows), rows.shape[1], len(rest))) + small


def front_decoded(blob: bytes) -> np.ndarray:
    n, width, n_rest = (int(x) for x in np.frombuffer(blob[:12], "<u4"))
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[12:], max_output_size=n + n_rest), np.uint8)
    own = np.arange(width) >= data[:n, None]
    at = np.cumsum(own.ravel()).reshape(n, width) - 1  # of each own byte among the rest
    row = np.maximum.accumulate(np.where(own, np.arange(n)[:, None], 0), axis=0)  # that a byte is taken from
    return data[n:][at[row, np.arange(width)]]


def string_answers(lists: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """(number of rows, flags) for each chunk's rows in one part; ``lists`` come by ascending order of the chunks.

    A list's first number is its chunk's order, and chunks of one order are pieces of one id.
    """
    rows = [front_decoded(blob) for _, blob in lists]
    ends = np.cumsum([0, *map(len, rows)]).tolist()
    order = np.repeat(np.array([o for o, _ in lists], np.int64), np.diff(ends))
    every = np.concatenate(rows)
    if every.shape[1] == ROW:
        flags = window_marks(every, order)
    else:
        flags = smaller_exists(ranked(every)[1], order)[:, None]
    return [(b - a, flagged(flags[a:b].ravel())) for a, b in zip(ends, ends[1:])]


def _meet(answer: Callable[[list[tuple[int, bytes]]], list[tuple[int, bytes]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers to rows (k, first, chunk, blob) sorted by k and first."""
        now, chunks, lists = None, [], []

        def done() -> pa.RecordBatch:
            found = answer(lists)
            columns = [pa.array(chunks, pa.int64()), pa.array([now] * len(chunks), pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], ["chunk", "k", "n", "flags"])

        for batch in batches:
            for k, first, chunk, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != now:
                    if chunks:
                        yield done()
                    now, chunks, lists = k, [], []
                chunks.append(chunk)
                lists.append((first, blob))
        if chunks:
            yield done()

    return run


def _sampled(data: bytes, n: int) -> list[bytes]:
    """A few tuples of a chunk."""
    step = max(1, len(data) // max(1, n))
    return [data[k : k + TUPLE] for k in range(step // 2, len(data) - TUPLE, step)][:n]


def _chunked(batches: Iterator[pa.RecordBatch], chunk_bytes: int, n_sampled: int) -> Iterator[pa.RecordBatch]:
    """Chunk rows of rows (id, text) sorted by id.

    The rows of an id that are too many for a chunk, and those of a task's first
    and last id, which other tasks may have too, go into chunks of that id alone;
    so two chunks share an id only if either holds nothing else.
    """
    number = TaskContext.get().partitionId() << 24  # type: ignore[union-attr]
    names = ["chunk", "first", "ids", "lengths", "digests", "sampled", "data"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary()]

    def made(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        nonlocal number
        number += 1
        data = b"".join(texts)
        digests = [hashlib.sha256(t).digest() for t in texts]
        row = [number, ids[0], ids, [len(t) for t in texts], digests, _sampled(data, n_sampled), zstandard.ZstdCompressor(level=3).compress(data)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    ids: list[int] = []
    texts: list[bytes] = []  # of ids that are whole
    mine: list[bytes] = []  # of the present id
    size = mine_size = 0
    now, alone = None, True  # the task's first id stays alone
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            if i != now:
                if now is not None and not alone:
                    ids += [now] * len(mine)
                    texts += mine
                    size += mine_size
                elif mine:
                    yield made([now] * len(mine), mine)
                alone = now is None
                now, mine, mine_size = i, [], 0
                if size >= chunk_bytes:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
            if mine and mine_size + len(data) > chunk_bytes:
                if ids:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
                yield made([now] * len(mine), mine)
                alone, mine, mine_size = True, [], 0
            mine.append(data)
            mine_size += len(data)
    if ids:
        yield made(ids, texts)
    if mine:
        yield made([now] * len(mine), mine)


def _loaded(row: dict) -> Chunk:
    lengths = np.array(row["lengths"], np.int64)
    data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=int(lengths.sum()) + 1)
    return Chunk(np.array(row["ids"], np.int64), lengths, np.frombuffer(data, np.uint8), row["copies"] or [])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _sent(of: Callable[[Chunk, dict], Iterator[tuple[int, bytes]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            parts = list(of(_loaded(row), row))
            columns = [pa.array([k for k, _ in parts], pa.int64()), pa.array([row["first"]] * len(parts), pa.int64()), pa.array([row["chunk"]] * len(parts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([b for _, b in parts], pa.binary())], ["k", "first", "chunk", "blob"])

    return run


class Left:
    """What a chunk sends of the tuples that occur in several documents: rows of anchors, and windows of hot tuples."""

    def __init__(self, chunk: Chunk, answers: list[dict], bits: int, most: int, splitters: np.ndarray, sub: int):
        self.chunk = chunk
        samples = chunk.samples()
        twin, hot = Hashes(chunk, samples, TUPLE, bits, most).flags(answers)
        self.at, self.starts = samples[twin & ~hot], chunk.windows(samples[twin & hot])
        n_parts = (len(splitters) + 1) * sub

        def mixed(rows: np.ndarray, n: int) -> np.ndarray:
            words = words_of(rows)
            h = words[:, 0].copy()
            for k in range(1, words.shape[1]):
                h = (h ^ h >> _TURN) * _MIX ^ words[:, k]
            return ((h * _MIX >> np.uint64(32)) % np.uint64(n)).astype(np.int64)

        def of_tuple(rows: np.ndarray) -> np.ndarray:
            tuples = np.ascontiguousarray(rows[:, :TUPLE])
            place = np.searchsorted(splitters, tuples.view(f"S{TUPLE}").ravel(), side="right")
            return place * sub + (mixed(tuples, sub) if sub > 1 else 0)

        self.rows = chunk.anchors(self.at)
        self.anchors = Strings(self.rows, of_tuple)
        self.window_rows = chunk.padded(0, LENGTH)[self.starts]
        self.windows = Strings(self.window_rows, lambda rows: n_parts + mixed(rows, n_parts))
        self.n_parts = n_parts

    def parts(self) -> Iterator[tuple[int, bytes]]:
        yield from self.anchors.parts()
        yield from self.windows.parts()

    def marked(self, answers: list[dict]) -> np.ndarray:
        """Starts of the windows that occur in a smaller document."""
        chunk = self.chunk
        rank = chunk.rank[chunk.doc]
        mine = window_marks(self.rows, rank[self.at])
        mine |= self.anchors.flags([a for a in answers if a["k"] < self.n_parts], SIDE + 1)
        place, shift = np.nonzero(mine)
        whole = smaller_exists(ranked(self.window_rows)[1], rank[self.starts])
        whole |= self.windows.flags([a for a in answers if a["k"] >= self.n_parts], 1)[:, 0]
        return np.unique(np.concatenate([self.at[place] - shift, self.starts[whole]]))


def covered(chunk: Chunk, marked: np.ndarray) -> np.ndarray:
    """Whether each byte lies in a marked window, or in a whole copy."""
    step = np.zeros(len(chunk.data) + 1, np.int32)
    step[marked] += 1
    np.subtract.at(step, marked + LENGTH, 1)
    return (np.cumsum(step[:-1]) > 0) | (chunk.copy & (chunk.lengths >= LENGTH))[chunk.doc]


def _results(chunk: Chunk, gone: np.ndarray, with_text: bool) -> pa.RecordBatch:
    n_removed, n_spans, digests, spans, texts = [], [], [], [], []
    for start, length in zip(chunk.starts.tolist(), chunk.lengths.tolist(), strict=True):
        mask, data = gone[start : start + length], chunk.data[start : start + length]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
        kept = data[~mask].tobytes()
        n_removed.append(int(mask.sum()))
        n_spans.append(len(edge) // 2)
        digests.append(hashlib.sha256(kept).hexdigest())
        spans.append(",".join(f"{a}:{b}" for a, b in edge.reshape(-1, 2).tolist()))
        texts.append(kept)
    columns = [pa.array(chunk.ids), pa.array(chunk.lengths), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    if with_text:
        columns, names = [*columns, pa.array(texts, pa.binary())], [*names, "kept"]
    return pa.RecordBatch.from_arrays(columns, names)


def _sizes(total: int) -> tuple[int, int, int, int, int]:
    """Ranges of hashes, bytes of a chunk, ranges of tuples, and of these those between splitters and those by a hash within them."""
    growth = max(1.0, math.sqrt(total / 2e9))
    chunk_bytes = int(min(MOST_CHUNK_BYTES, CHUNK_BYTES * growth))
    n_ranges = max(4, int(total / min(MOST_RANGE_BYTES, RANGE_BYTES * growth)))
    n_tuple_ranges = max(8, -(-total // TUPLE_RANGE_BYTES))
    n_splits = min(SPLITTERS, n_tuple_ranges)
    return n_ranges, chunk_bytes, n_tuple_ranges, n_splits, -(-n_tuple_ranges // n_splits)


def _sampled_tuples(total: int) -> int:
    """Tuples of a chunk that are sampled for splitters."""
    _, chunk_bytes, _, n_splits, _ = _sizes(total)
    return max(1, min(64, -(-n_splits * SAMPLES_A_SPLITTER * chunk_bytes // max(1, total))))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """A row for each document: id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    ``spans`` are the removed byte ranges; ``with_text`` adds the remaining
    bytes as ``kept``. The id is an integer column.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "substrings")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_null, total = rows.agg(F.count(F.when(F.col("id").isNull(), 1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunk_bytes = _sizes(total)[1]
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string" + ", kept binary" * with_text

    n_parts = max(4, -(-total // (4 * chunk_bytes)))
    n_sampled = _sampled_tuples(total)
    dealt = rows.where("id is not null").repartitionByRange(n_parts, "id", F.xxhash64("text")).sortWithinPartitions("id")
    made = dealt.mapInArrow(
        lambda b: _chunked(b, chunk_bytes, n_sampled),
        "chunk long, first long, ids array<long>, lengths array<long>, digests array<binary>, sampled array<binary>, data binary",
    )
    # a table bucketed by chunk, so that joins with it move only the other side
    name = f"chunks_{uuid.uuid4().hex}"
    try:
        made.write.bucketBy(n_parts, "chunk").option("path", work.path("chunks")).saveAsTable(name)
        del made, dealt
        release(spark)
        out = _removed(spark.table(name), work, total, schema, with_text)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    work.keep("results")
    if n_null:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text in batch.column(1).to_pylist():
                    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                    made = _results(Chunk(np.zeros(1, np.int64), np.array([len(data)]), data, []), np.zeros(len(data), bool), with_text)
                    yield made.set_column(0, "id", pa.array([None], pa.int64()))

        out = out.union(rows.where("id is null").mapInArrow(trimmed(whole), schema))
    return out.withColumnRenamed("id", id_col)


def _removed(chunks: DataFrame, work: Workspace, total: int, schema: str, with_text: bool) -> DataFrame:
    """The results of all chunks."""
    spark = work.spark
    n_ranges, chunk_bytes, n_tuple_ranges, n_splits, sub = _sizes(total)
    n_sampled = _sampled_tuples(total)
    bits = HASH_BITS or min(64, max(32, (total // 5 + 1).bit_length() + 8))
    most = HOT

    sampled = chunks.select("chunk", F.explode("sampled").alias("s"))
    share = min(1.0, 2 * n_splits * SAMPLES_A_SPLITTER * chunk_bytes / max(1, total * n_sampled))  # bounds what is collected
    sampled = sampled.where(F.pmod(F.xxhash64("chunk", "s"), F.lit(1 << 30)) < int(share * (1 << 30)))
    tuples = np.sort(np.array([bytes(r.s) for r in sampled.select("s").collect()], f"S{TUPLE}"))
    splitters = np.unique(tuples[np.arange(1, n_splits) * len(tuples) // n_splits]) if len(tuples) else tuples

    apart = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "digests")).alias("at", "x"))
    apart = apart.select("chunk", "at", F.col("x.ids").alias("id"), F.col("x.digests").alias("digest"))
    first = apart.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "least")
    first = work.save(first, "first")  # so that the join below is plain, and Spark can split a digest of many copies
    copies = apart.join(first, (F.col("digest") == F.col("d")) & (F.col("id") > F.col("least")))
    copies = work.save(copies.groupBy(F.col("chunk").alias("c0")).agg(F.collect_list("at").alias("copies")), "copies")

    def joined(*others: DataFrame) -> DataFrame:
        out = chunks.select("chunk", "first", "ids", "lengths", "data")
        for k, other in enumerate(others):
            out = out.join(other.hint("shuffle_hash"), F.col("chunk") == F.col(f"c{k}"), "left").drop(f"c{k}")
        return out

    def met(sent: DataFrame, answer, parts: int, k: int) -> DataFrame:
        dealt = sent.repartition(max(4, parts), "k").sortWithinPartitions("k", "first", "chunk")
        found = dealt.mapInArrow(trimmed(_meet(answer)), "chunk long, k long, n int, flags binary")
        found = found.groupBy(F.col("chunk").alias(f"c{k}")).agg(F.collect_list(F.struct("k", "n", "flags")).alias(f"answers{k}"))
        return work.save(found, f"answers{k}")

    def hashes(chunk: Chunk, row: dict) -> Iterator[tuple[int, bytes]]:
        return Hashes(chunk, chunk.samples(), TUPLE, bits, most).parts(n_ranges)

    def left(chunk: Chunk, row: dict) -> Left:
        return Left(chunk, row["answers1"] or [], bits, most, splitters, sub)

    sent = "k long, first long, chunk long, blob binary"
    one = met(joined(copies).mapInArrow(trimmed(_sent(hashes)), sent), hash_answers, n_ranges // 4, 1)
    release(spark)
    two = met(joined(copies, one).mapInArrow(trimmed(_sent(lambda chunk, row: left(chunk, row).parts())), sent), string_answers, n_tuple_ranges, 2)
    release(spark)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = _loaded(row)
            yield _results(chunk, covered(chunk, left(chunk, row).marked(row["answers2"] or [])), with_text)

    return work.save(joined(copies, one, two).mapInArrow(trimmed(final), schema), "results")


#: The query in DuckDB, window by window.
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (SELECT rn, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT rn, doc_id, h, unnest(range(length(h) // 2 - 49)) AS i FROM d WHERE doc_id IS NOT NULL)
), least_of AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s
), hit AS (SELECT rn, i, lag(i) OVER (PARTITION BY rn ORDER BY i) AS p FROM w JOIN least_of USING (s) WHERE m < doc_id
), grouped AS (SELECT rn, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rn ORDER BY i) AS g FROM hit
), span AS (SELECT rn, min(i) AS a, max(i) + 50 AS b FROM grouped GROUP BY rn, g
), piece AS (SELECT rn, a, b, coalesce(lag(b) OVER (PARTITION BY rn ORDER BY a), 0) AS p FROM span
), cut AS (SELECT rn, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS e, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS body,
    string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM piece JOIN d USING (rn) GROUP BY rn)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN e IS NULL THEN h ELSE body || substr(h, 2 * e + 1) END)) AS kept_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN cut USING (rn)
"""
