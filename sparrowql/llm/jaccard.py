"""SimHash near-dedup of whole texts at a Jaccard similarity, with pivot distance tables.

Two texts link where the sets of their ``WIDTH``-word shingles (64-bit hashes,
words as in ``simhash.fingerprint``) have a Jaccard similarity of ``SIMILAR`` or
more. Distinct sets are the points; copies are never expanded. 64 bits are too
few for such pairs, which differ in about ten of them, so a point has a SimHash
of 64 * ``LONG`` bits.

1. Cells: ``BANDS`` short fingerprints a point, each of ``ROWS`` minima of the
   hashes under a permutation of its own; points meet in cells of one short
   fingerprint. A pair at similarity s is missed by all with a chance of
   (1 - s ** ROWS) ** BANDS, 6e-7 at 0.8 and less above.
2. Stars: each point of a cell meets the cell's least one, which joins large
   families at a linear cost.
3. Pivot tables: for the points of a cell that aren't yet in one part, distances
   to ``REFERENCES`` reference fingerprints are computed once; a pair whose
   coordinates differ by more than ``RADIUS`` somewhere, or whose own distance is
   larger, is discarded. (At 0.8 the distance is 39 bits with a deviation of
   5.7, so a pair is lost with a chance of 1e-8; sets under ``SURE`` shingles
   skip this test.) Survivors aren't written out: a cell gives a spanning forest
   of them, and the components of all forests are the families.
4. Verification: every pair of a family in different parts is verified on the
   whole sets. A family goes to its task by blocks, the blocks of its largest
   part meeting those of the others alone, and again only forests come out.
   Stars are verified pair by pair. Components of all links are the classes.

So rows grow with points, not with pairs, whatever the size of a group; the work
within tasks still grows with the square of a family that stars can't join. Sets
have names of 64 bits: among n different ones the chance of one false merge is
under n * n / 2 ** 65.

Cases: a text of fewer words than ``WIDTH`` is one shingle; null texts and those
without words are one point; repeated rows and null ids are rows of their own;
of equal ids the class keeps any one row; an empty table gives an empty table;
other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparrowql.llm.graph import connected_components, forest
from sparrowql.llm.shared import Workspace, release, slices, trimmed, with_fields
from sparrowql.llm.simhash import SEED, survivors

WIDTH = 5
#: Least similarity of a link, as a fraction of integers.
SIMILAR = (4, 5)
BANDS, ROWS = 20, 3
#: Words of a long fingerprint, the bits by which linked ones may differ, and the least sets that it judges.
LONG, RADIUS, SURE = 4, 74, 64
REFERENCES = 16
#: Points of a cell, and points and shingles of a family's block, that a task compares at once.
CELL, BLOCK_POINTS, BLOCK_SHINGLES = 4096, 512, 1_000_000
#: Hashes of a text that are permuted at once, pairs kept before they become a forest, and columns of a product.
PART, PAIRS, COLUMNS = 8192, 2_000_000, 4096
#: Hashes of texts that are broadcast at most; beyond that texts are found by a plain join.
WANTED = 500_000

_P = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(23)
_FLIP = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)
_LONG_FLIP = _RNG.integers(0, 1 << 64, LONG, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - WIDTH + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends.tolist()]
    stops = (ends - 1).tolist()
    last = min(WIDTH, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n], stops[last:], strict=False)), np.uint64, n))


def point(text: str | None) -> int:
    """The name of a text's set of shingles."""
    return xxhash.xxh64_intdigest(shingles(text).tobytes(), SEED)


def bands(found: np.ndarray) -> np.ndarray:
    """The fingerprints of a set; none of an empty one."""
    if not len(found):
        return found
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), PART):
        np.minimum(least, ((found[k : k + PART] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    mixed = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    return (mixed ^ np.arange(BANDS, dtype=np.uint64)) * _P


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def long_fingerprint(found: np.ndarray) -> np.ndarray:
    """LONG words of SimHash: a bit is 1 if set in over half the mixed hashes."""
    out = np.zeros(LONG, np.uint64)
    for k in range(LONG):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(found), PART):
            x = (found[at : at + PART] ^ _LONG_FLIP[k]) * _P
            x ^= x >> np.uint64(31)
            x *= _TIMES[k, 0]
            x ^= x >> np.uint64(32)
            votes += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
        out[k] = np.packbits(2 * votes > len(found)).view(np.uint64)[0]
    return out


def with_bands(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _fp, _size, _bands, _long, _text) of each row; _fp names the set, and _text is a hash of the text."""
    schema = with_fields(docs.select(id_col).schema, _fp="long", _size="int", _bands="array<long>", _long="array<long>", _text="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[1]):
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
                sizes = pa.array([len(s) for s in sets], pa.int32())
                made = [_lists([bands(s) for s in sets]), _lists([long_fingerprint(s) for s in sets])]
                columns = [part.column(0), pa.array(names.view(np.int64)), sizes, *made, part.column(2)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("_text")).mapInArrow(trimmed(run), schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, s): the name and the set of each text in rows (text), each name once a task."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, batch.schema.names[0]):
            new = {}
            for text in part.column(0).to_pylist():
                found = shingles(text)
                name = xxhash.xxh64_intdigest(found.tobytes(), SEED)
                if name not in seen:
                    seen.add(name)
                    new[name] = found
            names = np.array(list(new), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), _lists(list(new.values()))], ["p", "s"])


def may_link(low, high):
    """Whether sets of these sizes, the less first, can link at all."""
    return low * SIMILAR[1] >= high * SIMILAR[0]


def distances(long: np.ndarray, i, j) -> np.ndarray:
    """Differing bits of the long fingerprints in rows i and j."""
    return np.bitwise_count(long[i] ^ long[j]).sum(axis=-1, dtype=np.int16)


def cell_pairs(cells: np.ndarray, parts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell that are in different parts and can link.

    Rows are sorted by cell and size.
    """
    n = len(cells)
    begin = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    several = np.minimum.reduceat(parts, begin) != np.maximum.reduceat(parts, begin)
    count = np.diff(np.append(begin, n))
    end = np.repeat(begin + count, count)
    rows = np.flatnonzero(np.repeat(several, count))
    offset = 1
    while len(rows):
        rows = rows[rows + offset < end[rows]]
        rows = rows[may_link(sizes[rows], sizes[rows + offset])]  # sizes only grow from there
        apart = rows[parts[rows] != parts[rows + offset]]
        if len(apart):
            yield apart, apart + offset
        offset += 1


class Forest:
    """The least row of each row's tree, from pairs that come bit by bit."""

    def __init__(self, n: int):
        self.label, self.i, self.j, self.total = np.arange(n), [], [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.i.append(i)
        self.j.append(j)
        self.total += len(i)
        if self.total >= PAIRS:
            self.grow()

    def grow(self) -> None:
        n = len(self.label)
        self.label = forest(n, np.concatenate([np.arange(n), *self.i]), np.concatenate([self.label, *self.j]))
        self.i, self.j, self.total = [], [], 0

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        self.grow()
        node = np.flatnonzero(self.label != np.arange(len(self.label)))
        return node, self.label[node]


def near_rows(cells: np.ndarray, parts: np.ndarray, sizes: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (row, row) of the pairs in cells that pivot tables and fingerprints leave.

    Rows are sorted by cell and size; ``long`` has a long fingerprint a row.
    """
    n = len(cells)
    references = np.linspace(0, n - 1, min(n, REFERENCES)).astype(np.int64)
    table = [distances(long, slice(None), r) for r in references]
    found = Forest(n)
    for i, j in cell_pairs(cells, parts, sizes):
        few = sizes[i] < SURE
        found.add(i[few], j[few])
        i, j = i[~few], j[~few]
        for column in table:
            left = np.abs(column[i] - column[j]) <= RADIUS
            i, j = i[left], j[left]
        left = distances(long, i, j) <= RADIUS
        found.add(i[left], j[left])
    return found.edges()


def linked_rows(parts: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (row, row) of the sets in different parts that link, by products of membership matrices."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    kept = shared[place]
    column, owner = number[place[kept]], owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((n, n), np.float32)  # exact: whole numbers under 2 ** 24
    edges = np.searchsorted(column, np.arange(0, int(shared.sum()) + COLUMNS, COLUMNS))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        member = np.zeros((n, COLUMNS), np.float32)
        member[owner[a:b], column[a:b] % COLUMNS] = 1
        common += member @ member.T
    # c / (total - c) >= 4 / 5
    linked = common * (SIMILAR[0] + SIMILAR[1]) >= (sizes[:, None] + sizes) * SIMILAR[0]
    i, j = np.nonzero(np.triu(linked & (parts[:, None] != parts), 1))
    found = Forest(n)
    found.add(i, j)
    return found.edges()


def _by_key(batches: Iterator[pa.RecordBatch], most_rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, joined and cut so that no key goes over two."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        keys = batch.column(0)
        if rows < most_rows and (len(held) > 1 or keys[0].as_py() == keys[-1].as_py()):
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        names = whole.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(names, names[-1]))  # the last key may go on
        if cut:
            yield whole.slice(0, cut)
        held, rows = [whole.slice(cut)], whole.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of points in rows (key, size, point, part, long) sorted by key and size."""
    for batch in _by_key(batches):
        keys, sizes, points, parts = _numbers(batch, "key", "size", "point", "part")
        long = batch.column("long").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, LONG)
        i, j = near_rows(keys, parts, sizes.astype(np.int64), long)
        yield pa.RecordBatch.from_arrays([pa.array(points[i]), pa.array(points[j])], ["a", "b"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of linked parts in rows (key, part, set) sorted by key."""
    for batch in _by_key(batches, 1):
        keys, parts = _numbers(batch, "key", "part")
        lists = batch.column("set")
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True):
            if b - a > 1:
                i, j = linked_rows(parts[a:b], [values[ends[k] : ends[k + 1]] for k in range(a, b)])
                yield pa.RecordBatch.from_arrays([pa.array(parts[a + i]), pa.array(parts[a + j])], ["a", "b"])


def _with_sets(wanted: DataFrame, docs: DataFrame, text_col: str, work: Workspace, label: str) -> DataFrame:
    """(p, s) of the points in ``wanted`` (fp, t: a hash of one of its texts); sets are made again from the texts."""
    wanted = work.save(wanted, f"wanted-{label}")
    texts = wanted.select("t").distinct()
    if wanted.count() <= WANTED:
        texts = F.broadcast(texts)
    found = docs.select(F.col(text_col).alias("text")).join(texts, F.xxhash64("text") == F.col("t"), "left_semi")
    found = found.mapInArrow(trimmed(_sets), "p long, s array<long>")
    found = found.join(wanted, F.col("p") == F.col("fp"), "left_semi").dropDuplicates(["p"])
    return work.save(found, f"sets-{label}")


def _verified(pairs: DataFrame, docs: DataFrame, points: DataFrame, text_col: str, work: Workspace) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    pairs = work.save(pairs.distinct(), "stars")
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()
    wanted = points.join(wanted, F.col("fp") == F.col("w"), "left_semi").select("fp", F.col("text").alias("t"))
    sets = _with_sets(wanted, docs, text_col, work, "stars")
    left, right = (sets.select(F.col("p").alias(f"p{k}"), F.col("s").alias(f"s{k}")) for k in "ab")
    both = pairs.join(left, F.col("a") == F.col("pa")).join(right, F.col("b") == F.col("pb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    links = both.where(common * (SIMILAR[0] + SIMILAR[1]) >= (F.size("sa") + F.size("sb")).cast("long") * SIMILAR[0])
    links = work.save(links.select("a", "b"), "star-links")
    work.drop("sets-stars")
    release(work.spark)
    return links


def _may_be_near(a: str, b: str):
    """Whether points of these columns (size, long) can link, by sizes and fingerprints."""
    low, high = F.least(f"size{a}", f"size{b}").cast("long"), F.greatest(f"size{a}", f"size{b}").cast("long")
    far = sum((F.bit_count(F.get(f"long{a}", k).bitwiseXOR(F.get(f"long{b}", k))) for k in range(LONG)), F.lit(0))
    return may_link(low, high) & ((low < SURE) | (far <= RADIUS))


def _family_links(cells: DataFrame, docs: DataFrame, points: DataFrame, text_col: str, work: Workspace) -> DataFrame:
    """Edges (a, b) between linked parts, from rows (cell, size, point, part, long)."""
    open_ = cells.groupBy("cell").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.count(F.lit(1)).alias("n"))
    open_ = open_.where("p0 <> p1").select(F.col("cell").alias("c"), F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
    cells = cells.join(open_, F.col("cell") == F.col("c"))
    # a cell of several blocks is compared by pairs of blocks
    cells = cells.withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))
    dealt = cells.select(key.alias("key"), "size", "point", "part", "long").repartition(F.col("key")).sortWithinPartitions("key", "size")
    families = connected_components(work.save(dealt.mapInArrow(trimmed(_families), "a long, b long"), "near"), work, "families")
    families = families.select(F.col("node").alias("member"), F.col("component").alias("family"))
    parts = work.save(cells.select("point", "part").distinct(), "open-parts")
    told = points.select("fp", F.col("text").alias("t"), "size")
    members = families.join(parts, F.col("member") == F.col("point")).join(told, F.col("member") == F.col("fp")).select("family", "part", "fp", "t", "size")
    members = work.save(members, "members")
    sizes = members.groupBy("family", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_POINTS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES), F.lit(0)).cast("int")
    largest = Window.partitionBy("family").orderBy(F.desc("n"), "part")
    sizes = sizes.withColumn("main", F.row_number().over(largest) == 1)
    main = sizes.where("main").groupBy(F.col("family").alias("f0"), F.col("part").alias("main")).agg(blocks.alias("main_blocks"))
    rest = sizes.where("not main").groupBy(F.col("family").alias("f1")).agg(blocks.alias("rest_blocks"))
    dealt = members.join(main, F.col("family") == F.col("f0")).join(rest, F.col("family") == F.col("f1"))
    # blocks of the largest part have numbers from 0 on, the others' follow; the former never meet each other
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("part") == F.col("main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("part") == F.col("main"), mine).otherwise(F.col("main_blocks") + mine))
    last = F.col("main_blocks") + F.col("rest_blocks") - 1
    first = F.when(F.col("part") == F.col("main"), F.col("main_blocks")).otherwise(F.lit(0))
    dealt = dealt.withColumn("other", F.explode(F.sequence(first, last)))
    key = F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other"))
    dealt = dealt.select(key.alias("key"), F.col("fp").alias("point"), "part")
    sets = _with_sets(members.select("fp", "t"), docs, text_col, work, "families")
    dealt = dealt.join(sets, F.col("point") == F.col("p")).select("key", "part", F.col("s").alias("set"))
    dealt = dealt.repartition(F.col("key")).sortWithinPartitions("key")
    return work.save(dealt.mapInArrow(trimmed(_links), "a long, b long"), "family-links")


def jaccard_classes(docs: DataFrame, id_col: str, text_col: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(id, _fp) of each row, and (fp, class, _component) of each distinct set."""
    marked = work.save(with_bands(docs, id_col, text_col), "bands")
    points = marked.groupBy(F.col("_fp").alias("fp")).agg(
        F.min(id_col).alias("least"), F.min("_text").alias("text"), F.first("_size").alias("size"), F.first("_bands").alias("bands"), F.first("_long").alias("long")
    )
    points = work.save(points, "points")
    # most cells hold one point: they go before sizes and fingerprints are looked up
    cells = points.select(F.explode("bands").alias("cell"), F.col("fp").alias("point"))
    heads = cells.groupBy("cell").agg(F.min("point").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("cell").alias("c"), "a")
    cells = work.save(cells.join(heads, F.col("cell") == F.col("c")).drop("c"), "shared-cells")
    release(work.spark)
    told = points.select(F.col("fp").alias("p"), "size", "long")
    cells = cells.join(told, F.col("point") == F.col("p")).drop("p")
    cells = work.save(cells.join(told.toDF("p", "size_a", "long_a"), F.col("a") == F.col("p")).drop("p"), "cells")
    release(work.spark)
    stars = cells.where("point <> a").withColumnsRenamed({"size": "size_b", "long": "long_b"}).where(_may_be_near("_a", "_b"))
    links = _verified(stars.select("a", F.col("point").alias("b")), docs, points, text_col, work)
    parts = work.save(connected_components(links, work, "parts"), "part-names")
    cells = cells.join(parts, F.col("point") == F.col("node"), "left").select("cell", "size", "point", F.coalesce("component", "point").alias("part"), "long")
    joined = connected_components(_family_links(cells, docs, points, text_col, work), work).toDF("n1", "whole")
    named = points.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    named = named.join(joined, F.col("part") == F.col("n1"), "left").select("fp", "least", F.coalesce("whole", "part").alias("class"))
    named = work.save(named, "named")
    least = named.groupBy("class").agg(F.min("least").alias("_component")).withColumnRenamed("class", "d")
    classes = work.save(named.join(least, F.col("class") == F.col("d")).select("fp", "class", "_component"), "classes")
    work.keep("bands", "classes")
    release(work.spark)
    return marked.select(id_col, "_fp"), classes


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, one of each class: a row of its least id.

    A class without any id keeps one of its rows.
    """
    marked, classes = jaccard_classes(docs, id_col, text_col, Workspace(docs.sparkSession, "jaccard"))
    return survivors(docs, marked, classes, point, id_col, text_col)


def stage(spark, docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate class."""
    return near_dedup(docs).select(*docs.columns)
