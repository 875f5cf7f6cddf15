"""SimHash near-dedup with pivot distance tables.

Fingerprints are 64-bit SimHashes of word shingles. Distinct fingerprints are
the points; copies are never expanded. Two points link at ``RADIUS`` or fewer
differing bits. As a pair differs in 3 bits at most, it agrees in a whole
block of any 4 into which the bits are cut, so points meet in cells of equal
blocks; a cell with more than ``MAX_CELL`` points is cut again by four blocks
of the bits that are left, until cells are small (distinct points in a cell are
at most 2 ** free bits), so no pair is lost and no task meets a large group.

Within a cell, a table of precomputed Hamming distances to ``PIVOTS`` reference
fingerprints discards pairs: for each pivot p, |d(x, p) - d(y, p)| is at most
d(x, y), so a pair whose largest coordinate difference is over the radius
can't link. Survivors are verified on the fingerprints. A cell yields a
spanning forest of its links, not all its pairs, and connected components over
the forests' edges give the classes.

Cases: a null text or one without words has fingerprint zero, linked like any
other; repeated rows and null ids are rows of their own, and a class of null
ids alone has a null component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowql.llm.graph import connected_components, forest
from sparrowql.llm.shared import Workspace, slices, trimmed, unique_name, with_fields

RADIUS = 3
PIVOTS = 24
#: Points of a cell that are compared in one task.
MAX_CELL = 1000
#: Ids of dropped rows that are broadcast at most; beyond that a plain join drops them.
MOST_GONE = 1_000_000
SEED = 42


def pivot_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers, so about 32 bits apart."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 7) for i in range(n)], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and split know ASCII alone
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends.tolist()]
    stops = (ends - 1).tolist()
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n], stops[last:], strict=False)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        part = hashes[k : k + 65536]
        votes += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row; fp is the fingerprint's bits as a signed long."""
    schema = with_fields(docs.select(id_col).schema, _fp="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = np.array([fingerprint(t) for t in part.column(text_col).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(found.view(np.int64))], schema.names)

    return docs.select(id_col, text_col).mapInArrow(trimmed(run), schema)


def linked_pairs(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those that the pivot table can't discard and that link."""
    for column in table:
        left = np.abs(column[i] - column[j]) <= radius
        i, j = i[left], j[left]
        if not len(i):
            break
    near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
    return i[near], j[near]


def cell_links(cells: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (point, least point of its tree) of a spanning forest in each cell.

    Rows are sorted by cell. All cells are compared at once, at offsets 1, 2, ...
    """
    n = len(fps)
    pivots = pivot_fingerprints()
    table = np.bitwise_count(fps ^ pivots[:, None]).astype(np.int16)
    new = np.r_[True, cells[1:] != cells[:-1]]
    end = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]  # where each row's cell ends
    at, i, j = np.arange(n), [], []
    offset = 1
    rows = at
    while True:
        rows = rows[rows + offset < end[rows]]
        if not len(rows):
            break
        a, b = linked_pairs(fps, table, rows, rows + offset, radius)
        i.append(a)
        j.append(b)
        offset += 1
    if not i:
        return at[:0], at[:0]
    label = forest(n, np.concatenate(i), np.concatenate(j))
    node = np.flatnonzero(label != at)
    return node, label[node]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the cells in rows (cell, fp) that are sorted by cell; a cell may go over batches."""
    rest: list[np.ndarray] = []

    def links(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        node, root = cell_links(cells, fps.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(fps[node]), pa.array(fps[root])], ["a", "b"])

    for batch in batches:
        cells = batch.column(0).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False)
        if rest:
            cells, fps = np.concatenate([rest[0], cells]), np.concatenate([rest[1], fps])
        if not len(cells):
            continue
        cut = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on
        if cut:
            yield links(cells[:cut], fps[:cut])
        rest = [cells[cut:], fps[cut:]]
    if rest and len(rest[0]):
        yield links(*rest)


def _blocks(bits: list[int]) -> list[list[int]]:
    size, more = divmod(len(bits), RADIUS + 1)
    out, at = [], 0
    for k in range(RADIUS + 1):
        n = size + (k < more)
        out.append(bits[at : at + n])
        at += n
    return out


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def link_edges(points: DataFrame, work: Workspace) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all links.

    ``way`` names the blocks that a cell's points share; the cell is a hash of
    the way and the shared bits, kept apart from others by the way itself.
    """
    ways: list[list[int]] = [[]]  # bits fixed, by way
    level = points.select("fp", F.lit(0).alias("way"))
    edges, depth = None, 0
    while True:
        # each point of a way goes on in one cell for each block of the way's free bits
        new_ways, rows = [], []
        for way, fixed in enumerate(ways):
            free = [b for b in range(64) if b not in set(fixed)]
            rows.append([(len(new_ways) + k, _mask(fixed + block)) for k, block in enumerate(_blocks(free))])
            new_ways += [fixed + block for block in _blocks(free)]
        masks = F.array(*[F.array(*[F.struct(F.lit(w).alias("way"), F.lit(m).cast("long").alias("mask")) for w, m in row]) for row in rows])
        cells = level.select("fp", F.explode(F.get(masks, F.col("way"))).alias("x")).select(
            "fp", F.col("x.way").alias("way"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("bits")
        )
        ways, depth = new_ways, depth + 1
        cells = work.save(cells, f"cells-{depth}")
        sizes = cells.groupBy("way", "bits").agg(F.count(F.lit(1)).alias("n"))
        hot = sizes.where(F.col("n") > MAX_CELL).select(F.col("way").alias("w"), F.col("bits").alias("s"))
        hot = work.save(hot, f"hot-{depth}")
        n_hot = hot.count()
        same = (F.col("way") == F.col("w")) & (F.col("bits") == F.col("s"))
        small = cells.join(hot, same, "left_anti") if n_hot else cells
        dealt = small.select(F.xxhash64("way", "bits").alias("cell"), "fp").repartition(F.col("cell")).sortWithinPartitions("cell", "fp")
        found = work.save(dealt.mapInArrow(trimmed(_edges), "a long, b long"), f"edges-{depth}")
        edges = found if edges is None else edges.union(found)
        if not n_hot:
            return edges
        level = work.save(cells.join(hot, same, "left_semi").select("fp", "way"), f"level-{depth}")


def _classes(docs: DataFrame, id_col: str, text_col: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(id, _fp) of each row, and (fp, class, _component) of each distinct fingerprint."""
    marked = work.save(with_fingerprints(docs, id_col, text_col), "fingerprints")
    points = work.save(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min(id_col).alias("least")), "points")
    parts = connected_components(link_edges(points.select("fp"), work), work)
    named = points.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    named = work.save(named, "named")
    least = named.groupBy("class").agg(F.min("least").alias("_component")).withColumnRenamed("class", "d")
    classes = work.save(named.join(least, F.col("class") == F.col("d")).select("fp", "class", "_component"), "classes")
    work.keep("fingerprints", "classes")
    return marked, classes


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, ``_fp`` (signed) and ``_component`` (least id reachable)."""
    marked, classes = _classes(docs, id_col, text_col, Workspace(docs.sparkSession, "simhash"))
    return marked.join(classes, F.col("_fp") == F.col("fp")).select(id_col, "_fp", "_component")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, one of each class: a row of its least id.

    A class without any id keeps one of its rows.
    """
    marked, classes = _classes(docs, id_col, text_col, Workspace(docs.sparkSession, "dedup"))
    return survivors(docs, marked, classes, fingerprint, id_col, text_col)


def survivors(docs: DataFrame, marked: DataFrame, classes: DataFrame, mark: Callable[[str | None], int], id_col: str, text_col: str) -> DataFrame:
    """The rows that ``near_dedup`` keeps.

    ``marked`` and ``classes`` are as of ``_classes``; ``mark`` gives a text's _fp.
    """
    key, fp = unique_name(docs.columns, "_keep"), unique_name(docs.columns, "_fp")
    named = marked.where(F.col(id_col).isNotNull()).join(classes, F.col("_fp") == F.col("fp"))
    gone = named.where(F.col(id_col) != F.col("_component")).select(F.col(id_col).alias(key)).distinct()
    if gone.count() <= MOST_GONE:  # texts needn't move
        gone = F.broadcast(gone)
    kept = docs.where(F.col(id_col).isNotNull()).join(gone, F.col(id_col) == F.col(key), "left_anti")
    # rows that their ids don't name are chosen by class
    nameless = docs.where(F.col(id_col).isNull())
    repeated = marked.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(key)).count().where("count > 1").select(key)
    if repeated.head(1):
        kept = kept.join(repeated, F.col(id_col) == F.col(key), "left_anti")
        nameless = nameless.unionByName(docs.join(repeated, F.col(id_col) == F.col(key), "left_semi"))
    elif not marked.where(F.col(id_col).isNull()).head(1):
        return kept
    schema = with_fields(docs.schema, **{fp: "long"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([mark(t) for t in batch.column(text_col).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], schema.names)

    other, name, least = (unique_name(schema.names, c) for c in ("_other", "_class", "_least"))
    wanted = classes.select(F.col("fp").alias(other), F.col("class").alias(name), F.col("_component").alias(least))
    nameless = nameless.mapInArrow(trimmed(run), schema).join(wanted, F.col(fp) == F.col(other)).where(F.col(id_col).eqNullSafe(F.col(least)))
    return kept.unionByName(nameless.dropDuplicates([name]).select(*docs.columns))
