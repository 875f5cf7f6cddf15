"""Sharding by best-fit-decreasing bin packing, distributed by size classes.

Groups of equal texts are indivisible. Rows are first reduced to groups, groups
to a histogram of size classes (exact up to ``EXACT`` bytes, then ``EXACT``
classes a power of two, so their number is bounded whatever the input). The
packing runs over the histogram in decreasing size: groups of a class are
alike, so the tightest bin that has room, found in a balanced tree, takes as
many as fit at once. Each class becomes a few runs (bin, from rank, to rank),
and a group finds its run by its rank in its class. Ranks are gapless row
numbers made of salted parts, so no class, shard or group is one task's work.

Only a group that no shard can hold, as it is larger than an equal share of all
bytes, is split, by row, into pieces of about an eighth of a share; every other
group stays whole, and shards are as unequal as that makes them. A size over
``EXACT`` counts as its class's upper bound, at most a thousandth more, so the
order within a class is arbitrary and loads may differ by that share.

Cases: a null text counts as empty, has size 1 and is in the group of the empty
text; repeated rows and null ids are rows like any other; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparrowql.llm.shared import Workspace

#: Sizes below this are their own class; above, so many classes a power of two.
EXACT = 1024
#: Rows of one salted part, about, of a class or shard that gets row numbers.
PART_ROWS = 20_000


class Tree:
    """A treap of (room, bin), for the tightest bin with enough room."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.seed = 1

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            node[3] = left
            return node, right
        left, right = self._split(node[2], key)
        node[2] = right
        return left, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key: tuple[int, int]) -> None:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.seed >> 32, None, None]), right)

    def take(self, room: int) -> tuple[int, int] | None:
        """Removes and returns the least key with at least this room."""
        left, right = self._split(self.root, (room, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(right, (node[0][0], node[0][1] + 1))
        self.root = self._merge(left, rest)
        return node[0]


def pack(sizes: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Best-fit-decreasing over (size, count); runs (size, first rank, count, bin).

    None if it takes more than ``most_bins`` bins, or a size is over the capacity.
    """
    tree, bins, runs = Tree(), 0, []
    for size, count in sorted(sizes, reverse=True):
        if size > capacity:
            return None
        rank = 0
        while rank < count:
            found = tree.take(size)
            if found is None:
                if bins == most_bins:
                    return None
                found, bins = (capacity, bins), bins + 1
            n = min(count - rank, found[0] // size)
            runs.append((size, rank, n, found[1]))
            rank += n
            tree.add((found[0] - n * size, found[1]))
    return runs


def pack_into(sizes: list[tuple[int, int]], n_bins: int) -> list[tuple[int, int, int, int]]:
    """Packs into ``n_bins`` bins of the least capacity, to a 2000th, that suffices."""
    total = sum(s * c for s, c in sizes)
    low = max(-(-total // n_bins), max((s for s, _ in sizes), default=1))
    step = max(1, low // 2000)
    capacity = low
    while (runs := pack(sizes, capacity, n_bins)) is None:
        capacity += step
        step = step * 3 // 2 if capacity > low + 20 * step else step
    return runs


def size_class(size: Column) -> Column:
    """The upper bound of a size's class."""
    width = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double") / EXACT))).cast("long")
    return F.when(size <= EXACT, size).otherwise(F.ceil(size / width).cast("long") * width)


def gapless(df: DataFrame, keys: list[str], order: list[Column], salt: Column, rows: int, out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within the keys, ordered by salt and then ``order``.

    Row numbers are made within (keys, salt) and moved by the counts of the
    salts before; the table of counts has a row for each (keys, salt).
    """
    salts = max(64, -(-rows // PART_ROWS))
    df = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    counts = df.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_salt").alias("_k_salt"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)).cast("long") - 1
    df = df.withColumn(out, within)
    same = F.col("_salt") == F.col("_k_salt")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    return df.join(counts, same).withColumn(out, F.col(out) + F.col("_before")).drop("_salt", "_k_salt", "_before", *[f"_k_{k}" for k in keys])


RUNS = T.StructType(
    [T.StructField("_class", T.LongType()), T.StructField("_from", T.LongType()), T.StructField("_to", T.LongType()), T.StructField("_bin", T.IntegerType())]
)


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless in its shard) of each row.

    Sizes are UTF-8 bytes plus 1; shards are nearly equal in bytes.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("_key"),
        F.monotonically_increasing_id().alias("_row"),  # fixed once the rows are written
    )
    rows = work.save(rows, "rows")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = max(1, -(-total // n_shards))
    hot = rows.groupBy("_key").agg(F.sum("size").alias("_bytes")).where(F.col("_bytes") > share)
    hot = hot.select(F.col("_key").alias("_hot"), F.ceil(F.col("_bytes") * 8 / share).cast("int").alias("_pieces"))
    # fewer than n_shards groups can be that large
    rows = rows.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left").withColumn(
        "_piece", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_pieces")), F.lit(0)).cast("int")
    ).drop("_hot", "_pieces")
    groups = rows.groupBy("_key", "_piece").agg(F.sum("size").alias("_bytes"))
    groups = work.save(groups.withColumn("_class", size_class(F.col("_bytes"))), "groups")
    histogram = [(r[0], r[1]) for r in groups.groupBy("_class").count().collect()]
    runs = pack_into(histogram, n_shards)
    table = spark.createDataFrame([(s, a, a + c, b) for s, a, c, b in runs], RUNS)
    salt = F.xxhash64("_key", "_piece")
    ranked = gapless(groups.select("_key", "_piece", "_class"), ["_class"], [F.col("_key"), F.col("_piece")], salt, n, "_rank")
    placed = ranked.join(
        F.broadcast(table.withColumnRenamed("_class", "_c")),  # a run for each class and bin boundary at most
        (F.col("_class") == F.col("_c")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")),
    ).select(F.col("_key").alias("_k"), F.col("_piece").alias("_p"), F.col("_bin").alias("shard"))
    out = rows.join(placed, (F.col("_key") == F.col("_k")) & (F.col("_piece") == F.col("_p"))).select("_id", "size", "text_crc32", "shard")
    out = work.save(out, "placed")
    work.keep("placed")
    out = gapless(out, ["shard"], [F.col("_id"), F.col("text_crc32"), F.col("size")], F.xxhash64("_id", "text_crc32"), n, "slot")
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")
