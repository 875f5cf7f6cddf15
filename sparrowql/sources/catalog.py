"""Tables by name, with their kinds of columns and their row ids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowql.errors import SemanticError

#: Names of a row id, unless a visible column has that name.
ROWID_NAMES = ("rowid", "_rowid_", "oid")
#: Field metadata of a stored row id that isn't among the visible columns.
HIDDEN = "sparrowql.hidden"
DECLARED = "sparrowql.declared"
#: Field metadata of a table's key, and of columns that had an index where they come from.
KEY = "sparrowql.key"
INDEXED = "sparrowql.indexed"
#: Field metadata of a row id by which the rows stand in their files.
SORTED = "sparrowql.sorted"
#: Files whose first places are broadcast at most; beyond that they are joined.
MOST_FILES = 100_000

_WIDTHS = {"byte": 8, "tinyint": 8, "short": 16, "smallint": 16, "integer": 32, "int": 32, "long": 64, "bigint": 64}


def kind_of(data_type: T.DataType) -> str:
    """``int``, ``real``, ``text``, or ``other`` (which can only be projected and counted)."""
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, T.FractionalType) and not isinstance(data_type, T.DecimalType):
        return "real"
    return "text" if isinstance(data_type, T.StringType) else "other"


def width_of(data_type: T.DataType) -> int:
    """Bits of an integer type."""
    return _WIDTHS[data_type.simpleString()]


def unused(names: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column has that name."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


@dataclass(frozen=True)
class Table:
    """A named table.

    ``key``: the column that is its row id, if it has one; ``from_files``: its
    frame reads files directly, so row places can stand in for a key; ``footer``:
    the same files by the reader that answers counts and extremes from footers;
    ``in_order``: within and across its files, by path, rows stand by their row ids.
    """

    name: str
    frame: DataFrame
    key: str | None = None
    from_files: bool = False
    footer: DataFrame | None = None
    indexes: tuple[str, ...] = ()
    in_order: bool = False

    @property
    def fields(self) -> list[T.StructField]:
        """The visible columns."""
        return [f for f in self.frame.schema.fields if not (f.metadata or {}).get(HIDDEN)]

    def field(self, name: str) -> T.StructField | None:
        """The visible column of this name, whatever its case."""
        return next((f for f in self.fields if f.name.lower() == name.lower()), None)

    @property
    def stored_key(self) -> str | None:
        hidden = [f.name for f in self.frame.schema.fields if (f.metadata or {}).get(HIDDEN)]
        return self.key or (hidden[0] if hidden else None)

    @cached_property
    def files(self) -> list[str]:
        """The paths of its files, in order; listed once."""
        return sorted(self.frame.inputFiles()) if self.from_files else []

    def first_files(self, n: int) -> Table:
        """The table of its first files alone, which Spark picks before it reads any."""
        paths = self.files[:n]
        named = {p for f in paths for p in (f, f.replace("file:///", "file:/", 1))}  # as a local path's metadata has it
        out = replace(self, frame=self.frame.where(F.col("_metadata.file_path").isin(sorted(named))), footer=None)
        out.__dict__["files"] = paths
        return out

    @cached_property
    def _file_starts(self) -> DataFrame:
        """(file, before): the rows of the files before each one; counted once, from footers."""
        counted = self.frame.select(F.col("_metadata.file_path").alias("file")).groupBy("file").count().collect()
        rows, before = [], 0
        for file, n in sorted(counted):
            rows.append((file, before))
            before += n
        starts = self.frame.sparkSession.createDataFrame(rows, "file string, before long")
        return F.broadcast(starts) if len(rows) <= MOST_FILES else starts

    @cached_property
    def _fixed(self) -> tuple[DataFrame, DataFrame]:
        """A registered frame whose partitions stay, and (part, before) of them.

        It is checkpointed where the session names a folder for that, else kept in memory.
        """
        spark = self.frame.sparkSession
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder:
            spark.sparkContext.setCheckpointDir(folder)
            frame = self.frame.checkpoint()
        else:
            frame = self.frame.persist()
        rows, before = [], 0
        for part, n in sorted(frame.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()):
            rows.append((part, before))
            before += n
        return frame, F.broadcast(spark.createDataFrame(rows, "part int, before long"))

    def with_rowid(self, name: str) -> DataFrame:
        """The frame with its row id as a further long column.

        Row ids without a key are 1, 2, ... in the order of the files' paths and
        of the rows in them, or else of the partitions of a registered frame.
        """
        if self.stored_key:
            return self.frame.withColumn(name, quoted(self.stored_key).cast("long"))
        columns = [*self.frame.columns, name]
        start, before = unused(columns, "start"), unused(columns, "before")
        if self.from_files and len(self.files) < 2:
            return self.frame.withColumn(name, F.col("_metadata.row_index") + 1)
        if self.from_files:
            found, starts = self.frame.withColumns({start: F.col("_metadata.file_path"), name: F.col("_metadata.row_index") + 1}), self._file_starts
        else:
            frame, starts = self._fixed
            within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1
            found = frame.withColumns({start: F.spark_partition_id(), name: within})
        starts = starts.toDF(f"{start}_", before)
        found = found.join(starts, quoted(start) == quoted(f"{start}_"))
        return found.withColumn(name, quoted(name) + quoted(before)).drop(start, f"{start}_", before)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@contextmanager
def _second_reader(spark: SparkSession) -> Iterator[None]:
    """Parquet is read by the newer source, which pushes aggregates into footers."""
    key = "spark.sql.sources.useV1SourceList"
    old = spark.conf.get(key)
    spark.conf.set(key, ",".join(x for x in (old or "").split(",") if x.strip() != "parquet"))
    try:
        yield
    finally:
        spark.conf.set(key, old or "")


class Catalog:
    """Registered tables; names don't depend on case."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}

    def add(self, table: Table) -> Table:
        if table.key is not None:
            found = table.field(table.key)
            if found is None or kind_of(found.dataType) != "int":
                raise SemanticError(f"{table.key} isn't an integer column of {table.name}")
        self.tables[table.name.lower()] = table
        return table

    def table(self, name: str) -> Table:
        try:
            return self.tables[name.lower()]
        except KeyError:
            raise SemanticError(f"no such table: {name}") from None

    def register(self, name: str, frame: DataFrame, key: str | None = None) -> Table:
        return self.add(Table(name, frame, key))

    def register_parquet(self, name: str, path: str, key: str | None = None, in_order: bool = False) -> Table:
        """Files as a table; without ``key``, the key is what their metadata names, if any.

        ``in_order`` says that rows stand by the key in the files; metadata may say it too.
        """
        with _second_reader(self.spark):
            footer = self.spark.read.parquet(path)
        frame = self.spark.read.parquet(path)
        marked = lambda mark: [f.name for f in frame.schema.fields if (f.metadata or {}).get(mark)]
        key = key or next(iter(marked(KEY)), None)
        in_order = in_order or (key or next(iter(marked(HIDDEN)), None)) in [*marked(SORTED), None]
        return self.add(Table(name, frame, key, True, footer, tuple(sorted(marked(INDEXED))), in_order))

    def open(self, folder: str) -> list[str]:
        """Registers every ``<name>.parquet`` of a folder; their names."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)  # type: ignore[union-attr]
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        names = sorted(f.getPath().getName() for f in found)
        tables = [n.removesuffix(".parquet") for n in names if n.endswith(".parquet")]
        for name in tables:
            self.register_parquet(name, f"{folder.rstrip('/')}/{name}.parquet")
        return tables
