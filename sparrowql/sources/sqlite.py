"""SQLite files as a source: schema inference and a partitioned reader.

A column's type is the one class of its non-null cells; a column that mixes
classes, or holds blobs, is refused. A table without an INTEGER PRIMARY KEY
gets its row id as a hidden column. Readers open the file themselves, so it has
to be at the same path on every executor.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparrowql.errors import SourceError, UnsupportedError
from sparrowql.sources.catalog import DECLARED, HIDDEN, INDEXED, KEY, ROWID_NAMES, SORTED

CLASSES = ("integer", "real", "text", "blob")
#: Columns whose classes one pass finds.
PASS_COLUMNS = 300
#: Rows that one partition reads, and rows of one Arrow batch.
PARTITION_ROWS, BATCH_ROWS = 500_000, 20_000
_TYPES = {"integer": T.LongType(), "real": T.DoubleType(), "text": T.StringType()}
_ARROW = {"integer": pa.int64(), "real": pa.float64(), "text": pa.string()}


def name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


@dataclass(frozen=True)
class Layout:
    """A table as it is read: (column, class, declared type), its key, and its hidden row id."""

    table: str
    columns: tuple[tuple[str, str, str], ...]
    key: str | None
    hidden: str | None
    indexes: tuple[str, ...]
    ranges: tuple[tuple[int, int], ...]  # of row ids, with about as many rows each

    def schema(self) -> T.StructType:
        out = T.StructType()
        if self.hidden:
            out = out.add(self.hidden, T.LongType(), False, {HIDDEN: True, SORTED: True})
        for column, kind, declared in self.columns:
            marks = {DECLARED: declared} | ({KEY: True, SORTED: True} if column == self.key else {}) | ({INDEXED: True} if column in self.indexes else {})
            out = out.add(column, _TYPES[kind], column != self.key, marks)
        return out


def _open(path: str) -> sqlite3.Connection:
    try:
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        con.execute("SELECT 1 FROM sqlite_schema LIMIT 1")
    except sqlite3.Error as e:
        raise SourceError(f"{path} can't be read as a SQLite file: {e}") from e
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def layouts(path: str) -> list[Layout]:
    """The layouts of every table of the file, by name."""
    with closing(_open(path)) as con:
        tables = [r[0] for r in con.execute("SELECT name FROM sqlite_schema WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]
        return [_layout(con, t) for t in tables]


def _layout(con: sqlite3.Connection, table: str) -> Layout:
    if next(r[4] for r in con.execute(f"PRAGMA table_list({name(table)})")):
        raise UnsupportedError(f"{table} is a WITHOUT ROWID table")
    info = list(con.execute(f"PRAGMA table_info({name(table)})"))
    keys = [r for r in info if r[5]]
    key = keys[0][1] if len(keys) == 1 and keys[0][2].upper() == "INTEGER" else None
    visible = {r[1].lower() for r in info}
    hidden = None if key else next((n for n in ROWID_NAMES if n not in visible), None)
    if not key and not hidden:
        raise UnsupportedError(f"{table} hides its row id behind columns of its names")
    classes = _classes(con, table, [r[1] for r in info])
    columns = []
    for _, column, declared, *_ in info:
        found = classes[column]
        if "blob" in found or len(found) > 1:
            raise UnsupportedError(f"{table}.{column} holds {' and '.join(sorted(found))}")
        columns.append((column, found.pop() if found else "integer", declared))
    kinds = {c: k for c, k, _ in columns}
    indexes = []
    for _, index, _, _, partial, *_ in con.execute(f"PRAGMA index_list({name(table)})"):
        parts = [r[2] for r in con.execute(f"PRAGMA index_info({name(index)})")]
        if len(parts) == 1 and not partial and kinds.get(parts[0]) == "integer":
            indexes.append(parts[0])
    rowid = name(key or hidden or "rowid")
    ranges = con.execute(
        f"SELECT min(r), max(r) FROM (SELECT {rowid} AS r, (row_number() OVER (ORDER BY {rowid}) - 1) / {PARTITION_ROWS} AS part FROM {name(table)}) GROUP BY part ORDER BY part"
    )
    return Layout(table, tuple(columns), key, hidden, tuple(sorted(set(indexes))), tuple(ranges))


def _classes(con: sqlite3.Connection, table: str, columns: list[str]) -> dict[str, set[str]]:
    """The classes of each column's cells but null, in one pass over the table (or one for every ``PASS_COLUMNS`` columns)."""
    out: dict[str, set[str]] = {}
    for k in range(0, len(columns), PASS_COLUMNS):
        part = columns[k : k + PASS_COLUMNS]
        tests = [f"max(typeof({name(c)}) = '{kind}')" for c in part for kind in CLASSES]
        flags = iter(next(con.execute(f"SELECT {', '.join(tests)} FROM {name(table)}")))
        out |= {c: {kind for kind in CLASSES if next(flags)} for c in part}
    return out


@dataclass
class _Range(InputPartition):
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, layout: Layout):
        self.path, self.layout = path, layout

    def partitions(self) -> list[_Range]:
        return [_Range(low, high) for low, high in self.layout.ranges]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:  # type: ignore[override]
        x = self.layout
        wanted = [*([(x.hidden, "integer")] if x.hidden else []), *[(c, k) for c, k, _ in x.columns]]
        rowid = name(x.key or x.hidden or "rowid")
        sql = f"SELECT {', '.join(name(c) for c, _ in wanted)} FROM {name(x.table)} WHERE {rowid} BETWEEN ? AND ? ORDER BY {rowid}"
        with closing(_open(self.path)) as con:
            rows = con.execute(sql, (partition.low, partition.high))
            while batch := rows.fetchmany(BATCH_ROWS):
                columns = zip(*batch, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, _ARROW[k]) for v, (_, k) in zip(columns, wanted, strict=True)], [c for c, _ in wanted])


class SQLiteSource(DataSource):
    """``spark.read.format("sqlite_table").option("path", ...).option("table", ...)``"""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _layout(self) -> Layout:
        wanted = self.options["table"].lower()
        for layout in layouts(self.options["path"]):
            if layout.table.lower() == wanted:
                return layout
        raise SourceError(f"no table {self.options['table']} in {self.options['path']}")

    def schema(self) -> T.StructType:
        return self._layout().schema()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._layout())


def read_table(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """A table of the file, in partitions by row id."""
    spark.dataSource.register(SQLiteSource)
    df = spark.read.format("sqlite_table").option("path", path).option("table", layout.table).load()
    return spark.createDataFrame([], layout.schema()) if not layout.ranges else df.to(layout.schema())
