"""The engine: tables, statements and results."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from sparrowql.errors import IntegerOverflowError, UnsupportedError
from sparrowql.functions.aggregates import OVERFLOW
from sparrowql.plans.analyzer import Query, analyze
from sparrowql.plans.binder import Value
from sparrowql.plans.builder import build
from sparrowql.plans.parser import parse
from sparrowql.sources import sqlite
from sparrowql.sources.catalog import HIDDEN, INDEXED, KEY, ROWID_NAMES, SORTED, Catalog, Table, quoted


class Statement:
    """A parsed and analyzed query, which takes any list of arguments."""

    def __init__(self, query: Query, ordered_groups: bool):
        self._query = query
        self._ordered = ordered_groups

    @property
    def columns(self) -> list[str]:
        return [o.name for o in self._query.outputs]

    def query(self, args: Sequence[Value] = ()) -> DataFrame:
        return build(self._query, args, self._ordered)


class Engine:
    """Tables and statements over a Spark session.

    ``ordered_groups=True`` gives groups in the order of their keys where no clause
    asks for an order, at the cost of a range exchange; LIMIT always goes by that order.
    The session's option for Parquet's aggregate pushdown is switched on, as counts
    and extremes of whole files come from footers.
    """

    def __init__(self, spark: SparkSession, ordered_groups: bool = False):
        self.spark = spark
        self.catalog = Catalog(spark)
        self.ordered_groups = ordered_groups
        self._statements: dict[str, Statement] = {}
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")

    # tables

    def register(self, name: str, frame: DataFrame, key: str | None = None) -> Table:
        """A DataFrame as a table; ``key`` is its row id, a unique integer column."""
        self._statements.clear()
        return self.catalog.register(name, frame, key)

    def register_parquet(self, name: str, path: str, key: str | None = None, in_order: bool = False) -> Table:
        """Parquet files as a table; ``in_order`` if rows stand by the key in them, so that LIMIT can stop early."""
        self._statements.clear()
        return self.catalog.register_parquet(name, path, key, in_order)

    def register_folder(self, folder: str, keys: Mapping[str, str | None], in_order: bool = False) -> None:
        """``folder/<name>.parquet`` for each name, with its key or None."""
        for name, key in keys.items():
            self.register_parquet(name, f"{folder}/{name}.parquet", key, in_order)

    def open(self, folder: str) -> list[str]:
        """Every ``<name>.parquet`` of a folder, as written by ``import_sqlite``; their names."""
        self._statements.clear()
        return self.catalog.open(folder)

    def cache(self, name: str) -> None:
        """Keeps a table's columns in memory from their first use on, with extremes of each batch."""
        self.catalog.table(name).frame.cache()

    def table(self, name: str) -> Table:
        return self.catalog.table(name)

    def import_sqlite(self, path: str, folder: str) -> list[str]:
        """Every table of a SQLite file, written to ``folder`` as Parquet and registered; their names.

        Tables of the folder are replaced when all are written; a failure before leaves them as they were.
        """
        self._statements.clear()
        found, folder = sqlite.layouts(path), folder.rstrip("/")
        moved = self.spark._jvm.org.apache.hadoop.fs.Path  # type: ignore[union-attr]
        fresh = f"{folder}/.import-{uuid.uuid4().hex}"
        files = moved(fresh).getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            for layout in found:
                sqlite.read_table(self.spark, path, layout).write.parquet(f"{fresh}/{layout.table}.parquet")
            for layout in found:  # only when all are written
                target = moved(f"{folder}/{layout.table}.parquet")
                files.delete(target, True)
                files.rename(moved(f"{fresh}/{layout.table}.parquet"), target)
        finally:
            files.delete(moved(fresh), True)
        for layout in found:
            self.catalog.register_parquet(layout.table, f"{folder}/{layout.table}.parquet")
        return [layout.table for layout in found]

    def save(self, name: str, path: str) -> None:
        """A table as Parquet, sorted by its row id so that ranges of it skip row groups.

        Key, indexes, declared types and hidden row ids are kept in the files'
        metadata; a row id that isn't stored becomes a hidden column.
        """
        table = self.catalog.table(name)
        key, frame = table.stored_key, table.frame
        if key is None:
            key = next((n for n in ROWID_NAMES if table.field(n) is None), None)
            if key is None:
                raise UnsupportedError(f"{name} hides its row id behind columns of its names")
            frame = table.with_rowid(key)
        marks = {c: {INDEXED: True} for c in table.indexes}
        marks[key] = marks.get(key, {}) | {SORTED: True, (KEY if key == table.key else HIDDEN): True}
        columns = [quoted(f.name).alias(f.name, metadata={**(f.metadata or {}), **marks.get(f.name, {})}) for f in frame.schema.fields]
        frame.orderBy(quoted(key)).select(*columns).write.mode("overwrite").parquet(path)

    # statements

    def prepare(self, sql: str) -> Statement:
        """The statement of this text, analyzed the first time that it is seen."""
        if sql not in self._statements:
            self._statements[sql] = Statement(analyze(parse(sql), self.catalog), self.ordered_groups)
        return self._statements[sql]

    def query(self, sql: str, args: Sequence[Value] = ()) -> DataFrame:
        return self.prepare(sql).query(args)

    def rows(self, sql: str, args: Sequence[Value] = ()) -> list[Row]:
        """The result's rows, with Spark's errors as the engine's."""
        try:
            return self.query(sql, args).collect()
        except PySparkException as e:
            if OVERFLOW in str(e):
                raise IntegerOverflowError(OVERFLOW) from e
            raise


def render(rows: Sequence[Sequence[object]]) -> str:
    """Rows as tagged text: ``N:|`` for null, else ``i:``, ``f:`` or ``t:``, the value and ``|``; ``;`` ends a row."""

    def one(v: object) -> str:
        if v is None:
            return "N:|"
        if isinstance(v, int):
            return f"i:{int(v)}|"
        if isinstance(v, float):
            text = format(Decimal(repr(v)), "f") if v == v and abs(v) != float("inf") else repr(v)
            return f"f:{re.sub(r'[.]0$', '', text)}|"
        return f"t:{v}|"

    return "".join("".join(map(one, row)) + ";" for row in rows)
