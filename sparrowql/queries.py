"""The engine's queries over the driver's tables, and the same as SQL for DuckDB."""

from __future__ import annotations

import sqlite3
import tempfile
import uuid
from collections.abc import Callable
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparrowql.engine import Engine, render
from sparrowql.errors import EngineError
from sparrowql.sources.catalog import kind_of

#: Tables and their keys, by which their rows stand; lineitem has none, so it gets a hidden row id.
KEYS: dict[str, str | None] = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": None,
    "events": "event_id",
}

_LINES = "FROM lineitem WHERE"
#: name -> (tables, dialect, arguments, DuckDB SQL or None if it is the same text)
SPECS: dict[str, tuple[str, str, tuple, str | None]] = {
    "filtered_count_1": ("lineitem", f"SELECT count(*) AS n {_LINES} l_orderkey > ?", (5000,), f"SELECT count(*) AS n {_LINES} l_orderkey > 5000"),
    "filtered_count_2": ("lineitem", f"SELECT count(*) AS n {_LINES} l_orderkey > ? AND l_linenumber <> ?", (5000, 3), f"SELECT count(*) AS n {_LINES} l_orderkey > 5000 AND l_linenumber <> 3"),
    "key_lookup": ("orders", "SELECT o_custkey FROM orders WHERE o_orderkey = ?", (777,), "SELECT o_custkey FROM orders WHERE o_orderkey = 777"),
    "rowid_alias_lookup": ("orders", "SELECT o_custkey FROM orders WHERE _rowid_ = 777", (), "SELECT o_custkey FROM orders WHERE o_orderkey = 777"),
    "index_eq_count": ("orders", "SELECT count(*) AS n FROM orders WHERE o_custkey = 42", (), None),
    "index_residual_impossible": ("orders", "SELECT count(*) AS n FROM orders WHERE o_custkey = 42 AND o_orderkey > 10000000", (), None),
    "join_count": ("lineitem orders", "SELECT count(*) AS n FROM lineitem JOIN orders ON lineitem.l_orderkey = orders.o_orderkey WHERE orders.o_custkey = 42", (), None),
    "sum_filter": ("lineitem", f"SELECT sum(l_partkey) AS s {_LINES} l_orderkey > 5000", (), f"SELECT CAST(sum(l_partkey) AS BIGINT) AS s {_LINES} l_orderkey > 5000"),
    "grouped": ("lineitem", "SELECT l_linenumber, count(*) AS n, sum(l_partkey) AS s FROM lineitem GROUP BY l_linenumber ORDER BY l_linenumber", (), "SELECT l_linenumber, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY l_linenumber"),
    "topn": ("events", "SELECT event_id, user_id FROM events ORDER BY user_id DESC, event_id DESC LIMIT 20", (), None),
    "paginate": ("events", "SELECT event_id, user_id FROM events ORDER BY user_id DESC, event_id DESC LIMIT 20 OFFSET 1000", (), None),
    "paginate_comma": ("events", "SELECT event_id, user_id FROM events ORDER BY user_id DESC, event_id DESC LIMIT 1000, 20", (), "SELECT event_id, user_id FROM events ORDER BY user_id DESC, event_id DESC LIMIT 20 OFFSET 1000"),
    "limit_negative": ("nation", "SELECT n_name FROM nation ORDER BY n_name LIMIT ? OFFSET ?", (-1, -5), "SELECT n_name FROM nation"),
    "whole_count": ("lineitem", "SELECT count(*) AS n FROM lineitem", (), None),
    "minmax": ("lineitem", "SELECT min(l_partkey) AS mn, max(l_partkey) AS mx FROM lineitem", (), None),
    "grouped_minmax": ("lineitem", "SELECT l_linenumber, min(l_partkey) AS mn, max(l_partkey) AS mx FROM lineitem GROUP BY l_linenumber", (), None),
    "between": ("lineitem", f"SELECT count(*) AS n {_LINES} l_orderkey BETWEEN 2500 AND 5000", (), None),
    "between_empty": ("lineitem", f"SELECT count(*) AS n {_LINES} l_orderkey BETWEEN 5000 AND 2500", (), None),
    "join_rows": ("orders customer", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 42", (), None),
    "avg_int": ("lineitem", "SELECT avg(l_partkey) AS a FROM lineitem", (), None),
    "avg_real": ("lineitem", "SELECT avg(l_quantity) AS a FROM lineitem", (), None),
    "text_minmax": ("orders", "SELECT min(o_orderpriority) AS a, max(o_orderpriority) AS b, count(o_orderstatus) AS n FROM orders", (), None),
    "real_minmax": ("customer", "SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer", (), None),
    "group_text": ("lineitem", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag", (), None),
    "group_real": ("lineitem", "SELECT l_tax, count(*) AS n FROM lineitem GROUP BY l_tax", (), None),
    "filter_eq": ("lineitem", f"SELECT count(*) AS n {_LINES} l_linenumber = 3", (), None),
    "filter_ne_ne": ("lineitem", f"SELECT count(*) AS n {_LINES} l_linenumber <> 3 AND l_linenumber != 5", (), None),
    "filter_lt": ("lineitem", f"SELECT count(*) AS n {_LINES} l_partkey < 500", (), None),
    "filter_le": ("lineitem", f"SELECT count(*) AS n {_LINES} l_partkey <= 500", (), None),
    "filter_ge": ("lineitem", f"SELECT count(*) AS n {_LINES} l_partkey >= 500", (), None),
    "filter_flipped": ("lineitem", f"SELECT count(*) AS n {_LINES} 500 < l_partkey", (), None),
    "filter_three": ("lineitem", f"SELECT count(*) AS n {_LINES} (l_partkey > 100 AND l_suppkey < 50) AND l_linenumber >= 2", (), None),
    "filter_contradiction": ("lineitem", f"SELECT count(*) AS n {_LINES} l_partkey > 900 AND l_partkey < 900", (), None),
    "params_numbered": ("lineitem", f"SELECT count(*) AS n {_LINES} l_partkey > ?2 AND l_partkey < ?1 AND l_suppkey <> ?", (900, 100, 7), f"SELECT count(*) AS n {_LINES} l_partkey > 100 AND l_partkey < 900 AND l_suppkey <> 7"),
    "params_real": ("lineitem", f"SELECT count(*) AS n {_LINES} l_partkey > ? AND l_linenumber < ?", (99.5, 6.5), f"SELECT count(*) AS n {_LINES} l_partkey >= 100 AND l_linenumber <= 6"),
    "params_null": ("lineitem", f"SELECT count(*) AS n {_LINES} l_partkey > ?", (), f"SELECT count(*) AS n {_LINES} l_partkey > NULL"),
    "key_range": ("orders", "SELECT count(*) AS n, sum(o_custkey) AS s FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 900", (), "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 900"),
    "empty_aggs": ("lineitem", f"SELECT count(*) AS n, sum(l_partkey) AS s, min(l_partkey) AS mn, avg(l_partkey) AS a {_LINES} l_partkey > 2000000", (), f"SELECT count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS s, min(l_partkey) AS mn, avg(l_partkey) AS a {_LINES} l_partkey > 2000000"),
    "total_int": ("lineitem", "SELECT total(l_partkey) AS t FROM lineitem", (), "SELECT CAST(sum(l_partkey) AS DOUBLE) AS t FROM lineitem"),
    "total_empty": ("lineitem", f"SELECT total(l_partkey) AS t {_LINES} l_partkey < 0", (), f"SELECT coalesce(CAST(sum(l_partkey) AS DOUBLE), 0.0) AS t {_LINES} l_partkey < 0"),
    "group_empty": ("lineitem", f"SELECT l_linenumber, count(*) AS n {_LINES} l_partkey < 0 GROUP BY l_linenumber", (), None),
    "group_hidden_order": ("part", "SELECT p_size FROM part WHERE p_partkey < 1500 GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 5", (), None),
    "order_position": ("lineitem", "SELECT count(*) AS n, l_linenumber FROM lineitem GROUP BY l_linenumber ORDER BY 1, 2 LIMIT 3 OFFSET 2", (), None),
    "order_alias": ("orders", "SELECT o_orderkey AS k, o_custkey AS o_orderkey FROM orders WHERE o_custkey < 60 ORDER BY o_orderkey DESC, k LIMIT 9", (), "SELECT k, c AS o_orderkey FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_custkey < 60 ORDER BY c DESC, k LIMIT 9)"),
    "order_stable": ("lineitem", "SELECT l_partkey, l_linenumber FROM lineitem ORDER BY l_linenumber DESC LIMIT 11", (), "SELECT l_partkey, l_linenumber FROM (SELECT *, row_number() OVER () AS rid FROM lineitem) ORDER BY l_linenumber DESC, rid LIMIT 11"),
    "order_unprojected": ("orders", "SELECT o_custkey FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 7", (), None),
    "limit_zero": ("events", "SELECT event_id FROM events ORDER BY user_id LIMIT 0", (), None),
    "agg_offset": ("events", "SELECT count(*) AS n FROM events LIMIT 1 OFFSET 1", (), None),
    "limit_rowid_order": ("orders", "SELECT o_orderkey FROM orders WHERE o_custkey > 700 LIMIT 4", (), "SELECT o_orderkey FROM orders WHERE o_custkey > 700 ORDER BY o_orderkey LIMIT 4"),
    "join_comma": ("orders customer", "SELECT count(*) AS n FROM orders, customer WHERE o_custkey = c_custkey AND c_nationkey = 3", (), None),
    "join_limit": ("orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey LIMIT 6", (), "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 6"),
    "join_group": ("orders customer", "SELECT c_nationkey, count(*) AS n, sum(o_orderkey) AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey > 3000 GROUP BY c_nationkey", (), "SELECT c_nationkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey > 3000 GROUP BY c_nationkey"),
    "join_topn": ("orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 3", (), None),
    "self_join": ("nation", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < 10", (), None),
    "star": ("customer", "SELECT * FROM customer WHERE c_custkey = 9", (), None),
    "qualified_star": ("nation region", "SELECT n.*, r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey", (), None),
    "quoted_names": ("customer", 'SELECT [c_name], `c_acctbal` FROM "customer" WHERE "c_nationkey" = 7', (), "SELECT c_name, c_acctbal FROM customer WHERE c_nationkey = 7"),
    "project_mixed": ("customer", "SELECT c_name, c_acctbal FROM customer WHERE c_nationkey = 7", (), None),
    "hidden_rowid": ("lineitem", "SELECT rowid, l_orderkey FROM lineitem WHERE rowid BETWEEN 100 AND 104", (), "SELECT rid AS rowid, l_orderkey FROM (SELECT *, row_number() OVER () AS rid FROM lineitem) WHERE rid BETWEEN 100 AND 104"),
}


def engine(spark: SparkSession, sf_dir: str, tables: str) -> Engine:
    made = Engine(spark)
    made.register_folder(sf_dir, {t: KEYS[t] for t in tables.split()}, in_order=True)
    return made


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql, args, _ = SPECS[name]
    return engine(spark, sf_dir, tables).query(sql, args)


# Queries over tables made from the driver's: with nulls, with numbers of the whole range, saved, or imported.

Maker = Callable[[SparkSession, str], DataFrame]
_GAPS = "SELECT l_orderkey AS o, CASE WHEN l_partkey % 7 <> 0 THEN l_suppkey END AS maybe, CASE WHEN l_linenumber > 2 THEN l_returnflag END AS flag FROM lineitem"
_WIDE = "SELECT l_linenumber AS k, {0} + l_suppkey AS v FROM lineitem UNION ALL SELECT l_linenumber, -{0} FROM lineitem"
_TOP = 9223372036854770000
_MANY = " AND ".join(f"l_partkey <> {k}" for k in range(2, 82, 2))


def _made(sql: str, dialect: str, args: tuple = (), **options) -> Maker:
    """The dialect's statement over a table ``made`` that Spark SQL makes from lineitem."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, **options)
        e.register("made", spark.sql(sql.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")))
        return e.query(dialect, args)

    return run


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine(spark, sf_dir, "region").rows("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey")
    return spark.createDataFrame([(render(rows),)], "text string")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = engine(spark, sf_dir, "orders").prepare("SELECT count(*) AS n, min(o_custkey) AS least FROM orders WHERE o_custkey > ? AND o_custkey < ?")
    first, *rest = (statement.query(args) for args in ((10, 50), (50.5, 1e9), (7,)))
    return first.union(rest[0]).union(rest[1])


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}"


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table and its key, saved and opened in another engine; hidden row ids as well."""
    folder, e = _folder(spark), engine(spark, sf_dir, "orders lineitem")
    for name in ("orders", "lineitem"):
        e.save(name, f"{folder}/{name}.parquet")
    again = Engine(spark)
    again.open(folder)
    orders = again.query("SELECT rowid AS id, o_custkey AS x FROM orders WHERE rowid BETWEEN 30 AND 60")
    return orders.union(again.query("SELECT oid AS id, l_partkey AS x FROM lineitem WHERE oid > 100 AND oid < 110"))


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation and events of user 5 and below as a SQLite file, imported and queried; the file is local, as its reader wants."""
    with tempfile.TemporaryDirectory() as local:
        with closing(sqlite3.connect(f"{local}/x.db")) as con:
            con.executescript("CREATE TABLE nation(n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER); CREATE TABLE small(user INTEGER, value REAL); CREATE INDEX i ON small(user)")
            con.executemany("INSERT INTO nation VALUES (?, ?, ?)", [tuple(r) for r in engine(spark, sf_dir, "nation").rows("SELECT n_nationkey, n_name, n_regionkey FROM nation")])
            con.executemany("INSERT INTO small VALUES (?, ?)", [tuple(r) for r in engine(spark, sf_dir, "events").rows("SELECT user_id, value FROM events WHERE user_id <= 5 ORDER BY event_id")])
            con.commit()
        e = Engine(spark)
        e.import_sqlite(f"{local}/x.db", _folder(spark))
    facts = [(f"{t}.{f.name}", kind_of(f.dataType), f.name == e.table(t).key, f.name in e.table(t).indexes) for t in ("nation", "small") for f in e.table(t).fields]
    columns = spark.createDataFrame(facts, "item string, kind string, key boolean, indexed boolean").selectExpr("item", "concat(kind, ' ', key, ' ', indexed) AS said", "0L AS n")
    rows = e.query("SELECT n_name AS item, n_name AS said, n_nationkey AS n FROM nation WHERE n_regionkey >= 2")
    counts = e.query("SELECT count(*) AS n FROM small WHERE user < 5").selectExpr("'small' AS item", "'rows' AS said", "n")
    return columns.union(rows).union(counts)


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, out = engine(spark, sf_dir, "nation region"), []
    for sql, args, _ in REFUSED:
        try:
            e.query(sql, args)
            out.append((sql, "none"))
        except EngineError as error:
            out.append((sql, type(error).__name__))
    return spark.createDataFrame(out, "sql string, error string")


#: Statements that the dialect refuses, their arguments, and the errors' names.
REFUSED: list[tuple[str, tuple, str]] = [
    ("SELECT n_name FROM nation WHERE n_nationkey = 1 OR n_regionkey = 2", (), "UnsupportedError"), ("SELECT DISTINCT n_name FROM nation", (), "UnsupportedError"),
    ("SELECT n_name FROM nation WHERE n_name = 3", (), "UnsupportedError"), ("SELECT n_name FROM nation, region", (), "UnsupportedError"), ("SELECT n_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey", (), "UnsupportedError"),
    ("SELECT sum(n_name) FROM nation", (), "UnsupportedError"), ("SELECT n_name, count(*) FROM nation", (), "UnsupportedError"), ("SELECT upper(n_name) FROM nation", (), "UnsupportedError"),
    ("SELECT n_name FROM nation GROUP BY n_regionkey", (), "UnsupportedError"), ("SELECT n_name FROM absent", (), "SemanticError"), ("SELECT absent FROM nation", (), "SemanticError"),
    ("SELECT rowid FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey", (), "SemanticError"), ("SELECT n_name FROM nation ORDER BY 2", (), "SemanticError"), ("SELECT nation.n_name FROM nation n", (), "SemanticError"),
    ("SELECT n_name FROM nation LIMIT -1", (), "ParseError"), ("SELECT n_name FROM nation;;", (), "ParseError"), ("SELECT n_name FROM nation /* no */", (), "ParseError"), ("SELECT 'n_name FROM nation", (), "ParseError"),
    ("SELECT n_name FROM nation WHERE n_nationkey = ?", ("1",), "BindError"), ("SELECT n_name FROM nation LIMIT ?", (), "BindError"), ("SELECT n_name FROM nation LIMIT ?", (1.0,), "BindError"), ("SELECT n_name FROM nation", (1,), "BindError"),
]

#: name -> (what makes the result, DuckDB SQL)
EXTRA: dict[str, tuple[Maker, str]] = {
    "exact_sum": (_made(_WIDE.format(_TOP), "SELECT k, sum(v) AS s, avg(v) AS a, total(v) AS t, count(v) AS n FROM made GROUP BY k"),
                  f"SELECT k, CAST(sum(v) AS BIGINT) AS s, CAST(sum(v) AS DOUBLE) / count(v) AS a, CAST(sum(v) AS DOUBLE) AS t, count(v) AS n FROM (SELECT l_linenumber AS k, CAST({_TOP} + l_suppkey AS HUGEINT) AS v FROM lineitem UNION ALL SELECT l_linenumber, -{_TOP} FROM lineitem) GROUP BY k"),
    "full_range_filter": (_made(_WIDE.format(_TOP), "SELECT count(*) AS n, min(v) AS mn, max(v) AS mx FROM made WHERE v > ? AND v <> ?", (-9.3e18, -_TOP)),
                          f"SELECT count(*) AS n, min(v) AS mn, max(v) AS mx FROM (SELECT {_TOP} + l_suppkey AS v FROM lineitem)"),
    "null_filters": (_made(_GAPS, "SELECT count(*) AS n, count(maybe) AS c, sum(maybe) AS s, avg(maybe) AS a, min(maybe) AS mn, count(flag) AS f FROM made WHERE maybe <> 3"),
                     f"SELECT count(*) AS n, count(maybe) AS c, CAST(sum(maybe) AS BIGINT) AS s, avg(maybe) AS a, min(maybe) AS mn, count(flag) AS f FROM ({_GAPS}) WHERE maybe <> 3"),
    "null_aggregates": (_made(_GAPS, "SELECT count(*) AS n, count(maybe) AS c, sum(maybe) AS s, max(flag) AS mx FROM made"), f"SELECT count(*) AS n, count(maybe) AS c, CAST(sum(maybe) AS BIGINT) AS s, max(flag) AS mx FROM ({_GAPS})"),
    "null_groups": (_made(_GAPS, "SELECT flag, count(*) AS n, count(maybe) AS c, sum(maybe) AS s FROM made GROUP BY flag"), f"SELECT flag, count(*) AS n, count(maybe) AS c, CAST(sum(maybe) AS BIGINT) AS s FROM ({_GAPS}) GROUP BY flag"),
    "null_order": (_made(_GAPS, "SELECT maybe, count(*) AS n FROM made GROUP BY maybe ORDER BY maybe DESC LIMIT 9"), f"SELECT maybe, count(*) AS n FROM ({_GAPS}) GROUP BY maybe ORDER BY maybe DESC NULLS LAST LIMIT 9"),
    "null_first": (_made(_GAPS, "SELECT flag, max(o) AS m FROM made GROUP BY flag ORDER BY flag LIMIT 1"), f"SELECT flag, max(o) AS m FROM ({_GAPS}) GROUP BY flag ORDER BY flag NULLS FIRST LIMIT 1"),
    "null_join": (_made(_GAPS, "SELECT count(*) AS n FROM made a JOIN made b ON a.maybe = b.o WHERE a.o < 300"), f"SELECT count(*) AS n FROM ({_GAPS}) a JOIN ({_GAPS}) b ON a.maybe = b.o WHERE a.o < 300"),
    "group_order": (lambda spark, sf_dir: _numbered(spark, sf_dir, "SELECT l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY l_linenumber"),
                    "SELECT CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS place, k, n FROM (SELECT l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY l_linenumber)"),
    "group_limit_order": (lambda spark, sf_dir: run_sql(spark, sf_dir, "SELECT p_size, count(*) AS n FROM part GROUP BY p_size LIMIT 5 OFFSET 2"), "SELECT p_size, count(*) AS n FROM part GROUP BY p_size ORDER BY p_size LIMIT 5 OFFSET 2"),
    "output_names": (lambda spark, sf_dir: run_sql(spark, sf_dir, "SELECT Count(*), sum( part.p_size ), p_brand FROM part GROUP BY p_brand"), 'SELECT count(*) AS "count(*)", CAST(sum(p_size) AS BIGINT) AS "sum(part.p_size)", p_brand FROM part GROUP BY p_brand'),
    "many_predicates": (lambda spark, sf_dir: run_sql(spark, sf_dir, f"SELECT count(*) AS n FROM lineitem WHERE {_MANY} -- forty"), f"SELECT count(*) AS n FROM lineitem WHERE {_MANY}"),
    "rendered": (_text, "SELECT string_agg('i:' || r_regionkey || '|t:' || r_name || '|;', '' ORDER BY r_regionkey) AS text FROM region"),
    "prepared": (_prepared, "SELECT count(*) AS n, min(o_custkey) AS least FROM orders WHERE o_custkey > 10 AND o_custkey < 50 UNION ALL SELECT count(*), min(o_custkey) FROM orders WHERE o_custkey > 50 UNION ALL SELECT 0, NULL"),
    "saved": (_saved, "SELECT o_orderkey AS id, o_custkey AS x FROM orders WHERE o_orderkey BETWEEN 30 AND 60 UNION ALL SELECT rid, l_partkey FROM (SELECT l_partkey, row_number() OVER () AS rid FROM lineitem) WHERE rid > 100 AND rid < 110"),
    "imported": (_imported, "SELECT * FROM (VALUES ('nation.n_nationkey', 'int true false', 0), ('nation.n_name', 'text false false', 0), ('nation.n_regionkey', 'int false false', 0), ('small.user', 'int false true', 0), ('small.value', 'real false false', 0)) AS t(item, said, n)"
                 " UNION ALL SELECT n_name, n_name, n_nationkey FROM nation WHERE n_regionkey >= 2 UNION ALL SELECT 'small', 'rows', count(*) FROM events WHERE user_id < 5"),
    "refused": (_refused, "SELECT * FROM (VALUES " + ", ".join("('" + sql.replace("'", "''") + f"', '{error}')" for sql, _, error in REFUSED) + ") AS t(sql, error)"),
}


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return engine(spark, sf_dir, "lineitem part").query(sql)


def _numbered(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a few groups with their places, as an engine with ordered groups gives them."""
    e = Engine(spark, ordered_groups=True)
    e.register_folder(sf_dir, {"lineitem": None})
    frame = e.query(sql)
    schema = T.StructType([T.StructField("place", T.LongType()), *frame.schema.fields])
    return spark.createDataFrame([(k + 1, *r) for k, r in enumerate(frame.collect())], schema)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = {name: lambda spark, sf_dir, name=name: run(spark, sf_dir, name) for name in SPECS}
    return made | {name: maker for name, (maker, _) in EXTRA.items()}


def oracle_sql() -> dict[str, str]:
    made = {name: oracle or sql for name, (_, sql, _, oracle) in SPECS.items()}
    return made | {name: sql for name, (_, sql) in EXTRA.items()}
