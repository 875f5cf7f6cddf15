"""Queries drawn from the dialect's grammar, against SQLite on the same file."""

import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from sparrowql import BindError, Engine, IntegerOverflowError, SemanticError, UnsupportedError, render
from sparrowql.plans import builder

STATIONS, READINGS, ALARMS = 60, 700, 250
#: Columns by kind, the one that joins meet on, and the row id.
TABLES = {
    "station": {"int": ["sid", "height", "zone"], "real": ["lat"], "text": ["town"], "link": "sid", "id": "sid"},
    "reading": {"int": ["day", "station", "temp", "flux"], "real": ["rain"], "text": ["note"], "link": "station", "id": "rowid"},
    "alarm": {"int": ["aid", "at", "level", "stamp"], "real": [], "text": ["kind of"], "link": "at", "id": "aid"},
}


def fill(path):
    rng = random.Random(2024)
    con = sqlite3.connect(path)
    con.executescript(
        """CREATE TABLE station(sid INTEGER PRIMARY KEY, town TEXT, height INTEGER, zone INTEGER, lat REAL);
        CREATE TABLE reading(day INTEGER, station INTEGER, temp INTEGER, rain REAL, note TEXT, flux INTEGER);
        CREATE TABLE alarm(aid INTEGER PRIMARY KEY, at INTEGER, level INTEGER, stamp INTEGER, "kind of" TEXT);
        CREATE TABLE blank(n INTEGER, s TEXT);"""
    )
    towns = ["Oslo", "oslo", "Århus", "", None, "Zug"]
    for k in range(STATIONS):
        con.execute("INSERT INTO station VALUES (?,?,?,?,?)", (3 * k - 40, rng.choice(towns), rng.choice([None, k, -k]), k % 4, rng.choice([None, k / 4, -0.5])))
    for k in range(READINGS):
        flux = rng.choice([None, 2**63 - 1, -(2**63), k, 0])
        row = (k // 20, rng.choice([None, 3 * rng.randrange(STATIONS) - 40, 1000]), rng.randint(-15, 15), rng.choice([None, 0.25 * rng.randrange(40)]), rng.choice([f"n{k % 13}", None]), flux)
        con.execute("INSERT INTO reading VALUES (?,?,?,?,?,?)", row)
    con.execute("DELETE FROM reading WHERE day IN (3, 4, 17)")
    for _ in range(ALARMS):
        con.execute("INSERT OR IGNORE INTO alarm VALUES (?,?,?,?,?)", (rng.randint(-(10**6), 10**12), rng.choice([None, 3 * rng.randrange(70) - 40]), rng.randrange(5), rng.randint(0, 2**40), rng.choice("ab")))
    con.commit()
    return con


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("db"))
    con = fill(f"{top}/weather.db")
    engine = Engine(spark)
    assert engine.import_sqlite(f"{top}/weather.db", top) == ["alarm", "blank", "reading", "station"]
    return engine, con, top


class Draw:
    """A random statement of the dialect with its arguments."""

    def __init__(self, seed):
        self.rng, self.args = random.Random(seed), []
        names = list(TABLES)
        self.tables = self.rng.sample(names, 2) if self.rng.random() < 0.3 else [self.rng.choice(names)]
        self.alias = ["p", "q"][: len(self.tables)]
        self.join = len(self.tables) == 2

    def column(self, *kinds, side=None):
        side = self.rng.randrange(len(self.tables)) if side is None else side
        found = [c for k in kinds for c in TABLES[self.tables[side]][k]]
        return self.named(side, self.rng.choice(found)) if found else self.column("int", side=side)

    def named(self, side, name):
        name = name if name.isidentifier() else self.rng.choice(['"{}"', "[{}]", "`{}`"]).format(name)
        return f"{self.alias[side]}.{name}" if self.join or self.rng.random() < 0.3 else name

    def ids(self, descending=False):
        return ", ".join(f"{self.alias[k]}.{TABLES[t]['id']}{' DESC' * descending}" for k, t in enumerate(self.tables))

    def value(self):
        rng = self.rng
        whole = rng.choice([rng.randint(-20, 20), rng.randint(-50, 200), rng.choice([2**63 - 1, -(2**63), 2**40])])
        if rng.random() < 0.5:
            return str(whole)
        self.args.append(rng.choice([whole, whole, float(whole % 30) + rng.choice([0, 0.5]), None, math.inf, -math.inf, 2.0**65]))
        return "?"

    def comparison(self):
        column, rng = self.column("int"), self.rng
        if rng.random() < 0.2:
            return f"{column} BETWEEN {self.value()} AND {self.value()}"
        op = rng.choice(["=", "==", "<>", "!=", "<", "<=", ">", ">="])
        pair = [column, self.value()]
        if rng.random() < 0.25:
            pair.reverse()
        text = f"{pair[0]} {op} {pair[1]}"
        return f"({text})" if rng.random() < 0.2 else text

    def source(self):
        named = [f"{t}{self.rng.choice([' AS ', ' '])}{a}" for t, a in zip(self.tables, self.alias, strict=True)]
        terms = [self.comparison() for _ in range(self.rng.choice([0, 0, 1, 1, 2, 3]))]
        if not self.join:
            return f" FROM {named[0]}" + (" WHERE " + " AND ".join(terms) if terms else "")
        on = " = ".join(f"{a}.{TABLES[t]['link']}" for a, t in zip(self.alias, self.tables, strict=True))
        if self.rng.random() < 0.5:
            return f" FROM {', '.join(named)} WHERE " + " AND ".join([*terms, on])
        return f" FROM {named[0]} {self.rng.choice(['JOIN', 'INNER JOIN'])} {named[1]} ON {on}" + (" WHERE " + " AND ".join(terms) if terms else "")

    def aggregate(self):
        func = self.rng.choice(["count", "sum", "avg", "total", "min", "max"])
        if func == "count" and self.rng.random() < 0.5:
            return "count(*)"
        kinds = ("int", "real", "text") if func in ("count", "min", "max") else ("int", "real")
        column = self.column(*kinds)
        while func in ("sum", "avg", "total") and "flux" in column:  # these have a test of their own
            column = self.column(*kinds)
        return f"{func}({column})"

    def cut(self):
        n = [self.rng.choice([0, 1, 3, 10, 500]), self.rng.choice([0, 2, 40])]
        form = self.rng.choice(["", "", " LIMIT {0}", " LIMIT {0} OFFSET {1}", " LIMIT {1}, {0}", " LIMIT ?"])
        if "?" in form:
            self.args.append(self.rng.choice([-1, 4]))
        return form.format(*n)

    def statement(self):
        """(sql, arguments, whether the rows' order is defined)"""
        shape = self.rng.choice(["rows", "rows", "groups", "totals"])
        if shape == "totals":
            select = ", ".join(self.aggregate() for _ in range(self.rng.randint(1, 4)))
            return f"SELECT {select}{self.source()}{self.cut()}", self.args, True
        if shape == "groups":
            key, made = self.column("int", "text"), [self.aggregate() for _ in range(self.rng.randint(1, 3))]
            sql = f"SELECT {', '.join([key, *made])}{self.source()} GROUP BY {key}"
            cut = self.cut()
            if not cut and self.rng.random() < 0.4:
                return sql, self.args, False
            return f"{sql} ORDER BY {self.rng.choice([made[0] + ' DESC, ', '2, ', ''])}{key}{self.rng.choice(['', ' DESC'])}{cut}", self.args, True
        columns = [self.column("int", "real", "text") for _ in range(self.rng.randint(1, 4))]
        select = self.rng.choice([", ".join(columns), "*", f"{self.alias[0]}.*, {columns[0]} AS again"])
        sql, cut = f"SELECT {select}{self.source()}", None
        if self.rng.random() < 0.6:
            first = self.rng.choice([columns[0] + self.rng.choice(["", " ASC", " DESC"]) + ", ", ""])
            return f"{sql} ORDER BY {first}{self.ids(self.rng.random() < 0.3)}{self.cut()}", self.args, True
        cut = "" if self.join else self.cut()  # of a single table the first rows are those by row id
        return sql + cut, self.args, bool(cut)


@pytest.mark.parametrize("seed", range(70))
def test_drawn_statements(both, seed):
    engine, con, _ = both
    sql, args, ordered = Draw(seed).statement()
    shown = [[render([r]) for r in found] for found in (engine.rows(sql, args), con.execute(sql, args).fetchall())]
    assert shown[0] == shown[1] if ordered else sorted(shown[0]) == sorted(shown[1]), (sql, args)


def test_forms_that_are_seldom_drawn(both):
    engine, con, _ = both
    for sql, args in [
        ("SELECT rowid, oid, _rowid_, day FROM reading WHERE rowid BETWEEN 55 AND 90 ORDER BY oid DESC", []), ("SELECT sid, rowid FROM station WHERE rowid = ?", [-40]),
        ("SELECT count(*) FROM station a JOIN station b ON a.zone = b.zone WHERE a.height > 3", []), ("SELECT a.rowid, b.rowid FROM reading a, reading b WHERE a.temp = b.rowid ORDER BY b.rowid, a.rowid DESC LIMIT 5", []),
        ("SELECT count(*), sum(n), total(n), min(s), avg(n) FROM blank", []), ("SELECT n, rowid FROM blank", []), ("SELECT count(*) FROM reading LIMIT 1 OFFSET 1", []),
        ("SELECT temp AS t, count(*) AS n FROM reading WHERE temp <> ?1 AND temp <> ?1 AND day > ?2 GROUP BY temp ORDER BY n DESC, t -- end", [3, 2]),
        ("SELECT count(*) FROM reading WHERE " + " AND ".join(f"temp <> {k}" for k in range(-40, 0)), []), ("SELECT flux, count(*), min(flux) FROM reading WHERE flux < ? GROUP BY flux ORDER BY flux LIMIT 4", [2.0**63]),
        ("SELECT min(aid), max(aid), count(*) FROM alarm", []), ("SELECT count(*) FROM alarm WHERE aid = ? AND level > 99", [1]),
    ]:
        assert render(engine.rows(sql, args)) == render(con.execute(sql, args).fetchall()), sql


def test_names_and_statements(both):
    engine, _, _ = both
    assert engine.prepare('SELECT [kind of], p.`level`, rowid, p.* FROM alarm p').columns == ["kind of", "level", "rowid", "aid", "at", "level", "stamp", "kind of"]
    assert engine.query("SELECT Count(*), sum( r.temp ), day AS d FROM reading r GROUP BY day").columns == ["count(*)", "sum(r.temp)", "d"]
    statement = engine.prepare("SELECT count(*) FROM station WHERE zone = ? AND sid < ?")
    assert [statement.query(a).first()[0] for a in ([1, 500], [9, 500], [1])] == [15, 0, 0]  # a missing argument is null
    assert engine.prepare("SELECT sid FROM station") is engine.prepare("SELECT sid FROM station")


@pytest.mark.parametrize(
    ("error", "texts"),
    [
        (SemanticError, ["SELECT a FROM absent", "SELECT absent FROM alarm", "SELECT z.aid FROM alarm", "SELECT alarm.aid FROM alarm z", "SELECT aid FROM alarm ORDER BY 0", "SELECT aid FROM alarm ORDER BY 2", "SELECT aid FROM alarm ORDER BY max(aid)",
                         "SELECT count(*) FROM alarm ORDER BY absent", "SELECT rowid FROM alarm x, alarm y WHERE x.at = y.level", "SELECT aid FROM alarm, alarm WHERE 1 < level", "SELECT absent.* FROM alarm"]),
        (UnsupportedError, ["SELECT sum(town) FROM station", "SELECT zone FROM station GROUP BY zone ORDER BY avg(town)", "SELECT sid, count(*) FROM station", "SELECT sid FROM station GROUP BY zone", "SELECT zone FROM station GROUP BY zone ORDER BY sid",
                            "SELECT sid FROM station, alarm", "SELECT sid FROM station JOIN alarm ON sid = at AND zone = level", "SELECT sid FROM station WHERE sid = zone", "SELECT sid FROM station WHERE lat > 1", "SELECT sid FROM station WHERE town = 1",
                            "SELECT sid FROM station x, alarm y, reading z WHERE sid = at", "SELECT sid FROM station JOIN reading ON town = note"]),
    ],
)
def test_refusals(both, error, texts):
    for sql in texts:
        with pytest.raises(error):
            both[0].query(sql)


@pytest.mark.parametrize(("sql", "args"), [("WHERE sid = ?", ["1"]), ("LIMIT ?", [1.5]), ("LIMIT ?", []), ("WHERE sid = ?", [1, 2]), ("LIMIT 2 OFFSET ?", [b"1"]), ("WHERE sid > ?", [object()])])
def test_binds(both, sql, args):
    with pytest.raises(BindError):
        both[0].query(f"SELECT sid FROM station {sql}", args)


def test_import(both, spark, tmp_path):
    engine, con, top = both
    assert engine.table("ALARM").key == "aid" and engine.table("reading").key is None
    assert [f.name for f in engine.table("reading").fields] == ["day", "station", "temp", "rain", "note", "flux"]
    assert engine.table("station").field("town").metadata["sparrowql.declared"] == "TEXT"
    again = Engine(spark)
    assert again.open(top) == ["alarm", "blank", "reading", "station"] and again.table("alarm").key == "aid" and again.table("alarm").in_order
    again.cache("station")
    assert again.rows("SELECT oid, town FROM station WHERE zone > 1 LIMIT 2") == engine.rows("SELECT oid, town FROM station WHERE zone > 1 LIMIT 2")
    again.table("station").frame.unpersist()
    for k, ddl in enumerate(("CREATE TABLE t(a INTEGER PRIMARY KEY) WITHOUT ROWID", "CREATE TABLE t(a); INSERT INTO t VALUES (1), ('x')", "CREATE TABLE t(a); INSERT INTO t VALUES (x'00')", "CREATE TABLE t(rowid, oid, _rowid_)")):
        path = str(tmp_path / f"{k}.db")
        with sqlite3.connect(path) as other:
            other.executescript("CREATE TABLE station(x); INSERT INTO station VALUES (1);" + ddl)
        with pytest.raises(UnsupportedError):
            Engine(spark).import_sqlite(path, top)
    assert engine.rows("SELECT count(*) FROM station")[0][0] == STATIONS  # nothing was replaced


def test_indexes_and_ranges_of_rows(spark, tmp_path, monkeypatch):
    from sparrowql.sources import sqlite as source

    monkeypatch.setattr(source, "PARTITION_ROWS", 40)
    monkeypatch.setattr(source, "PASS_COLUMNS", 2)
    with sqlite3.connect(tmp_path / "x.db") as con:
        con.executescript("CREATE TABLE t(a INTEGER PRIMARY KEY, b INTEGER, c TEXT, d REAL); CREATE INDEX i ON t(b); CREATE INDEX j ON t(c); CREATE INDEX k ON t(b, d)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(k**5, k, str(k), k / 2) for k in range(100)])
    (layout,) = source.layouts(str(tmp_path / "x.db"))
    assert layout.indexes == ("b",) and layout.ranges == ((0, 39**5), (40**5, 79**5), (80**5, 99**5))
    engine = Engine(spark)
    engine.import_sqlite(str(tmp_path / "x.db"), str(tmp_path))
    assert engine.rows("SELECT count(*), sum(b), max(a) FROM t")[0] == (100, 4950, 99**5)
    assert [r[0] for r in engine.rows("SELECT b FROM t WHERE b > 30 LIMIT 3 OFFSET 40")] == [71, 72, 73]


def test_sums_overflow_at_the_end_alone(spark):
    engine, top = Engine(spark), 2**63 - 1
    engine.register("t", spark.createDataFrame([("a", top), ("a", top), ("a", -top), ("b", top), ("b", 1), ("c", None)], "k string, v long"))
    engine.register("a", spark.createDataFrame([(top,), (top,), (-top,)], "v long"))
    assert engine.rows("SELECT sum(v), avg(v), total(v) FROM a")[0] == (top, top / 3, float(top))
    with pytest.raises(IntegerOverflowError):
        engine.rows("SELECT k, sum(v) FROM t GROUP BY k")
    engine.register("u", spark.createDataFrame([(2**31 - 1, -5)] * 3, "k int, v short"))
    assert engine.rows("SELECT sum(k), sum(v), avg(v) FROM u")[0] == (3 * (2**31 - 1), -15, -5.0)


def test_row_ids_of_files_and_frames(spark, tmp_path):
    engine, path = Engine(spark), str(tmp_path / "some parts.parquet")
    frame = spark.range(0, 100, 1, 4).selectExpr("99 - id as v", "id % 3 as _path", "cast(id as string) as `a``b`", "cast(id % 5 as int) as `c``d`")
    frame.write.parquet(path)
    engine.register_parquet("files", path)
    frame.write.partitionBy("_path").parquet(str(tmp_path / "dealt.parquet"))
    engine.register_parquet("dealt", str(tmp_path / "dealt.parquet"))
    first = engine.rows("SELECT _path, v FROM dealt LIMIT 3")
    assert first == engine.rows("SELECT _path, v FROM dealt ORDER BY rowid LIMIT 3") and {r[0] for r in first} == {0}
    engine.register("frame", frame)
    for name in ("files", "frame"):
        assert [tuple(r) for r in engine.rows(f"SELECT rowid, v FROM {name} ORDER BY rowid")] == [(i + 1, 99 - i) for i in range(100)]
        assert [r[0] for r in engine.rows(f"SELECT v FROM {name} WHERE v < 90 LIMIT 3")] == [89, 88, 87]
        assert [tuple(r) for r in engine.rows(f'SELECT "a`b", _path FROM {name} WHERE "c`d" = 3 ORDER BY v DESC LIMIT 2')] == [("3", 0), ("8", 2)]
        assert engine.rows(f'SELECT count(*) FROM {name} x JOIN {name} y ON x."c`d" = y.v')[0][0] == 100
    with pytest.raises(SemanticError):
        engine.register("bad", spark.range(3), key="nothing")


def test_saved_tables_keep_their_marks(both, spark, tmp_path):
    engine = Engine(spark)
    engine.register("keyed", spark.createDataFrame([(i, i * i % 7) for i in (5, 3, 9)], "id long, v int"), key="id")
    engine.register("loose", spark.createDataFrame([("x",), ("y",)], "s string").coalesce(1))
    engine.catalog.add(both[0].table("alarm"))
    sql = {"keyed": "SELECT rowid, v FROM keyed WHERE rowid >= 3", "loose": "SELECT rowid, s FROM loose WHERE rowid > 1", "alarm": "SELECT rowid, stamp FROM alarm LIMIT 3"}
    before = {name: engine.rows(text) for name, text in sql.items()}
    for name in sql:
        engine.save(name, str(tmp_path / f"{name}.parquet"))
    again = Engine(spark)
    assert again.open(str(tmp_path)) == ["alarm", "keyed", "loose"]
    assert (again.table("keyed").key, again.table("loose").key, again.table("alarm").indexes) == ("id", None, engine.table("alarm").indexes)
    for name, text in sql.items():
        assert sorted(again.rows(text)) == sorted(before[name])
    assert [f.name for f in again.table("loose").fields] == ["s"] and again.table("keyed").in_order


def plan(engine, sql, *args):
    return engine.query(sql, args)._jdf.queryExecution().toString()


def test_plans(both):
    engine = both[0]
    assert "PushedAggregation: [COUNT(*), MIN(level), MAX(level)]" in plan(engine, "SELECT count(*), min(level), max(level) FROM alarm")
    text = plan(engine, "SELECT aid FROM alarm WHERE level > ? AND level > ? AND stamp <> 3", 1, 2.5)
    assert "GreaterThanOrEqual(level,3)" in text and "ReadSchema: struct<aid:bigint,level:bigint,stamp:bigint>" in text.split("== Physical Plan ==")[1]
    assert "TakeOrderedAndProject" in plan(engine, "SELECT aid, level FROM alarm ORDER BY level DESC LIMIT 20 OFFSET 10")
    assert "FileScan" not in plan(engine, "SELECT count(*) FROM alarm WHERE level > 9 AND level < 9").split("== Physical Plan ==")[1]
    assert "Python" not in text
    grouped = "SELECT level, count(*) FROM alarm GROUP BY level"
    assert "rangepartitioning" not in plan(engine, grouped)
    ordered = Engine(engine.spark, ordered_groups=True)
    ordered.catalog.add(engine.table("alarm"))
    assert [r[0] for r in ordered.rows(grouped)] == [0, 1, 2, 3, 4]


def test_limits_stop_early(spark, tmp_path, monkeypatch):
    """LIMIT without ORDER BY reads one split, and the joined side in place of the whole first table."""
    path = str(tmp_path / "long.parquet")
    spark.range(0, 40000, 1, 8).selectExpr("id", "id % 100 as v").write.parquet(path)
    engine = Engine(spark)
    engine.register_parquet("long", path, "id", in_order=True)
    engine.register("small", spark.range(50).selectExpr("id as k"), key="k")
    read = []
    monkeypatch.setattr(builder.Table, "first_files", lambda self, n, f=builder.Table.first_files: (read.append((n, f(self, n).frame.count(), f(self, n).frame.rdd.getNumPartitions())), f(self, n))[1])
    for sql, want, files in [
        ("SELECT id FROM long LIMIT 4", [0, 1, 2, 3], [1]), ("SELECT id FROM long WHERE v = 7 LIMIT 2 OFFSET 3", [307, 407], [1]), ("SELECT id FROM long JOIN small ON v = k LIMIT 3", [0, 1, 2], [1]),
        ("SELECT id FROM long WHERE id > 39000 LIMIT 2", [39001, 39002], [1]), ("SELECT id FROM long JOIN small ON id = k WHERE v > 48", [49], []), ("SELECT id FROM long JOIN small ON id = k WHERE v = 49 LIMIT 3", [49], [1]),
    ]:
        read.clear()
        frame = engine.query(sql)
        scans = frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("FileScan")
        assert read == [(n, 5000, 1) for n in files] and scans == (0 if files and len(want) > 1 or "WHERE v = 49" in sql else 1), sql
        assert [r.id for r in frame.collect()] == want
    monkeypatch.setattr(builder, "EARLY_FILES", 1)
    monkeypatch.setattr(builder, "EARLY_LEFT", 5)
    assert [r.id for r in engine.rows("SELECT id FROM long WHERE id > 39000 LIMIT 2")] == [39001, 39002]
    assert [r.id for r in engine.rows("SELECT id FROM long JOIN small ON v = k WHERE v > 45 LIMIT 6")] == [46, 47, 48, 49, 146, 147]
    assert engine.query("SELECT id FROM long WHERE v > 1").agg(F.count("id")).first()[0] == 39200
