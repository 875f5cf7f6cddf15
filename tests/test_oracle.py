"""Every query that has SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def shown(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", SQL)
def test_same_as_duckdb(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert shown([tuple(r) for r in got.collect()], got.columns) == shown(cursor.fetchall(), names)


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
