"""Every query runs on the smallest tables, and equals its SQL where it has some."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = {k: f for m in entry._MODULES for k, f in __import__(m, fromlist=["x"]).queries().items()}
SQL = {k: q for m in entry._MODULES for k, q in __import__(m, fromlist=["x"]).oracle_sql().items()}


def norm(rows):
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, data, sql, name):
    df = CORE[name](spark, data)
    columns = sorted(df.columns)
    rows = norm(map(tuple, df.select(*columns).collect()))
    if name in SQL:
        r = sql.sql(SQL[name])
        there = list(r.columns)
        assert sorted(there) == columns
        at = [there.index(c) for c in columns]
        assert rows == norm(tuple(x[i] for i in at) for x in r.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(CORE) <= set(entry.queries())


def test_a_subpackage_that_fails_to_import_takes_nothing_down(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, entry._OPTIONAL, None)
    assert set(entry.queries()) == set(CORE)
