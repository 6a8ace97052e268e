"""Every query of the package runs on the smallest tables, has the columns asked for, and equals its SQL where it has some."""

import glob
import os

import duckdb
import pytest

from triscope.llm.queries import oracle_sql, queries

FOUND = {"p3_found": ["file_id", "field"], "p4_found": ["check_id", "field", "pos"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "subject_code"]}


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, data, sql, name):
    df = queries()[name](spark, data)
    assert df.columns == FOUND.get(name, df.columns)
    rows = df.collect()
    assert rows and (name not in FOUND or len(set(rows)) == len(rows))
    if name in oracle_sql():
        want = sql.sql(oracle_sql()[name])
        at = [list(want.columns).index(c) for c in df.columns]
        assert sorted(map(repr, map(tuple, rows))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
