"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tools.check import TABLES, rows_of
import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.CORPUS])  # those have tests of their own
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want, want_cols = rows_of(columns, cur.fetchall())
    have, have_cols = rows_of(df.columns, got)
    assert have_cols == want_cols
    assert have == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
