"""Every registered query against its SQL on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from cloudgrid.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = Counter(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    cursor = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(repr(tuple(r[columns.index(c)] for c in sorted(columns))) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() >= 0
