"""Every registered query gives the rows its SQL gives, on the small tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.run import TABLES, rows_of

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, FOLDER)
    rows = df.collect()
    sql = oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, rows) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
