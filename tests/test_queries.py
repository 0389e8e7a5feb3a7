"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(columns, data):
    return Counter(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, db, data, tmp_path):
    got = entry.queries()[name](spark, data)
    columns = sorted(got.columns)
    got.write.parquet(f"{tmp_path}/out")
    sel = ", ".join(f'"{c}"' for c in columns)
    ours = db.sql(f"select {sel} from '{tmp_path}/out/*.parquet'")
    theirs = db.sql(SQL[name])
    assert sorted(theirs.columns) == columns
    assert rows(columns, ours.fetchall()) == rows(columns, theirs.select(sel).fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert "citation" in df.columns and df.count() > 0
