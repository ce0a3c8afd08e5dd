"""Every query against its SQL on the smallest set."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(SQL[name])
    order = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert ours == sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not n[1:2].isdigit()))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["content_id", "common", "state", "pay", "bio", "special", "uz", "findings_count", "advice"] and df.count() > 0
