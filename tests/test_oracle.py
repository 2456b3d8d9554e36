"""Every query with SQL against DuckDB over whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for f in os.listdir(tiny):
        name = f.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{f}'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return str(v) if v is not None else None


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, tiny, name):
    df = entry.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    out = duck.execute(SQL[name])
    own = [c[0] for c in out.description]
    assert sorted(own) == columns
    want = sorted((tuple(plain(r[own.index(c)]) for c in columns) for r in out.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
