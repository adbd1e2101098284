"""Every registered query of the document engine against its SQL in DuckDB, on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

from fernstore import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    found = duck.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    rows = found.fetchall()
    assert got == sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in rows), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.SQL) <= set(entry.oracle_sql()) and set(queries.QUERIES) <= set(entry.queries())
