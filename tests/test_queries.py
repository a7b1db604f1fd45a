"""Every query with SQL against DuckDB; the others against their schema."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain():
    return [n for n in entry.QUERIES]


def cells(frame):
    names = sorted(frame.columns)
    show = lambda v: "null" if v is None or v != v else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return names, sorted(tuple(map(show, r)) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", plain())
def test_query(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert cells(got) == cells(con.sql(sql).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["pos", "ts", "total"]
