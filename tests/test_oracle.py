"""Every registered query against its SQL twin on whole tables of the smallest data set."""

import functools

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, table_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@functools.cache
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    got = [tuple(r.values()) for r in df.toArrow().to_pylist()]
    if name not in TWINS:
        assert got
        return
    cur = database().execute(TWINS[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert table_rows(df.columns, got) == table_rows(columns, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["owner_id", "entity_id", "room_count"]


def test_twins_have_queries():
    assert not set(TWINS) - set(QUERIES)
