"""Registered queries take the whole of their tables."""

import functools

import duckdb

import __spark_entry__ as entry
from parlor.sources.tables import SCHEMAS

FOLDER = "/root/testdata/sf0.001"


@functools.cache
def n_orders(spark):
    return spark.read.parquet(f"{FOLDER}/orders.parquet").count()


def run(spark, name):
    return entry.queries()[name](spark, FOLDER)


def test_every_order_asks_for_a_name(spark):
    for name in ("next_version", "unique_filenames"):
        assert run(spark, name).select("seq").distinct().count() == n_orders(spark)


def test_all_declared_tables_are_reported(spark):
    assert sorted(r["table_name"] for r in run(spark, "load_tables").collect()) == sorted(SCHEMAS)


def test_make_owner_returns_the_other_grants(spark):
    assert run(spark, "make_owner").where("resource_id <> '*'").count() == entry.Tables(spark, FOLDER).hub_media.count()


def test_twin_numbers_more_than_3000_names_of_a_base():
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, '2-HIGH' AS o_orderpriority FROM range(100000) t(i)")
    got = con.execute(f"SELECT count(*), count(DISTINCT (parent_id, unique_name)) FROM ({entry.oracle_sql()['unique_filenames']})").fetchone()
    assert got == (100000, 100000)
