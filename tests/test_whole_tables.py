"""Queries that take their tables whole, on small tables of their own."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.operators import logs
from tidewater.plans import registry


@pytest.fixture()
def tables(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def test_whole_graph(spark, tables):
    keys = range(1, 2001)
    tables("customer", [(k,) for k in keys], "c_custkey long")
    sf = tables("orders", [(k, k * 3 + j) for k in keys for j in range(3)], "o_custkey long, o_orderkey long")
    edges = {k: {(k * 7 + j) % 2000 for j in range(3)} for k in keys}
    want, front = {1: 0}, {1}
    for d in range(1, 26):
        front = {n for f in front for n in edges.get(f, ())} - set(want)
        want |= dict.fromkeys(front, d)
    got = {r["node"]: r["depth"] for r in registry.QUERIES["g_traverse"](spark, sf).collect()}
    assert got == want and max(got) > 1000
    known = {r["node"]: r["known"] for r in registry.QUERIES["g_nodes_close"](spark, sf).collect()}
    assert known == {0: False} | dict.fromkeys(keys, True)


def test_every_line_is_looked_up(spark, tables):
    tables("supplier", [(1, "S1", 5.0), (2, "S2", -1.0)], "s_suppkey long, s_name string, s_acctbal double")
    tables("part", [(1, "P1")], "p_partkey long, p_name string")
    sf = tables("lineitem", [(1, 1, 1, 1, 3.0), (1, 2, 2, 1, 46.0), (2, 1, 3, 9, 50.0)], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double")
    assert {tuple(r) for r in registry.QUERIES["j_refmap"](spark, sf).collect()} == {(1, 1, "S1"), (1, 2, "S2"), (2, 1, None)}
    assert {tuple(r) for r in registry.QUERIES["g_ownership"](spark, sf).collect()} == {(1, 1, "S1"), (1, 2, "P1"), (2, 1, "none")}


def test_months_of_every_customer(spark, tables):
    days = [(k, datetime.datetime(2020, 12, 31)) for k in range(1, 60)] + [(7, datetime.datetime(2021, 2, 1))]
    sf = tables("orders", days, "o_custkey long, o_orderdate timestamp")
    got = {tuple(r) for r in registry.QUERIES["fn_month_range"](spark, sf).collect()}
    assert got == {(k, "202012") for k in range(1, 60)} | {(7, "202101"), (7, "202102")}


def test_whole_cells_and_messages(spark, tables):
    page = "x" * 50 + 'a "b", c'
    sf = tables("pages", [(1, page), (2, "y" * 90), (3, None)], "page_id long, html string")
    got = dict(tuple(r) for r in registry.QUERIES["fn_csv_escape"](spark, sf).collect())
    assert got == {1: '"' + page.replace('"', '""') + '"', 2: "y" * 90, 3: ""}
    texts = [" a \n b ", "z" * 500, "z" * 501]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(logs.compacted(F.col("t")))
    assert [r[0] for r in rows.collect()] == ["a b", "z" * 500, "z" * 497 + "..."]


def test_orders_of_any_priority_count(spark, tables):
    tables("customer", [(k,) for k in (1, 2, 3, 4, None)], "c_custkey long")
    sf = tables("orders", [(1, "1-URGENT"), (2, "5-LOW"), (2, "3-MEDIUM"), (3, None), (None, "1-URGENT")], "o_custkey long, o_orderpriority string")
    got = sorted(repr(tuple(r)) for r in registry.QUERIES["j_anti"](spark, sf).collect())
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet/*.parquet')")
    assert got == ["(4,)", "(None,)"] == sorted(map(repr, con.sql(registry.ORACLES["j_anti"]).fetchall()))
