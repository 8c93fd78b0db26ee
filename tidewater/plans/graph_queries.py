"""Queries over graphs. Customers, orders and nations stand in for a call graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import graph
from tidewater.plans.registry import query
from tidewater.session import Scratch, table

EDGES = "edges as (select distinct o_custkey src, (o_custkey * 7 + o_orderkey % 3) % (select count(*) from customer) dst from orders)"


def edges(spark, sf_dir):
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").crossJoin(F.broadcast(n))
    return o.select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 3) % F.col("n")).alias("dst")).distinct()


@query("g_traverse", f"with recursive {EDGES}, r(node, depth) as (select 1::bigint, 0 union select dst, depth + 1 from r join edges on src = node where depth < 25) select node, min(depth) depth from r group by 1")
def g_traverse(spark, sf_dir):
    starts = spark.range(1, 2).select(F.col("id").alias("node"))
    return graph.traverse(edges(spark, sf_dir), starts, Scratch(spark, "traverse"))


@query("g_nodes_close", f"with {EDGES} select node, bool_or(known) known from (select c_custkey node, true known from customer union all select src, false from edges union all select dst, false from edges) group by 1")
def g_nodes_close(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return graph.close_nodes(nodes, edges(spark, sf_dir))


@query("g_event_env_values", "select user_id, case when count(distinct props) = 1 then 'resolved' else 'ambiguous' end status from events where event_type = 'signup' group by 1")
def g_event_env_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy("user_id")
    return rows.agg(F.when(F.count_distinct("props") == 1, "resolved").otherwise("ambiguous").alias("status"))


@query("g_ownership", """select l.l_orderkey, l.l_linenumber, coalesce(case when s.s_acctbal > 0 then s.s_name end, p.p_name, 'none') as owner
from lineitem l left join supplier s on l.l_suppkey = s.s_suppkey left join part p on l.l_partkey = p.p_partkey""")
def g_ownership(spark, sf_dir):
    l, s, p = (table(spark, sf_dir, n) for n in ("lineitem", "supplier", "part"))
    found = l.join(s, l.l_suppkey == s.s_suppkey, "left").join(p, l.l_partkey == p.p_partkey, "left")
    return found.select("l_orderkey", "l_linenumber", F.coalesce(F.when(F.col("s_acctbal") > 0, F.col("s_name")), "p_name", F.lit("none")).alias("owner"))
