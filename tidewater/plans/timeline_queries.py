"""Queries over state timelines: conversations stand in for runs, turns for steps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import timeline
from tidewater.plans.registry import query
from tidewater.session import table


def states(spark, sf_dir):
    state = F.to_json(F.struct(F.struct(F.col("turn").alias("n")).alias("at"), F.array(F.lit("a"), F.col("role")).alias("list"), F.col("role")))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), state.alias("state"))


STATE = """'{"at":{"n":' || turn || '},"list":["a","' || role || '"],"role":"' || role || '"}'"""


@query("w_prefix_state", f"select conv_id run, turn seq, sha256({STATE}) state_hash, 'ok' status from conversations")
def w_prefix_state(spark, sf_dir):
    before = F.lag("state").over(Window.partitionBy("run").orderBy("seq"))
    rows = states(spark, sf_dir).withColumn("before", before)
    kind = F.when(F.col("before").isNull(), "full").otherwise("patch")
    return timeline.replay(rows.select("run", "seq", kind.alias("kind"), F.coalesce(timeline.json_difference(F.col("before"), F.col("state")), "state").alias("body")))


@query("fn_json_diff", """select conv_id run, turn seq, '[{"op":"replace","path":"/at/n","value":' || turn || '}' || case when role <> p then ',{"op":"replace","path":"/list/1","value":"' || role || '"},{"op":"replace","path":"/role","value":"' || role || '"}' else '' end || ']' ops
from (select *, lag(role) over (partition by conv_id order by turn) p from conversations) where p is not null""")
def fn_json_diff(spark, sf_dir):
    before = F.lag("state").over(Window.partitionBy("run").orderBy("seq"))
    rows = states(spark, sf_dir).withColumn("before", before).where("before is not null")
    return rows.select("run", "seq", timeline.json_difference(F.col("before"), F.col("state")).alias("ops"))


@query("fn_json_search", "select conv_id run, turn seq, case when role = 'user' then '/list/1,/role' else '' end as paths from conversations")
def fn_json_search(spark, sf_dir):
    return states(spark, sf_dir).select("run", "seq", F.array_join(timeline.search(F.col("state"), "USER"), ",").alias("paths"))
