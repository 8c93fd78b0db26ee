"""Connected components of an edge table by hooking and contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges(u, v) -> (node, comp): comp is the least node of the component. No edges: no rows.

    Every node hooks onto its least smaller neighbour (an aggregation, so a node with very
    many edges is no hot group); the forest is flattened by jumping to the parent's parent;
    edges are contracted to the trees' roots, and the rest is done again. Each round at
    least halves the nodes that still have edges, so about log n rounds are needed, on
    edge tables that shrink fast.
    """
    tidy = lambda e: e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    left = scratch.keep(tidy(edges), f"{name}-edges-0")
    total = None
    step = 0
    while total is None or not left.isEmpty():
        hooks = scratch.keep(left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("comp"), F.lit(True).alias("moved")), f"{name}-hooks-{step}")
        jump = 0
        while not hooks.where("moved").isEmpty():
            jump += 1
            above = hooks.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            hooks = hooks.join(above, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"), F.col("top").isNotNull().alias("moved"))
            hooks = scratch.keep(hooks, f"{name}-hooks-{step}-{jump}")
        hooks = hooks.select("node", "comp")
        if total is None:
            roots = left.select(F.col("u").alias("node")).distinct().join(hooks, "node", "left_anti")
            total = scratch.keep(hooks.union(roots.select("node", F.col("node").alias("comp"))), f"{name}-{step}")
        else:
            moved = hooks.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            total = scratch.keep(total.join(moved, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), f"{name}-{step}")
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_top"))
        after = left.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("u_top", "u").alias("u"), F.coalesce("v_top", "v").alias("v"))
        step += 1
        left = scratch.keep(tidy(after), f"{name}-edges-{step}")
    return total
