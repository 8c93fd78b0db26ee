"""Graphs as edge tables: breadth-first traversal, closure of endpoints, two-tier dependency edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import Scratch


def traverse(edges: DataFrame, starts: DataFrame, scratch: Scratch, depth: int = 25) -> DataFrame:
    """edges(src, dst), starts(node) -> (node, depth): least number of steps from any start, up to `depth`.

    Each round joins the frontier alone and takes out nodes that are known, so cycles end
    and no path is walked twice. Frontiers are written to the shared folder.
    """
    seen = scratch.keep(starts.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "bfs-0")
    front = seen
    steps = edges.select(F.col("src").alias("node"), "dst").where("dst is not null").distinct()
    for d in range(1, depth + 1):
        after = front.join(steps, "node").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        front = scratch.keep(after, f"bfs-{d}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def close_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(node, known) with a row for each endpoint that has none."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.select("node", F.lit(True).alias("known")).union(ends.join(nodes, "node", "left_anti").select("node", F.lit(False).alias("known")))
