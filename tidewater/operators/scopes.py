"""Breadth-first traversal of scopes that carry a context, and the hops from calls over operations to handlers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import Scratch

STATE = ["scope", "context"]


def traverse(edges: DataFrame, starts: DataFrame, scratch: Scratch, depth: int = 25, over_branches: bool = True) -> DataFrame:
    """edges(id, src, dst, binds), starts(id, scope, context) -> every hop, as (depth, src, src_context, edge, dst, context, kind).

    A state is a scope with a context; a hop to `dst` has the context that the edge binds, or
    that of the state it leaves where `binds` is null. States are expanded once, in order of
    their depth and then of the edges' ids along the way that first led to them, up to
    `depth` (states of that depth are not expanded). Kinds of hops:

    * cycle: the scope is one of those on the way to the state that the hop leaves, or (with
      `over_branches`) that state's scope can be reached again from the hop's target over hops
      recorded before, which other branches may have made;
    * converged: the state was met before, or earlier in this order;
    * scheduled: the state is new and will be expanded.

    Ids are unique and not null; rows with a null src, dst or scope are passed over, a null
    context is ''. Each state keeps the scopes and edge ids on its way, `depth` + 1 at most.
    States are appended to one table; a round joins the frontier with the edges and its targets
    with that table, so nothing passes through the driver but whether a round found anything.
    `over_branches` follows each converged hop through what was recorded before it: its work is
    that of traces, converged hops times what they lead to. Leave it off for whole dense graphs.
    """
    spark = starts.sparkSession
    steps = edges.where("src is not null and dst is not null").select(F.col("id").cast("long").alias("edge"), "src", "dst", "binds")
    first = starts.where("scope is not null").groupBy("scope", F.coalesce("context", F.lit("")).alias("context")).agg(F.min(F.col("id").cast("long")).alias("id"))
    front = first.select(*STATE, F.array("id").alias("way"), F.array("scope").alias("ancestry"), F.lit(0).alias("depth"))
    states, hops = f"{scratch.base}/states", f"{scratch.base}/hops"
    front.write.parquet(states)
    kind = front.schema
    front = spark.read.schema(kind).parquet(states)
    found_schema = None
    for d in range(depth):
        out = front.join(steps, F.col("scope") == F.col("src")).select(
            F.lit(d).alias("depth"), "src", F.col("context").alias("src_context"), "edge", "dst", F.coalesce("binds", "context").alias("context"),
            F.concat("way", F.array("edge")).alias("way"), "ancestry", F.array_contains("ancestry", F.col("dst")).alias("back"),
        )
        out = scratch.keep(out, f"out-{d}")
        known = spark.read.schema(kind).parquet(states).select(F.col("scope").alias("dst"), "context", F.lit(True).alias("known"))
        free = out.where(~F.col("back")).groupBy("dst", "context").agg(F.min("way").alias("first")).join(known, ["dst", "context"], "left")
        told = out.join(free, ["dst", "context"], "left")
        is_new = ~F.col("back") & F.col("known").isNull() & (F.col("way") == F.col("first"))
        told = scratch.keep(told.select("depth", "src", "src_context", "edge", "dst", "context", "way", "ancestry", F.when(F.col("back"), "cycle").when(is_new, "scheduled").otherwise("converged").alias("kind")), f"told-{d}")
        told.drop("ancestry").write.mode("append").parquet(hops)
        found_schema = told.drop("ancestry").schema
        new = told.where("kind = 'scheduled'").select(F.col("dst").alias("scope"), "context", "way", F.concat("ancestry", F.array("dst")).alias("ancestry"), F.lit(d + 1).alias("depth"))
        front = scratch.keep(new, f"front-{d}")
        if front.isEmpty():
            break
        front.write.mode("append").parquet(states)
    if found_schema is None:
        empty = front.join(steps, F.lit(False))
        return empty.select("depth", "src", F.col("context").alias("src_context"), "edge", "dst", "context", F.lit("").alias("kind"))
    found = spark.read.schema(found_schema).parquet(hops)
    return (_closed(found, scratch) if over_branches else found).drop("way")


def _closed(hops: DataFrame, scratch: Scratch) -> DataFrame:
    """Converged hops from whose target the left scope can be reached over earlier hops are cycles.

    Hops are in the order of (depth, way). Only hops between scopes that lie on a circle can
    be such: targets that nothing leads on from, and sources that nothing leads to, are cut first.
    """
    steps = scratch.keep(hops.select(F.col("src").alias("s"), F.col("src_context").alias("sc"), F.col("dst").alias("t"), F.col("context").alias("tc"), F.struct("depth", "way").alias("at")), "steps")
    asked = hops.where("kind = 'converged'").select("edge", "src_context", "src", F.struct("depth", "way").alias("asked"), F.col("dst").alias("scope"), "context")
    leads_on = steps.select(F.col("s").alias("scope"), F.col("sc").alias("context")).distinct()
    led_to = steps.select(F.col("t").alias("src")).distinct()
    front = scratch.keep(asked.join(leads_on, STATE, "left_semi").join(led_to, "src", "left_semi"), "reach-0")
    seen, cycles, k = front, None, 0
    key = ["edge", "src_context", "scope", "context"]
    while not front.isEmpty():
        k += 1
        after = front.join(steps, (F.col("scope") == F.col("s")) & (F.col("context") == F.col("sc")) & (F.col("at") < F.col("asked")))
        after = scratch.keep(after.select("edge", "src_context", "src", "asked", F.col("t").alias("scope"), F.col("tc").alias("context")).dropDuplicates(key), f"met-{k}")
        done = after.where(F.col("scope") == F.col("src")).select("edge", "src_context").distinct()
        cycles = done if cycles is None else cycles.union(done)
        rest = after.join(done, ["edge", "src_context"], "left_anti").join(seen, key, "left_anti")
        front = scratch.keep(rest, f"reach-{k}")
        seen = seen.unionByName(front)
    if cycles is None:
        return hops
    closing = cycles.distinct().withColumn("closing", F.lit(True))
    found = hops.join(closing, ["edge", "src_context"], "left")
    return found.withColumn("kind", F.when(F.col("closing"), "cycle").otherwise(F.col("kind"))).drop("closing").select(hops.columns)


def operation_hops(calls: DataFrame, implementations: DataFrame, hints: DataFrame, handlers: DataFrame) -> DataFrame:
    """calls(id, src, operation) -> (id, src, operation, method, dst, how), one row a call.

    implementations(operation, method, status): the method is taken where the status is
    'resolved'; hints(src, operation, method) come first, those of the calling scope before
    those with a null src. handlers(method, scope) says where a method's code is. `how` is
    hinted or resolved, missing_handler where the method has none, unresolved without a
    method: these two have no dst, so a walk ends there. The rows with a dst are edges for
    `traverse`. An operation has one implementation row, a (src, operation) one hint and a
    method one handler at most; of more, the least is taken.
    """
    impl = implementations.where("operation is not null").groupBy("operation").agg(F.min(F.when(F.col("status") == "resolved", F.col("method"))).alias("own"))
    own_hints = hints.where("operation is not null and src is not null").groupBy("src", "operation").agg(F.min("method").alias("near"))
    any_hints = hints.where("operation is not null and src is null").groupBy("operation").agg(F.min("method").alias("far"))
    at = handlers.where("method is not null").groupBy("method").agg(F.min("scope").alias("dst"))
    rows = calls.select("id", "src", "operation").join(impl, "operation", "left").join(own_hints, ["src", "operation"], "left").join(any_hints, "operation", "left")
    hinted = F.coalesce("near", "far")
    rows = rows.withColumn("hinted", hinted.isNotNull()).withColumn("method", F.coalesce(hinted, "own")).join(at, "method", "left")
    how = F.when(F.col("method").isNull(), "unresolved").when(F.col("dst").isNull(), "missing_handler").when(F.col("hinted"), "hinted").otherwise("resolved")
    return rows.select("id", "src", "operation", "method", "dst", how.alias("how"))
