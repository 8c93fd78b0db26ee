"""A traversal's observations as a compact graph: numbered nodes and edges, dictionaries, a few references an edge.

Observations are (ordinal, step, type, status, confidence, decision, source, target, site, refs):
source and target are structs of key, kind, label, repo, file, line, site is one of repo, file,
start, end, line, refs an array of structs of kind and value (all strings but ordinal, step,
lines, offsets and confidence). Ordinals are unique. Confidences are brought into 0 to 1, null and
those that are no finite number are 0. An observation whose source or target has no key is
left out; other nulls are values like any other. Labels are taken as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.numbering import number
from tidewater.session import Scratch

#: Observations of one edge agree in these.
SAME = ["step", "type", "source_key", "target_key", "status", "confidence", "decision"]
#: References shown of each kind.
SHOWN = 5


def _observed(observations: DataFrame) -> DataFrame:
    given = F.col("confidence").cast("double")
    finite = given.isNotNull() & ~F.isnan(given) & (F.abs(given) < float("inf"))
    confidence = F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), given))).otherwise(0.0)
    keyed = observations.where("source.key is not null and target.key is not null")
    return keyed.withColumns({"source_key": F.col("source.key"), "target_key": F.col("target.key"), "confidence": confidence})


def _body(node: Column) -> Column:
    """What the bodies of one key are ordered by: their JSON text."""
    texts = F.to_json(F.array(*(node[c] for c in ("kind", "label", "repo", "file"))))
    return F.concat(texts, F.lit(","), F.coalesce(node["line"].cast("string"), F.lit("null")))


def dictionary(values: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """(column, n): its distinct values but null, numbered in the order of their bytes."""
    return number(values.select(column).where(F.col(column).isNotNull()).distinct(), [column], scratch, f"dictionary-{column}")


def nodes(observations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, n, kind, label, repo, file, line), and the dictionaries (repo, n) and (file, n) that repo and file point into.

    One row a key, with its least body, numbered in the order of keys' bytes.
    """
    ends = _observed(observations).select(F.explode(F.array("source", "target")).alias("v"))
    least = ends.groupBy(F.col("v.key").alias("key")).agg(F.min_by("v", _body(F.col("v"))).alias("v"))
    numbered = number(least.select("key", *(F.col(f"v.{c}") for c in ("kind", "label", "repo", "file", "line"))), ["key"], scratch, "nodes")
    repos, files = dictionary(numbered, "repo", scratch), dictionary(numbered, "file", scratch)
    told = numbered.join(repos.select("repo", F.col("n").alias("repo_n")), "repo", "left").join(files.select("file", F.col("n").alias("file_n")), "file", "left")
    return told.select("key", "n", "kind", "label", F.col("repo_n").alias("repo"), F.col("file_n").alias("file"), "line"), repos, files


def edges(observations: DataFrame, numbered: DataFrame, scratch: Scratch) -> DataFrame:
    """(n, SAME..., from, to, count, first_ordinal): observations that agree in SAME are one edge.

    Edges are numbered by step, source, target, type, status, least site and least ordinal. The
    ordinals of an edge are rows of `members`, as there may be any number of them.
    """
    last = F.lit(2**62)  # an unknown offset or line
    site = F.struct(*(F.coalesce(F.col(f"site.{c}").cast("string"), F.lit("")).alias(c) for c in ("repo", "file")), *(F.coalesce(F.col(f"site.{c}"), last).alias(c) for c in ("start", "end", "line")))
    grouped = _observed(observations).groupBy(*SAME).agg(F.count("*").alias("count"), F.min("ordinal").alias("first_ordinal"), F.min(site).alias("site"))
    for side, end in (("source_key", "from"), ("target_key", "to")):
        grouped = grouped.join(numbered.select(F.col("key").alias(side), F.col("n").alias(end)), side)
    return number(grouped, ["step", "from", "to", "type", "status", "site", "first_ordinal"], scratch, "edges").drop("site")


def members(observations: DataFrame, told: DataFrame) -> DataFrame:
    """(edge, ordinal, refs): which edge each observation went into."""
    o, e = _observed(observations).alias("o"), told.select("n", *SAME).alias("e")
    agree = [F.col(f"o.{c}").eqNullSafe(F.col(f"e.{c}")) for c in SAME]
    return o.join(e, agree).select(F.col("e.n").alias("edge"), "o.ordinal", "o.refs")


def references(placed: DataFrame) -> DataFrame:
    """members -> (edge, kind, values, total, shown, omitted): an edge's distinct references by kind, the SHOWN least of them.

    Whole numbers come first, by value, then other texts by their bytes; null references count for nothing.
    """
    each = placed.select("edge", F.inline("refs")).where("kind is not null and value is not null").distinct()
    totals = each.groupBy("edge", "kind").agg(F.count("*").alias("total"))
    whole = F.when(F.col("value").rlike(r"\A-?[0-9]{1,18}\z"), F.col("value").cast("long"))
    rank = F.row_number().over(Window.partitionBy("edge", "kind").orderBy(whole.asc_nulls_last(), "value"))
    few = each.withColumn("k", rank).where(F.col("k") <= SHOWN).groupBy("edge", "kind").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("few"))
    shown = F.size("few").cast("long")
    return totals.join(few, ["edge", "kind"]).select("edge", "kind", F.col("few.value").alias("values"), "total", shown.alias("shown"), (F.col("total") - shown).alias("omitted"))


def statuses(told: DataFrame) -> DataFrame:
    """edges -> (status, observations, edges, collapsed): how many observations of each status, and how many went into others' edges."""
    counts = told.groupBy("status").agg(F.sum("count").alias("observations"), F.count("*").alias("edges"))
    return counts.select("*", (F.col("observations") - F.col("edges")).alias("collapsed"))
