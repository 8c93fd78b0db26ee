"""Summaries of HTTP trace events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shown_url(normalized: Column, url: Column, path: Column) -> Column:
    """Path and query of the first of the three that says something; blank texts stay as they are."""
    said = F.coalesce(F.nullif(normalized, F.lit("")), F.nullif(url, F.lit("")), path, F.lit(""))
    rest = F.regexp_extract(F.trim(said), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^#]*)", 1)
    rooted = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.trim(said) == "", said).otherwise(rooted)


def url_summaries(events: DataFrame, *by: str) -> DataFrame:
    """events(by.., shown_url, method, status, duration_ms, at, pos) -> one row per url.

    Distinct methods in order, events in all and by class of status (others, and null, are
    unknown), and status, duration and time of the latest event; of those at one time the one
    with the larger pos. Events without a time are never the latest while others have one.
    """
    status = F.col("status")
    classes = [F.coalesce((status >= 100 * k) & (status < 100 * k + 100), F.lit(False)) for k in (2, 3, 4, 5)]
    unknown = ~(classes[0] | classes[1] | classes[2] | classes[3])
    last = F.max(F.struct("at", "pos", "status", "duration_ms")).alias("last")
    found = events.groupBy(*by, "shown_url").agg(
        F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods"), F.count("*").alias("total"),
        *(F.count_if(c).alias(f"n_{k}xx") for k, c in zip((2, 3, 4, 5), classes)), F.count_if(unknown).alias("n_unknown"), last,
    )
    return found.select("*", F.col("last.status").alias("last_status"), F.col("last.duration_ms").alias("last_duration_ms"), F.col("last.at").alias("last_at")).drop("last")
