"""URL filters: a sort-merge range join of reversed hosts with nested rules.

A host's canonical key is its labels in reverse, each followed by a low separator that no
label holds (`host_key` escapes it): the subdomains of a host are then exactly the keys
that begin with its key, an interval, and intervals of rules are nested or apart.

1. Places of urls (key, path, a hash of the page) are cut into ranges at quantiles of a
   bounded sample of places. The sample only decides how evenly work is shared out; a very
   common host, or one very common url, is spread over as many ranges as it needs.
2. A url goes to its range, a rule to every range that its interval meets, so rules that
   enclose the start of a range are carried into it. Nothing passes through the driver but
   the sampled bounds.
3. Each task sweeps its sorted rules and urls once and keeps a stack of the open rules.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\x01"
LAST = "\U0010ffff"
#: Sampled places for each range.
SAMPLED = 32


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' where there is no '://'."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by SEP; '\\x00', '\\x01' and '\\x02' within labels are written as '\\x02' and another letter."""
    plain = host
    for sign, told in (("\x02", "\x02e"), (SEP, "\x02b"), ("\x00", "\x02a")):
        plain = F.replace(plain, F.lit(sign), F.lit(told))
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), SEP), F.lit(SEP)))


def split_rule(rule: str) -> tuple[str, str]:
    """('example.net', '/en/') of 'example.net/en/'."""
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def _range_of(place: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are at or below the place, by two counts of about a square root of them each."""
    if not bounds:
        return F.lit(0)
    step = int(np.ceil(np.sqrt(len(bounds))))
    every = F.array(*(F.lit(b) for b in bounds))
    above = F.size(F.filter(F.array(*(F.lit(b) for b in bounds[step - 1 :: step])), lambda b: b <= place))
    return above * step + F.size(F.filter(F.slice(every, above * step + 1, F.lit(step)), lambda b: b <= place))


def _bounds(places: DataFrame, ranges: int) -> list[str]:
    sampled = places.orderBy(F.xxhash64("place"), "place").limit(SAMPLED * ranges)
    found = sorted(r["place"] for r in sampled.select("place").collect())  # as many as the limit says
    at = [len(found) * k // ranges for k in range(1, ranges)]
    return sorted({found[i] for i in at if i < len(found)}, key=lambda t: t.encode("utf-8", "surrogatepass"))


def _fitting(stack: list[tuple[str, dict, list[int]]], path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest open rule that fits the path."""
    best = None
    for _, rules, lengths in stack:
        for n in lengths:
            if n > len(path):
                break
            fit = rules.get(path[:n])
            if fit and (best is None or (-len(fit[0]), fit[0]) < (-len(best[0]), best[0])):
                best = fit
    return best


def sweep(default: str):
    """Rows come sorted by (range, place), a rule before the urls in its interval; one row is given for each url."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: int | None = None
        stack: list[tuple[str, dict, list[int]]] = []  # key; (rule, verdict) by path; lengths of the paths
        for rows in batches:
            n = len(rows)
            is_rule = rows["is_rule"].to_numpy(dtype=bool)
            cols = [rows[c].to_numpy() for c in ("range", "key", "path")]
            new = np.ones(n, dtype=bool)
            new[1:] = is_rule[1:] | is_rule[:-1]
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            begins = np.flatnonzero(new)
            rule, verdict = np.full(n, None, dtype=object), np.full(n, default, dtype=object)
            told = rows["rule"].to_numpy(), rows["verdict"].to_numpy()
            for i, end in zip(begins.tolist(), [*begins[1:].tolist(), n]):  # a run of one url, or a rule
                r, key, path = (c[i] for c in cols)
                if r != at:
                    at, stack = r, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if is_rule[i]:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    _, rules, lengths = stack[-1]
                    where = bisect_left(lengths, len(path))
                    if where == len(lengths) or lengths[where] != len(path):
                        lengths.insert(where, len(path))
                    have = rules.get(path)
                    if have is None or told[0][i] < have[0]:
                        rules[path] = (told[0][i], told[1][i])
                elif key:
                    fit = _fitting(stack, path)
                    if fit:
                        rule[i:end], verdict[i:end] = fit
            yield rows[["page_id", "host", "path"]].assign(rule=rule, verdict=verdict)[~is_rule]

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages(page_id, url, ...), rules(verdict, rule) -> (page_id, host, path, rule, verdict), one row per page.

    A rule 'host/path' fits the host and its subdomains where the url's path starts with
    '/path'; the longest rule that fits wins (by characters; of two as long, the first in
    order of text; of one rule with two verdicts, 'allow'). Without a rule the verdict is
    `default`. A null url, or one without '://', has an empty host and path and fits no
    rule. Control characters in a host are characters like others. Repeated pages are judged
    each; null page_ids are kept; other columns are ignored. Rules that are null or without
    a host don't count. No pages: no rows.
    """
    kind = dict(pages.dtypes)["page_id"]
    rules = rules.where("rule is not null and verdict is not null").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    url = F.col("url")
    urls = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("key", host_key(F.col("host")))
    page = F.hex(F.xxhash64("page_id"))
    urls = urls.withColumn("place", F.concat("key", F.lit("\x00"), "path", F.lit("\x00"), page))
    ranges = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(urls, ranges)
    host = F.lower(F.substring_index("rule", "/", 1))
    path = F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)")
    told = rules.select("rule", "verdict", host_key(host).alias("key"), path.alias("path")).where("key <> ''")
    covers = F.sequence(_range_of(F.col("key"), bounds), _range_of(F.concat("key", F.lit(LAST)), bounds))
    told = told.select(F.explode(covers).alias("range"), F.lit(True).alias("is_rule"), "key", F.col("key").alias("place"), F.lit(None).cast(kind).alias("page_id"), F.lit("").alias("host"), "path", "rule", "verdict")
    nothing = F.lit(None).cast("string")
    dealt = urls.select(_range_of(F.col("place"), bounds).alias("range"), F.lit(False).alias("is_rule"), "key", "place", "page_id", "host", "path", nothing.alias("rule"), nothing.alias("verdict"))
    met = dealt.unionByName(told).repartition("range").sortWithinPartitions("range", "place").drop("place")
    return met.mapInPandas(sweep(default), f"page_id {kind}, host string, path string, rule string, verdict string")
