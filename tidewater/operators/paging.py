"""Pages of runs under a budget of bytes: every page of every run, whatever a run's length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.numbering import number
from tidewater.session import Scratch

#: Rows that are one block.
BLOCK = 50_000
#: The text around a page's events, without its values: a fixed format.
AROUND = '{"runId":"","total":,"matching":,"shown":,"returned":,"from":,"hasMore":,"events":[]}\n'
NEXT = ',"nextSeq":'
PAGE = "run string, from_seq long, total long, matching long, shown long, form string, bytes long, has_more boolean, next_seq long"
_POWERS = 10 ** np.arange(1, 19, dtype=np.int64)


def _digits(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(_POWERS, np.abs(x), side="right") + 1 + (x < 0)


class _Block:
    """The page that begins at each row of a block: how many events it shows, in which form, its bytes, the row after it."""

    def __init__(self, rows: pd.DataFrame, block: int, size: int, limit: int, budget: int, begin: int):
        rows = rows.sort_values("n", ignore_index=True)
        self.low, self.high = block * size, (block + 1) * size
        n, seq, first = (rows[c].to_numpy(np.int64) for c in ("n", "seq", "first"))
        own = np.flatnonzero((n >= self.low) & (n < self.high))
        sums = {c: np.concatenate([[0], np.cumsum(rows[c].to_numpy(np.int64))]) for c in ("full", "capped", "compact")}
        left = (first + rows["matching"].to_numpy(np.int64) - n)[own]
        before = np.where(n[own] > first[own], seq[own - 1] + 1, begin)
        fixed = len(AROUND) + rows["run_bytes"].to_numpy(np.int64)[own] + _digits(rows["total"].to_numpy(np.int64)[own]) + _digits(left) + _digits(before)

        def weight(form: str, k: np.ndarray) -> np.ndarray:
            after = (k > 0) & (k < left)
            tail = np.where(after, len(NEXT) + _digits(seq[np.maximum(own + k - 1, 0)] + 1), 0)
            return sums[form][own + k] - sums[form][own] + fixed + 2 * _digits(k) + np.where(k < left, 4, 5) + tail + np.maximum(k - 1, 0)

        most = np.minimum(limit, left)
        # the most events in compact form that fit: with fewer events than are left, more events are more bytes
        low, high = np.zeros_like(most), most - 1
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = weight("compact", middle) <= budget
            low, high = np.where(fits, middle, low), np.where(fits, high, np.maximum(middle - 1, low))
        shown, form, size_of = low, np.where(low > 0, "shrunk", "summary").astype(object), weight("compact", low)
        form[(low == 0) & (size_of > budget)] = "too_small"
        for name in ("compact", "capped", "full"):
            whole = weight(name, most)
            fits = whole <= budget
            shown, form, size_of = np.where(fits, most, shown), np.where(fits, name, form), np.where(fits, whole, size_of)
        self.rows, self.own, self.shown, self.form, self.bytes = rows, own, shown, form, size_of
        self.before, self.left, self.seq = before, left, seq
        self.starts = np.flatnonzero(n[own] == first[own])
        self.first_of_last = int(first[own[-1]])
        # -1: the run ends, or nothing fits
        self.after = np.where((shown == 0) | (shown == left), -1, n[own] + shown)

    def way_out(self, limit: int) -> list[int]:
        """For no row and each of the first `limit` rows that a page may begin at: where in the next block pages go on, or -1."""
        after, low, high = self.after.tolist(), self.low, self.high
        out = [-1] * len(after)
        for i in range(len(after) - 1, -1, -1):
            a = after[i]
            out[i] = -1 if a < 0 else a - high if a >= high else out[a - low]
        if self.first_of_last >= low:  # the run that goes on begins here, whatever came before
            return [out[self.first_of_last - low]] * (limit + 1)
        return [-1, *out[:limit], *[-1] * max(0, limit - len(out))]

    def pages(self, entry: int) -> pd.DataFrame:
        met = []
        for at in [*self.starts.tolist(), *([entry] if entry >= 0 else [])]:
            while 0 <= at < len(self.own):
                met.append(at)
                at = int(self.after[at]) - self.low
        at = np.array(met, dtype=np.int64)
        own, k = self.own[at], self.shown[at]
        more = k < self.left[at]
        following = pd.Series(self.seq[np.maximum(own + k - 1, 0)] + 1, dtype="Int64").where((k > 0) & more)
        of = self.rows.iloc[own].reset_index(drop=True)
        return pd.DataFrame({"run": of["run"], "from_seq": self.before[at], "total": of["total"], "matching": self.left[at], "shown": k, "form": self.form[at], "bytes": self.bytes[at], "has_more": more, "next_seq": following})


def pages(events: DataFrame, scratch: Scratch, limit: int = 100, budget: int = 65_536, begin: int = 0, matching: Column | None = None, block: int = BLOCK) -> DataFrame:
    """events(run, seq, full, capped, compact) -> PAGE: the pages that a reader of each run is led through.

    full, capped and compact are the bytes of an event's text in three forms, from most to
    least. A page holds the next `limit` events from `from_seq` on that fit `matching`. If it is
    longer than `budget` with all of them in full, they are all capped, else all compact, and only
    then events are left out from the end (form shrunk). Where not even one fits, the page is a
    summary without events, and the run ends there; too_small if the summary is over the budget
    too. bytes are those of the whole text, with the texts around the events and a last newline.
    The next page begins at next_seq, which is null on a run's last page.

    Rows with a null run or seq are left out, seqs below `begin` do not match but count in
    total; a null size is 0 bytes. Events of a run differ in seq, and runs without matching
    events have no page.

    The page that would begin at a row depends on the `limit` rows from there on alone, so
    blocks of rows, with so many rows of the next, are worked out apart from each other. A
    block then tells, for each row that a page may come in at, where it leaves; these tables are
    put together in doubling steps, and no task sees a run.
    """
    size = max(block, limit)
    given = events.where("run is not null and seq is not null")
    rows = given.select(F.col("run").cast("string").alias("run"), F.col("seq").cast("long").alias("seq"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("full", "capped", "compact")), (F.col("seq") >= begin if matching is None else (F.col("seq") >= begin) & F.coalesce(matching, F.lit(False))).alias("fits"))
    totals = rows.groupBy("run").agg(F.count("*").alias("total"))
    placed = number(rows.where("fits").drop("fits"), ["run", "seq", "full", "capped", "compact"], scratch, "events")
    runs = placed.groupBy("run").agg(F.min("n").alias("first"), F.count("*").alias("matching")).join(totals, "run")
    runs = scratch.keep(runs.withColumn("run_bytes", F.octet_length(F.to_json(F.struct("run"))).cast("long") - len('{"run":""}')), "runs")
    n, b = F.col("n"), F.floor(F.col("n") / size)
    blocks = F.array_distinct(F.array_compact(F.array(b, F.floor((n + 1) / size), F.when((b > 0) & (n - b * size < limit), b - 1))))
    dealt = scratch.keep(placed.withColumn("block", F.explode(blocks)).join(runs, "run"), "dealt")

    def own(rows: pd.DataFrame) -> _Block | None:
        i = int(rows["block"].iloc[0])
        inside = ((rows["n"] >= i * size) & (rows["n"] < (i + 1) * size)).any()
        return _Block(rows, i, size, limit, budget, begin) if inside else None  # the block after the last row is none

    def outs(rows: pd.DataFrame) -> pd.DataFrame:
        held = own(rows)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "out": [held.way_out(limit)]}) if held else pd.DataFrame(columns=["block", "out"], dtype=object)

    ways = scratch.keep(dealt.groupBy("block").applyInPandas(outs, "block long, out array<long>"), "ways-0")
    last = ways.agg(F.max("block")).first()[0]
    step = 1
    while step <= (last or 0):
        earlier = ways.select((F.col("block") + step).alias("block"), F.col("out").alias("earlier"))
        joined = F.transform("earlier", lambda v: F.get("out", (v + 1).cast("int")))
        ways = scratch.keep(ways.join(earlier, "block", "left").select("block", F.coalesce(joined, F.col("out")).alias("out")), f"ways-{step}")
        step *= 2
    entries = ways.select((F.col("block") + 1).alias("block"), F.get("out", F.lit(0)).alias("entry"))

    def told(rows: pd.DataFrame) -> pd.DataFrame:
        held = own(rows)
        if held is None:
            return pd.DataFrame(columns=[c.split()[0] for c in PAGE.split(", ")], dtype=object)
        entry = rows["entry"].iloc[0]
        return held.pages(-1 if pd.isna(entry) else int(entry))

    return dealt.join(entries, "block", "left").groupBy("block").applyInPandas(told, PAGE)
