"""Pages under a budget against a reader who asks for one page after another."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import paging
from tidewater.session import Scratch


def _page(run, total, start, events, limit, budget):
    """One page as its text would be, with events of the given sizes."""

    def size(chosen, form):
        more = len(chosen) < len(events)
        page = {"runId": run, "total": total, "matching": len(events), "shown": len(chosen), "returned": len(chosen), "from": start, "hasMore": more}
        if more and chosen:
            page["nextSeq"] = chosen[-1][0] + 1
        page["events"] = []
        return len(json.dumps(page, separators=(",", ":"), ensure_ascii=False).encode()) + 1 + sum(e[form] for e in chosen) + max(len(chosen) - 1, 0)

    chosen = events[:limit]
    tries = [(chosen, 1, "full"), (chosen, 2, "capped"), (chosen, 3, "compact"), *((chosen[:k], 3, "shrunk") for k in range(len(chosen) - 1, 0, -1)), ([], 3, "summary")]
    for c, form, name in tries:
        if size(c, form) <= budget:
            return c, name, size(c, form)
    return [], "too_small", size([], 3)


def _read(runs, limit, budget, begin):
    told = []
    for run, events in runs.items():
        start, total = begin, len(events)
        while True:
            left = sorted(e for e in events if e[0] >= start)
            if not left:
                break
            shown, form, size = _page(run, total, start, left, limit, budget)
            after = shown[-1][0] + 1 if shown and len(shown) < len(left) else None
            told.append((run, start, total, len(left), len(shown), form, size, len(shown) < len(left), after))
            if after is None:
                break
            start = after
    return told


@pytest.mark.parametrize(("limit", "budget", "block", "begin"), [(5, 700, 5, 0), (7, 900, 16, 3), (12, 1500, 64, 0), (3, 160, 4, 0), (1, 400, 1, 0)])
def test_pages(spark, limit, budget, block, begin):
    rng = random.Random(limit)
    runs = {}
    for r in range(12):
        run, seq = rng.choice(["r", 'q"', "é"]) + str(r), -1
        for _ in range(rng.choice([1, 2, 9, 60, 150])):
            seq += rng.choice([1, 1, 4])
            compact = rng.choice([20, 60, 100, 100, 300 if r % 3 else 2000 if rng.random() < 0.05 else 50])
            capped = compact + rng.randrange(60)
            runs.setdefault(run, []).append((seq, capped + rng.choice([0, 500]), capped, compact))
    rows = [(run, *e) for run, events in runs.items() for e in events]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + [(None, 1, 1, 1, 1), ("r0", None, 1, 1, 1)], "run string, seq long, full int, capped int, compact int")
    got = [tuple(r) for r in paging.pages(df, Scratch(spark, "p"), limit, budget, begin, block=block).collect()]
    want = _read(runs, limit, budget, begin)
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({w[5] for w in want}) >= 2
    assert all(w[6] <= budget or w[5] == "too_small" for w in want)


def test_no_events(spark):
    df = spark.createDataFrame([], "run string, seq long, full int, capped int, compact int")
    assert paging.pages(df, Scratch(spark, "p")).count() == 0
    some = spark.createDataFrame([("a", 1, 9, 9, 9)], "run string, seq long, full int, capped int, compact int")
    assert paging.pages(some, Scratch(spark, "p"), matching=F.lit(False)).count() == 0
    assert [r["form"] for r in paging.pages(some, Scratch(spark, "p")).collect()] == ["full"]
