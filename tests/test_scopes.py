"""Traversal with contexts against a walk one state at a time, and operation hops."""

import random
from collections import deque

import pytest

from tidewater.operators import scopes
from tidewater.session import Scratch


def walk(edges, starts, depth):
    """The same rule with a queue: every hop and its kind."""
    queue, scheduled, children, hops = deque(), set(), {}, []
    for _, scope, context in sorted(starts):
        if (scope, context) not in scheduled:
            scheduled.add((scope, context))
            queue.append((scope, context, {scope}, 0))
    while queue:
        scope, context, ancestry, d = queue.popleft()
        if d >= depth:
            continue
        for i, src, dst, binds in sorted(edges):
            if src != scope:
                continue
            state = (dst, context if binds is None else binds)

            def reaches(start, target):
                pending, seen = [start], set()
                while pending:
                    x = pending.pop()
                    if x not in seen:
                        seen.add(x)
                        if x[0] == target:
                            return True
                        pending.extend(children.get(x, ()))
                return False

            cycle = dst in ancestry or reaches(state, scope)
            children.setdefault((scope, context), set()).add(state)
            kind = "cycle" if cycle else "converged" if state in scheduled else "scheduled"
            if kind == "scheduled":
                scheduled.add(state)
                queue.append((*state, ancestry | {dst}, d + 1))
            hops.append((d, scope, context, i, *state, kind))
    return hops


@pytest.mark.parametrize("seed, depth", [(1, 25), (2, 25), (3, 3)])
def test_traverse(spark, seed, depth):
    rng = random.Random(seed)
    n = 9
    edges = [(i, rng.randrange(n), rng.randrange(n), rng.choice([None, None, None, "x", "y"])) for i in range(22)]
    starts = [(0, 0, ""), (1, 3, "x"), (2, 0, "")]
    rows = spark.createDataFrame(edges + [(90, None, 1, None), (91, 1, None, None)], "id long, src long, dst long, binds string")
    found = scopes.traverse(rows, spark.createDataFrame([*starts, (5, None, "")], "id long, scope long, context string"), Scratch(spark, "t"), depth)
    want = walk(edges, starts, depth)
    got = found.select("depth", "src", "src_context", "edge", "dst", "context", "kind").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {"cycle", "converged", "scheduled"} == {h[-1] for h in want} or depth == 3


def test_mutual_branches_close_a_cycle(spark):
    """b and c lead to each other: the hop met second closes the circle."""
    edges = [(1, "a", "b", None), (2, "a", "c", None), (3, "b", "c", None), (4, "c", "b", None)]
    found = scopes.traverse(spark.createDataFrame(edges, "id long, src string, dst string, binds string"), spark.createDataFrame([(0, "a", None)], "id long, scope string, context string"), Scratch(spark, "t"))
    assert {r["edge"]: r["kind"] for r in found.collect()} == {1: "scheduled", 2: "scheduled", 3: "converged", 4: "cycle"}


def test_nothing_to_traverse(spark):
    edges = spark.createDataFrame([], "id long, src string, dst string, binds string")
    starts = spark.createDataFrame([(0, "a", None)], "id long, scope string, context string")
    assert scopes.traverse(edges, starts, Scratch(spark, "t")).count() == 0
    assert scopes.traverse(edges, starts, Scratch(spark, "t"), 0).count() == 0


def test_operation_hops(spark):
    calls = spark.createDataFrame([(1, "s", "o1"), (2, "t", "o1"), (3, "s", "o2"), (4, "s", "o3"), (5, "s", None), (6, "u", "o4")], "id long, src string, operation string")
    impl = spark.createDataFrame([("o1", "m1", "resolved"), ("o2", "m2", "ambiguous"), ("o3", "m3", "resolved"), ("o4", "m4", "resolved")], "operation string, method string, status string")
    hints = spark.createDataFrame([("t", "o1", "m9"), (None, "o4", "m1"), ("x", "o4", "m9")], "src string, operation string, method string")
    handlers = spark.createDataFrame([("m1", "h1"), ("m9", "h9"), ("m2", "h2"), ("m4", "h4")], "method string, scope string")
    got = {r["id"]: (r["method"], r["dst"], r["how"]) for r in scopes.operation_hops(calls, impl, hints, handlers).collect()}
    assert got == {1: ("m1", "h1", "resolved"), 2: ("m9", "h9", "hinted"), 3: (None, None, "unresolved"), 4: ("m3", None, "missing_handler"), 5: (None, None, "unresolved"), 6: ("m1", "h1", "hinted")}


def test_cycles_of_the_own_way_only(spark):
    edges = [(1, "a", "b", None), (2, "a", "c", None), (3, "b", "c", None), (4, "c", "b", None), (5, "b", "a", "x")]
    rows = spark.createDataFrame(edges, "id long, src string, dst string, binds string")
    found = scopes.traverse(rows, spark.createDataFrame([(0, "a", None)], "id long, scope string, context string"), Scratch(spark, "t"), over_branches=False)
    assert {r["edge"]: r["kind"] for r in found.collect()} == {1: "scheduled", 2: "scheduled", 3: "converged", 4: "converged", 5: "cycle"}
