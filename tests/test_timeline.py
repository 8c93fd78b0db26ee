import json
import random

import pytest

from tidewater.operators import timeline


def tree(rng, depth=0):
    kind = rng.randrange(6 if depth < 4 else 4)
    if kind == 4:
        return [tree(rng, depth + 1) for _ in range(rng.randrange(5))]
    if kind == 5:
        return {rng.choice("ab/~c"): tree(rng, depth + 1) for _ in range(rng.randrange(4))}
    return rng.choice([None, True, 1, 1.5, "x", ""])


def test_patches_of_differences_round_trip():
    rng = random.Random(5)
    for _ in range(2000):
        a, b = tree(rng), tree(rng)
        assert timeline.canonical(timeline.patched(a, timeline.difference(a, b))) == timeline.canonical(b)
        assert timeline.difference(a, json.loads(json.dumps(a))) == []


@pytest.mark.parametrize("op", [{"op": "remove", "path": "/x"}, {"op": "add", "path": "/a", "value": 1}, {"op": "replace", "path": "/b/7", "value": 1}, {"op": "remove", "path": ""}])
def test_strict_patches(op):
    with pytest.raises(ValueError):
        timeline.patched({"a": 1, "b": [1]}, [op])


def test_replay_reports_corrupt_runs(spark):
    rows = [("r", 2, "patch", '[{"op":"add","path":"/b","value":2}]'), ("r", 1, "full", '{"a":1}'), ("r", 3, "patch", '[{"op":"remove","path":"/zz"}]'), ("r", 4, "patch", "[]"), ("r", 5, "full", "{}"), ("s", 1, "patch", "[]"), ("t", 1, "full", None)]
    got = {(r["run"], r["seq"]): r["status"] for r in timeline.replay(spark.createDataFrame(rows, "run string, seq int, kind string, body string")).collect()}
    assert got == {("r", 1): "ok", ("r", 2): "ok", ("r", 3): "corrupt", ("r", 4): "corrupt", ("r", 5): "ok", ("s", 1): "corrupt", ("t", 1): "corrupt"}
