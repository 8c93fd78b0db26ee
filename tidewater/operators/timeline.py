"""State timelines: differences of JSON states, patches, and replay of full and patch artifacts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(value: Any) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _step(name: Any) -> str:
    return "/" + str(name).replace("~", "~0").replace("/", "~1")


def difference(a: Any, b: Any, path: str = "") -> list[dict[str, Any]]:
    """Operations that make b of a: by key in order of keys; in lists beyond what both begin and end with."""
    if type(a) is type(b) and isinstance(a, dict):
        out = []
        for k in sorted(a.keys() | b.keys()):
            if k not in b:
                out.append({"op": "remove", "path": path + _step(k)})
            elif k not in a:
                out.append({"op": "add", "path": path + _step(k), "value": b[k]})
            else:
                out += difference(a[k], b[k], path + _step(k))
        return out
    if type(a) is type(b) and isinstance(a, list):
        head = 0
        while head < min(len(a), len(b)) and canonical(a[head]) == canonical(b[head]):
            head += 1
        tail = 0
        while tail < min(len(a), len(b)) - head and canonical(a[-1 - tail]) == canonical(b[-1 - tail]):
            tail += 1
        old, new = a[head : len(a) - tail], b[head : len(b) - tail]
        both = min(len(old), len(new))
        out = [o for i in range(both) for o in difference(old[i], new[i], path + _step(head + i))]
        out += [{"op": "remove", "path": path + _step(head + i)} for i in range(len(old) - 1, both - 1, -1)]
        return out + [{"op": "add", "path": path + _step(head + i), "value": new[i]} for i in range(both, len(new))]
    return [] if canonical(a) == canonical(b) else [{"op": "replace", "path": path, "value": b}]


def patched(state: Any, operations: list[dict[str, Any]]) -> Any:
    """The state after the operations; ValueError where a place is missing or taken."""
    state = json.loads(json.dumps(state))
    for o in operations:
        if o["path"] == "":
            if o["op"] != "replace":
                raise ValueError("the root can only be replaced")
            state = o["value"]
            continue
        steps = [s.replace("~1", "/").replace("~0", "~") for s in o["path"][1:].split("/")]
        at = state
        for s in steps[:-1]:
            at = _child(at, s)
        last = steps[-1]
        if isinstance(at, list):
            i = int(last) if last.isdigit() else -1
            if not 0 <= i <= len(at) - (o["op"] != "add"):
                raise ValueError(f"no place {o['path']}")
            if o["op"] == "add":
                at.insert(i, o["value"])
            elif o["op"] == "remove":
                del at[i]
            else:
                at[i] = o["value"]
        elif isinstance(at, dict) and (last in at) != (o["op"] == "add"):
            if o["op"] == "remove":
                del at[last]
            else:
                at[last] = o["value"]
        else:
            raise ValueError(f"no place {o['path']}")
    return state


def _child(at: Any, step: str) -> Any:
    if isinstance(at, dict) and step in at:
        return at[step]
    if isinstance(at, list) and step.isdigit() and int(step) < len(at):
        return at[int(step)]
    raise ValueError(f"no step {step}")


def json_difference(before: Column, after: Column) -> Column:
    """Operations between two JSON texts as JSON; null where either is none."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> str | None:
            try:
                return canonical(difference(json.loads(x), json.loads(y)))
            except (TypeError, ValueError):
                return None

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return run(before, after)


def replay(artifacts: DataFrame) -> DataFrame:
    """artifacts(run, seq, kind 'full' or 'patch', body) -> (run, seq, state_hash, status).

    Runs are dealt out by id and come sorted by seq; a task keeps one state at a time,
    however long the run. A patch that does not fit, or comes before any full state, gives
    the status 'corrupt' and no hash, and so do all after it up to the next full one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, sound = None, None, False
        for batch in batches:
            hashes, status = [], []
            for r, kind, body in zip(batch["run"], batch["kind"], batch["body"]):
                if r != key:
                    key, sound = r, False
                try:
                    if kind == "full":
                        state, sound = json.loads(body), True
                    elif sound:
                        state = patched(state, json.loads(body))
                except (TypeError, ValueError, KeyError):
                    sound = False
                hashes.append(hashlib.sha256(canonical(state).encode()).hexdigest() if sound else None)
                status.append("ok" if sound else "corrupt")
            yield pd.DataFrame({"run": batch["run"], "seq": batch["seq"], "state_hash": hashes, "status": status})

    kinds = dict(artifacts.dtypes)
    dealt = artifacts.select("run", "seq", "kind", "body").repartition("run").sortWithinPartitions("run", "seq")
    return dealt.mapInPandas(run, f"run {kinds['run']}, seq {kinds['seq']}, state_hash string, status string")


def search(doc: Column, term: str) -> Column:
    """Pointers of the keys and scalars of a JSON text that hold a term, case ignored, depth first."""
    low = term.lower()

    @F.pandas_udf("array<string>")
    def run(docs: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            found: list[str] = []
            try:
                todo = [("", None, json.loads(text))]
            except (TypeError, ValueError):
                return found
            while todo:
                path, key, value = todo.pop()
                inner = list(value.items()) if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []
                hit = isinstance(key, str) and low in key.lower()
                if hit or (not isinstance(value, (dict, list)) and low in (value if isinstance(value, str) else canonical(value)).lower()):
                    found.append(path)
                todo += [(path + _step(k), k, v) for k, v in reversed(inner)]
            return found

        return docs.map(one)

    return run(doc)
