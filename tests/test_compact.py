"""Numbering and compact graphs against plain loops."""

import json
import random

from pyspark.sql import functions as F

from tidewater.operators import compact
from tidewater.operators.numbering import number
from tidewater.session import Scratch


def test_number(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "é", "z", "", "Z", "a"]), i, rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b int, `odd.name` double").repartition(13)
    got = {r["b"]: r["n"] for r in number(df, ["a", "b"], Scratch(spark, "n"), "x").collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert got == {r[1]: i for i, r in enumerate(want)}
    assert number(df.limit(0), ["a", "b"], Scratch(spark, "n"), "y").columns == ["a", "b", "odd.name", "n"]
    assert number(df.limit(0), ["a", "b"], Scratch(spark, "n"), "z").count() == 0


NODE = "struct<key:string,kind:string,label:string,repo:string,file:string,line:int>"
OBSERVED = f"ordinal int, step int, type string, status string, confidence double, decision string, source {NODE}, target {NODE}, site struct<repo:string,file:string,start:int,end:int,line:int>, refs array<struct<kind:string,value:string>>"


def _graph(rows):
    """The compact graph of a list of observations, one after another."""
    rows = [dict(r, confidence=min(1.0, max(0.0, r["confidence"])) if r["confidence"] is not None and abs(r["confidence"]) < float("inf") else 0.0) for r in rows if r["source"][0] is not None and r["target"][0] is not None]
    nodes = {}
    body = lambda v: json.dumps(v[1:], separators=(",", ":"), ensure_ascii=False)
    for r in rows:
        for v in (r["source"], r["target"]):
            if v[0] not in nodes or body(v).encode() < body(nodes[v[0]]).encode():
                nodes[v[0]] = v
    order = sorted(nodes, key=str.encode)
    repos, files = (sorted({v[i] for v in nodes.values() if v[i] is not None}) for i in (3, 4))
    at = {k: i for i, k in enumerate(order)}
    told = [(k, at[k], nodes[k][1], nodes[k][2], None if nodes[k][3] is None else repos.index(nodes[k][3]), None if nodes[k][4] is None else files.index(nodes[k][4]), nodes[k][5]) for k in order]
    groups = {}
    for r in rows:
        groups.setdefault((r["step"], r["type"], r["source"][0], r["target"][0], r["status"], r["confidence"], r["decision"]), []).append(r)
    site = lambda s: (s[0] or "", s[1] or "", *(10**9 if x is None else x for x in s[2:]))
    place = lambda g: (g[0][0], at[g[0][2]], at[g[0][3]], g[0][1], g[0][4], min(site(r["site"]) for r in g[1]), min(r["ordinal"] for r in g[1]))
    edges, refs = [], {}
    for n, (key, held) in enumerate(sorted(groups.items(), key=place)):
        edges.append((n, key, at[key[2]], at[key[3]], sorted(r["ordinal"] for r in held)))
        for kind in "ab":
            values = sorted({v for r in held for k, v in r["refs"] or [] if k == kind and v is not None}, key=lambda v: (0, int(v), v) if v.lstrip("-").isdigit() else (1, 0, v))
            if values:
                refs[n, kind] = (values[:5], len(values), len(values[:5]), max(len(values) - 5, 0))
    return told, repos, files, edges, refs


def test_graph(spark):
    rng = random.Random(8)
    node = lambda k: (k, rng.choice(["op", "svc"]), rng.choice(["L", "é", 'q"']), rng.choice([None, "r1", "r2"]), rng.choice([None, "f1", "f2"]), rng.choice([None, 2, 10]))
    rows = [{
        "ordinal": i, "step": rng.randrange(2), "type": rng.choice(["t", "u"]), "status": rng.choice(["resolved", "dynamic"]), "confidence": rng.choice([0.5, 7.0, None, float("nan"), float("inf")]), "decision": rng.choice(["{}", "{1}"]),
        "source": node(rng.choice(["a", "b", "é", "Z", None])), "target": node(rng.choice(["a", "c", "d"])), "site": (rng.choice([None, "r"]), rng.choice(["x", "y"]), rng.choice([None, 3, 20]), None, 1),
        "refs": rng.choice([None, [], [(rng.choice("ab"), str(rng.randrange(-3, 30))) for _ in range(9)], [("a", "x"), ("a", None), ("b", "x1")]]),
    } for i in range(400)]
    df = spark.createDataFrame([tuple(r[c] for c in ("ordinal", "step", "type", "status", "confidence", "decision", "source", "target", "site", "refs")) for r in rows], OBSERVED)
    told, repos, files, edges, refs = _graph(rows)
    nodes, r, f = compact.nodes(df, Scratch(spark, "c"))
    assert sorted(map(tuple, nodes.collect()), key=lambda x: x[1]) == told
    assert [x["repo"] for x in r.orderBy("n").collect()] == repos and [x["file"] for x in f.orderBy("n").collect()] == files
    found = compact.edges(df, nodes, Scratch(spark, "c"))
    placed = compact.members(df, found)
    ordinals = {x["edge"]: sorted(x["o"]) for x in placed.groupBy("edge").agg(F.collect_list("ordinal").alias("o")).collect()}
    got = [(x["n"], tuple(x[c] for c in compact.SAME), x["from"], x["to"], ordinals[x["n"]]) for x in found.orderBy("n").collect()]
    assert got == edges and [x["count"] for x in found.orderBy("n").collect()] == [len(e[4]) for e in edges]
    assert {(x["edge"], x["kind"]): (list(x["values"]), x["total"], x["shown"], x["omitted"]) for x in compact.references(placed).collect()} == refs and any(v[3] for v in refs.values())
    counts = {x["status"]: (x["observations"], x["collapsed"]) for x in compact.statuses(found).collect()}
    assert sum(c[0] for c in counts.values()) == sum(r["source"][0] is not None for r in rows) and sum(c[0] - c[1] for c in counts.values()) == len(edges)
    assert compact.edges(df.limit(0), nodes, Scratch(spark, "c")).count() == 0
