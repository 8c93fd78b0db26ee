"""Templates and operation resolution against plain loops."""

import random
import re

import pytest

from tidewater.operators import resolving, spans, templates
from tidewater.session import Scratch

HOLE = re.compile(r"\$\{([^{}]+)\}")


def _match(template, name):
    if not template or not name:
        return None
    keys = [k.strip() for k in HOLE.findall(template)]
    pattern = "([^/]+?)".join(map(re.escape, re.split(r"\$\{[^{}]+\}", template)))
    found = re.fullmatch(pattern, name)
    if not found:
        return None
    values = list(found.groups())
    return keys, values, sorted({k for k, v in zip(keys, values) for j, u in zip(keys, values) if j == k and u != v})


def test_templates(spark):
    rng = random.Random(2)
    parts = ["a", "b", "ab", "${x}", "${y}", "${ x }", "x.y", "v${x}-", "", "\\Q$1"]
    forms = ["/".join(rng.choice(parts) + rng.choice(["", "", "z"]) for _ in range(rng.randrange(1, 4))) for _ in range(120)] + ["${x}", "${x}/${x}", "plain", None, "", "a${x}b${y}c"]
    names = ["/".join(rng.choice(["a", "b", "ab", "abz", "x.y", "va-", "vb-z", "q", "xzy", "\\Q$1"]) for _ in range(rng.randrange(1, 4))) for _ in range(120)] + ["plain", "q/q", "q/r", None, "", "a1b2c", "a1b2b3c"]
    t = spark.createDataFrame([(i, x, 0) for i, x in enumerate(forms)], "tid int, template string, nid int")
    n = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "nid int, name string")
    got = {(r["tid"], r["nid"]): (list(r["keys"]), list(r["values"]), sorted(r["conflicts"])) for r in templates.matches(t, n).collect()}
    want = {(i, j): m for i, x in enumerate(forms) for j, y in enumerate(names) if (m := _match(x, y)) is not None}
    assert got == want and any(m[2] for m in want.values()) and any(len(m[0]) == 2 and not m[2] for m in want.values())
    assert templates.matches(t, n.limit(0)).count() == 0 == templates.matches(t.limit(0), n).count()


def test_missing_variables(spark):
    rows = [(1, "evt/${env}/created", {"env": "dev"}), (2, "evt/${env}/${what}", {"env": "dev"}), (3, "${a}/dev/${a}", None), (4, "evt/${env}/created", {}), (5, "other/${z}", {})]
    t = spark.createDataFrame(rows, "tid int, template string, vars map<string,string>")
    n = spark.createDataFrame([(1, "evt/dev/created"), (2, "evt/prod/created"), (3, "x/dev/y"), (4, "nothing")], "nid int, name string")
    assert {r["nid"]: r["missing"] for r in templates.missing_variables(t, n).collect()} == {1: ["env", "what"], 2: ["env"]}


def _shuffled(plan):
    """Rows that each exchange of an executed plan has written."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _shuffled(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return _shuffled(plan.plan())
    own = [plan.metrics().apply("shuffleRecordsWritten").value()] if plan.nodeName() == "Exchange" else []
    return own + [n for i in range(plan.children().size()) for n in _shuffled(plan.children().apply(i))]


@pytest.fixture
def shuffling(spark):
    """No table counts as small."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield spark
    for k in keys:
        spark.conf.unset(k)


def test_templates_of_many_ids(shuffling):
    """The ids of equal texts meet last: what is shuffled grows with the ids, not with the pairs."""
    spark = shuffling
    t = spark.range(700).selectExpr("id tid", "concat('$', if(id < 690, '{x}/a', '{y}/b')) template")
    n = spark.range(500).selectExpr("id nid", "if(id < 450, concat('q', id % 50, '/a'), concat('r', id, '/b')) name")
    found = templates.matches(t, n)
    rows = found.collect()
    want = {(i, j) for i in range(690) for j in range(450)} | {(i, j) for i in range(690, 700) for j in range(450, 500)}
    assert len(rows) == len(want) and {(r["tid"], r["nid"]) for r in rows} == want
    assert {(r["keys"][0], r["values"][0]) for r in rows if r["nid"] in (0, 460)} == {("x", "q0"), ("y", "r460")}
    assert max(_shuffled(found._jdf.queryExecution().executedPlan())) <= 1200


def test_missing_variables_of_many_ids(shuffling):
    spark = shuffling
    t = spark.range(3000).selectExpr("id tid", "concat('$', '{x}/', '$', '{y}') template", "if(id % 2 = 0, map('x', 'q'), map()) vars")
    n = spark.range(600).selectExpr("id nid", "if(id < 400, 'q/a', if(id < 500, 'r/a', 'none')) name")
    found = templates.missing_variables(t, n)
    assert {r["nid"]: r["missing"] for r in found.collect()} == {i: ["x", "y"] for i in range(500)}
    assert max(_shuffled(found._jdf.queryExecution().executedPlan())) <= 3000


def _resolve(call, operations, owners):
    path, spath, sname, alias, dest, repo, dynamic, override = call
    missing = list(dict.fromkeys(k.strip() for s in (spath, alias, dest, path) for k in HOLE.findall(s or "")))
    name = (path or "").removeprefix("/")
    simple = name.split(".")[-1]
    rows = [o for o in operations if path and not HOLE.search(path) and (o["operation_path"] in (path, "/" + simple) or o["operation_name"] in (name, simple))]
    if missing:
        return "dynamic", None, len(rows), None, [f"missing_variable:{k}" for k in missing]
    if not path:
        return "unresolved", None, 0, None, ["missing_operation_path"]
    last = (sname or "").split(".")[-1]

    def told(o):
        if o["qualified_name"] == sname:
            return 0.8, "exact_local_qualified_service_name"
        if o["service_name"] in (sname, last):
            return 0.75, "exact_local_simple_service_name"
        if o["service_path"] in (sname, "/" + sname, "/" + last):
            return 0.7, "exact_local_service_path"
        if o["service_path"].endswith("/" + last):
            return (0.65 if sum(x["service_path"].endswith("/" + last) for x in used) == 1 else 0.2), "suffix_local_service_path"
        return 0.0, "local_service_name_mismatch"

    base, used = 0.2, [o for o in rows if repo is None or o["repo_id"] == repo]
    if not used and repo is not None and sname:
        fitting = [o for o in rows if told(o)[1] != "local_service_name_mismatch"]
        own = [(o, max(d for i, r, d in owners if i == o["operation_id"] and r == repo)) for o in fitting if any(i == o["operation_id"] and r == repo for i, r, _ in owners)]
        direct = [o for o, d in own if d]
        used, base = direct or ([o for o, _ in own] if len(own) == 1 else []), 0.95
        if not used:
            return "unresolved", None, len(fitting), None, ["local_service_candidate_without_caller_ownership" if fitting else "no_operation_candidates"]
    if not used:
        return "unresolved", None, 0, None, ["no_operation_candidates"]
    scored = []
    for o in used:
        why, s = ["operation_path_match"] + (["implementation_context_caller_ownership"] if base == 0.95 else []), base
        if spath:
            s += 0.75 if o["service_path"] == spath else -0.1
            why.append("exact_service_path" if o["service_path"] == spath else "service_path_mismatch")
        if sname:
            more, reason = told(o)
            s += more
            why.append(reason)
        if override:
            s += 0.2
            why.append("explicit_local_service_call" if repo is not None else "explicit_dynamic_override")
        if repo is not None and len(used) == 1 and "local_service_name_mismatch" in why:
            s = max(s, 0.9)
            why.append("same_repo_unique_operation_path_with_lookup_mismatch")
        scored.append((-max(0.0, min(1.0, s)), o["repo_name"], o["service_path"], o["operation_name"], o["operation_id"], why))
    scored.sort()
    best, many = scored[0], "ambiguous" if len(scored) > 1 else "unresolved"
    if dynamic and not override and not spath:
        return "dynamic", None, len(scored), -best[0], ["dynamic_target_without_override"]
    if not (spath or sname or alias or dest or override):
        return many, None, len(scored), -best[0], ["operation_path_only_has_no_strong_target_signal"]
    fits = best[2] == spath or (bool(sname) and ("local_service_name_mismatch" not in best[5] or "same_repo_unique_operation_path_with_lookup_mismatch" in best[5]))
    if -best[0] >= 0.9 and fits and (len(scored) == 1 or -best[0] + scored[1][0] >= 0.25):
        return "resolved", best[4], len(scored), -best[0], best[5]
    return many, None, len(scored), -best[0], ["candidate_score_below_resolution_threshold"]


def test_resolve_operations(spark):
    rng = random.Random(8)
    operations = []
    for i in range(60):
        s = rng.randrange(12)
        op = rng.choice(["read", "list", "save", "drop"])
        operations.append({"operation_id": i, "operation_path": f"/{op}", "operation_name": op, "service_path": rng.choice([f"/svc{s}", f"/api/svc{s}"]), "service_name": f"svc{s}" if i % 2 else f"Named{i}", "qualified_name": f"org.svc{s}", "repo_id": s % 5, "repo_name": f"repo{s % 5}"})
    owners = [(rng.randrange(60), rng.randrange(6), rng.random() < 0.5) for _ in range(80)]
    calls = [
        (rng.choice(["/read", "/org.list", "save", "/gone", "/${op}", None, "/drop"]), rng.choice([None, None, "/svc1", "/svc${n}", "/api/svc3"]), rng.choice([None, "org.svc2", "svc4", "x.svc5", "other", "", "/svc3"]),
         rng.choice([None, "al", "${al}"]) if rng.random() < 0.3 else None, rng.choice([None, "dest"]), rng.choice([None, None, 0, 1, 2, 5]), rng.choice([None, False, True]), rng.choice([None, False, False, True]))
        for _ in range(600)
    ]
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(calls)], "id int, operation_path string, service_path string, service_name string, alias string, destination string, repo_id int, is_dynamic boolean, has_override boolean")
    o = spark.createDataFrame([tuple(x.values()) for x in operations], "operation_id int, operation_path string, operation_name string, service_path string, service_name string, qualified_name string, repo_id int, repo_name string")
    w = spark.createDataFrame(owners, "operation_id int, repo_id int, direct boolean")
    got = {r["id"]: (r["status"], r["operation_id"], r["candidates"], r["score"], list(r["reasons"])) for r in resolving.resolve_operations(c, o, w).collect()}
    want = {i: _resolve(x, operations, owners) for i, x in enumerate(calls)}
    assert {i: (got[i], want[i], calls[i]) for i in want if got.get(i) != want[i]} == {} and len(got) == len(want)
    assert {"resolved", "ambiguous", "unresolved", "dynamic"} == {v[0] for v in want.values()}
    assert {"implementation_context_caller_ownership", "same_repo_unique_operation_path_with_lookup_mismatch", "suffix_local_service_path"} <= {r for v in want.values() for r in v[4]}


def test_resolve_among_many_operations(shuffling):
    """Calls and candidates are never paired: what is shuffled grows with their number."""
    spark = shuffling
    o = spark.range(2000).selectExpr("id operation_id", "'/read' operation_path", "'read' operation_name", "concat('/at', id) service_path", "concat('svc', id) service_name", "concat('org.svc', id) qualified_name", "id % 2 repo_id", "'r' repo_name")
    none = "cast(null as string)"
    c = spark.range(1500).selectExpr("id", "'read' operation_path", f"{none} service_path", "concat('svc', id) service_name", f"{none} alias", f"{none} destination", "if(id < 500, 0L, null) repo_id", "false is_dynamic", "false has_override")
    w = spark.createDataFrame([], "operation_id long, repo_id long, direct boolean")
    found = resolving.resolve_operations(c, o, w)
    got = {r["id"]: (r["status"], r["operation_id"], r["candidates"], r["score"], r["lead"]) for r in found.collect()}
    assert got == {i: ("ambiguous", None, 1000, 0.2, 0.0) if i < 500 and i % 2 else ("resolved", i, 1000 if i < 500 else 2000, 0.95, 0.75) for i in range(1500)}
    assert max(_shuffled(found._jdf.queryExecution().executedPlan())) <= 30_000


@pytest.mark.parametrize("block", [100_000, 5])
def test_owners(spark, block):
    rng = random.Random(6)
    held = []
    for i in range(150):
        a = rng.randrange(200)
        held.append((i, rng.choice(["f", "f", "g", None]), a, a + rng.choice([-1, 0, 1, 5, 40, 300]), rng.randrange(2), rng.choice("xy")))
    held += [(800, "g", 500, 510, 0, "x"), (801, "g", 500, 510, 0, "x"), (802, "g", 400, 900, 0, "x")]
    held += [(900, "f", 0, (1 << 39) - 1, 0, "all"), (901, "g", 7, None, 0, "x")]
    sites = [(i, rng.choice(["f", "g", "h", None]), a := rng.randrange(220), a + rng.randrange(4)) for i in range(300)] + [(999, "f", 3, None), (998, "f", 1 << 38, 1 << 38), (997, "g", 505, 510), (996, "g", 505, 511)]
    s = spark.createDataFrame(sites, "id int, file string, start long, end long")
    h = spark.createDataFrame(held, "span_id int, file string, start long, end long, kind_rank int, name string")
    got = {r["id"]: (r["span_id"], r["enclosing"], r["status"]) for r in spans.owners(s, h, Scratch(spark, "t"), block).collect()}
    want = {}
    for i, f, a, b in sites:
        inside = sorted((y - x, k, x, y, n, j) for j, g, x, y, k, n in held if None not in (f, g, b, y) and f == g and x <= a and y >= b)
        if not inside:
            want[i] = (None, 0, "none")
        else:
            sole = len(inside) == 1 or inside[0][:5] != inside[1][:5]
            want[i] = (inside[0][5] if sole else None, len(inside), "owned" if sole else "ambiguous")
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert {v[2] for v in want.values()} == {"none", "owned", "ambiguous"}
    assert spans.owners(s, h.limit(0), Scratch(spark, "t")).where("status = 'none'").count() == len(sites)


def test_owners_of_many_sites(shuffling):
    """Sites and spans of a cell are never paired: what is written and shuffled grows with their number."""
    spark = shuffling
    h = spark.range(2000).selectExpr("id span_id", "'f' file", "0L start", "4095L + id end", "0 kind_rank", "'x' name").union(spark.sql("select 5000L, 'f', 0L, 9000L, 0, 'x'"))
    s = spark.range(2000).selectExpr("id", "'f' file", "id start", "4094L + id end")
    found = spans.owners(s, h, Scratch(spark, "t"))
    got = {r["id"]: (r["span_id"], r["enclosing"], r["status"]) for r in found.collect()}
    assert got == {i: (max(i - 1, 0), 2001 - max(i - 1, 0), "owned") for i in range(2000)}
    assert max(_shuffled(found._jdf.queryExecution().executedPlan())) <= 60_000
    many = spans.owners(s, h.union(h.selectExpr("span_id + 9000", "file", "start", "end", "kind_rank", "name")), Scratch(spark, "t"))
    assert {(r["span_id"], r["status"]) for r in many.select("span_id", "status").distinct().collect()} == {(None, "ambiguous")}
