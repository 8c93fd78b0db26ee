"""Quality checks on hand-made rows, nulls and empty tables."""

from tidewater.operators import checks

CALLS = "id long, type string, path string, bound long, owner long, entity string, reason string, evidence string"
EDGES = "call long, edge_type string, status string, target string, is_dynamic boolean, reason string, evidence string"


def told(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["check"], {})[r["measure"]] = r["value"]
    return found


def test_edges_of_calls(spark):
    calls = spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in enumerate(["remote_query", "remote_query", "remote_action", "external_http", "local_service_call", "local_service_call", None])], CALLS)
    edge = lambda call, kind=None, status=None, target=None, reason=None, evidence=None: (call, kind, status, target, False, reason, evidence)
    edges = spark.createDataFrame([
        edge(0, "HANDLER_RUNS_REMOTE_QUERY", "terminal", "7x"), edge(0, "UNRESOLVED_EDGE"), edge(2, "X", "unresolved", "Remote action: dynamic path"), edge(3, target="9", evidence='{"externalTarget":{"kind":null}}'),
        edge(4, "X", "unresolved", reason="local_service_candidate_without_caller_ownership", evidence='{"candidateCount":"x"}'), edge(4, "X", "unresolved", evidence='["local_service_candidate_without_caller_ownership", {"candidateCount":3}]'),
        edge(5, "X", "unresolved", evidence='{"candidateCount":3,"outboundEvidence":{"parser":"p"}}'), edge(None, "X"), edge(77, "X")], EDGES)
    assert told(checks.edges_of_calls(calls, edges)) == {
        "remote_query": {"total": 3, "terminal": 1, "numeric": 1, "unresolved": 1}, "remote_action": {"total": 1, "unresolved": 1, "numeric": 0, "semantic": 1}, "external_http": {"total": 1, "numeric": 1, "invalid_evidence": 1},
        "local_calls": {"by_context": 0, "without_ownership": 2, "unresolved": 3, "outside": 1}, "graph_evidence": {"total": 7, "non_object": 4, "with_outbound": 1}}
    assert set(v for m in told(checks.edges_of_calls(calls.where("false"), edges)).values() for v in m.values()) == {0}


def test_calls_alone(spark):
    row = lambda i, kind, **more: (i, kind, more.get("path"), more.get("bound"), more.get("owner"), more.get("entity"), more.get("reason"), more.get("evidence"))
    calls = spark.createDataFrame([
        row(1, "local_db_query", entity="E", owner=1, evidence="{}"), row(2, "local_db_query", evidence="null"), row(3, "local_db_query", evidence="{"), row(4, "remote_action", evidence='{"receiver":"x"}'), row(5, "remote_action", bound=1, evidence='{"receiver":"x"}'),
        row(6, "remote_action", reason="dynamic_operation_path_identifier"), row(7, None)], CALLS)
    assert told(checks.calls_alone(calls)) == {
        "db_query": {"total": 3, "known": 1, "unknown": 2, "ratio": 0.6667}, "ownership": {"total": 7, "without": 6, "ratio": 0.8571}, "outbound_evidence": {"total": 7, "missing": 2, "invalid": 1, "non_object": 1}, "alias": {"missed": 1}, "wrapper_path": {"open": 1}}
    assert set(v for m in told(checks.calls_alone(calls.where("false"))).values() for v in m.values()) == {0}


def test_registrations(spark):
    classes = spark.createDataFrame([(1, "a", "C"), (2, "b", "C"), (3, "b", "C"), (4, "b", "D"), (5, None, "C")], "class long, repo string, name string")
    rows = spark.createDataFrame([("a", "C", 1, "m"), ("b", "C", 1, "m"), ("b", "D", 4, None), ("b", "E", 4, "m"), ("a", "C", 99, "m"), ("a", None, 1, "m"), ("a", "C", None, "m")], "repo string, name string, class long, imported string")
    pairs = [(r, c) for r in rows.collect() for c in classes.collect() if r["class"] in (1, 2, 3, 4, 5) and r["imported"] and c["name"] == r["name"] and None not in (c["repo"], r["repo"]) and c["repo"] != r["repo"]]
    assert told(checks.registrations(rows, classes)) == {"registration": {"mismatched": 2, "prevented": len(pairs)}}
    assert told(checks.registrations(rows.where("false"), classes)) == {"registration": {"mismatched": 0, "prevented": 0}}


def test_symbols_decorators_and_unbound(spark):
    rows = spark.createDataFrame([("this.a.b", "unresolved", '{"relation":"class_instance_method","className":"URL"}'), ("this.a\n.b", None, '{"relation":"indexed_this_method"}'), ("this.a", "unresolved", None), (None, None, "[]")], "expression string, status string, evidence string")
    assert told(checks.symbol_calls(rows)) == {"symbol_evidence": {"total": 4, "non_object": 1}, "class_noise": {"total": 1, "unresolved": 1, "built_in": 1}, "nested_this": {"total": 2, "current_class": 1, "helper": 1}}
    methods = spark.createDataFrame([('{"resolutionKind":"enum_member"}',), ('{"resolutionKind":"unresolved"}',), ("x",), (None,)], "resolution string")
    assert told(checks.decorators(methods)) == {"decorator": {"constants": 1, "unresolved": 1}}
    calls = spark.createDataFrame([(1, "remote_action", "/p", None, None, None, None, None), (2, "remote_action", "/p", None, None, None, None, None), (3, "remote_action", None, None, None, None, None, None)], CALLS)
    edges = spark.createDataFrame([(1, "X", "dynamic", "t", True, None, None), (1, "X", None, "t", True, None, None)], EDGES)
    assert {r["status"]: r["n"] for r in checks.unbound_actions(calls, edges).collect()} == {"dynamic": 1, "missing_edge": 2}
