"""Event links on hand-made rows: one case for each way they end."""

from tidewater.operators import event_links as ev

CALLS = "id long, repo string, emits boolean, template string, parse_reason string, receiver string, receiver_reason string, vars map<string,string>, sources array<string>, canonicals array<string>"
BINDINGS = "id long, at int, source_key string, env_key string, transforms array<string>, refused boolean, reason string"


def _calls(spark):
    call = lambda i, repo, template, emits=True, why=None, receiver=None, receiver_reason=None, known=None, sources=None, canonicals=None: (i, repo, emits, template, why, receiver, receiver_reason, known, sources, canonicals)
    return spark.createDataFrame([
        call(1, "a", "x/${k}"), call(2, "a", "x/${k}", known={"k": ""}), call(3, "b", "x/${k}"), call(4, "c", "x/${k}"), call(5, "none", "x/${k}", known={"K": "v"}, sources=["k"], canonicals=["K"]),
        call(6, "a", "x/${two}"), call(7, "a", "x"), call(8, "a", "x/${k}", known={"K": "v"}, sources=["k", "k", None], canonicals=["K", "K", "K"]), call(9, "a", None, why="event_name_call"),
        call(10, "a", "y", emits=False, receiver="unproven"), call(11, "a", "y", receiver="unproven", receiver_reason="why"), call(12, None, "x/${k}"), call(13, "a", "x/${k}/${k}/${other}"),
        call(14, "a", "fixed", emits=False)], CALLS)


def _known(spark):
    bind = lambda i, key="K", source="k", at=0, how=None, refused=False, reason=None: (i, at, source, key, how, refused, reason)
    bindings = spark.createDataFrame([
        bind(1, how=["upper"]), bind(2), bind(3), bind(4), bind(5), bind(6, "TWO", "two"), bind(8), bind(12), bind(13, refused=True, reason="r"), bind(13, at=1), bind(13, "GONE", "other", 2), bind(14, "TWO", "unused")], BINDINGS)
    declarations = spark.createDataFrame([("a", "K", "Straße"), ("a", "K", "Straße"), ("a", "TWO", "1"), ("a", "TWO", "2"), ("b", "K", "b"), ("c", "K", "c"), (None, "K", "n"), ("a", None, "n"), ("a", "GONE", None)], "repo string, key string, value string")
    states = spark.createDataFrame([("a", "complete"), ("b", "incomplete"), ("c", "ambiguous")], "repo string, state string")
    return ev.environments(_calls(spark), bindings, declarations, states)


def test_environments(spark):
    got = {r["id"]: (r["environment"], r["variables"], (r["reason"] or "").removeprefix("event_environment_")) for r in _known(spark).collect()}
    assert got == {
        1: ("resolved", {"k": "STRASSE"}, ""), 2: ("resolved", {"k": ""}, ""), 3: ("unresolved", {}, "declarations_incomplete"), 4: ("ambiguous", {}, "declaration_ambiguous"), 5: ("unresolved", {"K": "v"}, "declarations_invalid"),
        6: ("ambiguous", {}, "declaration_ambiguous"), 7: ("not_applicable", {}, ""), 8: ("resolved", {"K": "v", "k": "v"}, ""), 9: ("not_applicable", {}, ""), 10: ("not_applicable", {}, ""), 11: ("not_applicable", {}, ""),
        12: ("unresolved", {}, "declarations_invalid"), 13: ("unresolved", {"k": "Straße"}, "r"), 14: ("ambiguous", {}, "declaration_ambiguous")}


def test_edges(spark):
    got = {r["id"]: (r["edge_type"][:7], r["target"], r["certainty"], r["reason"]) for r in ev.edges(_calls(spark), _known(spark)).collect()}
    assert got[1] == ("HANDLER", "x/STRASSE", "environment_declaration_exact", None)
    assert got[2] == ("HANDLER", "x/", "environment_declaration_exact", None)
    assert got[3] == ("DYNAMIC", "Event: x/${k}", "runtime_variables_required", "event_environment_declarations_incomplete")
    assert got[7] == ("HANDLER", "x", "static_name_only", None)
    assert got[9] == ("DYNAMIC", "Event: ", "runtime_variables_required", "event_name_call")
    assert got[10] == ("DYNAMIC", "Event: y", "receiver_unproven", "event_receiver_unproven_binding")
    assert got[11] == ("HANDLER", "y", "receiver_unproven", "why")
    assert got[13] == ("DYNAMIC", "Event: x/Straße/Straße/${other}", "runtime_variables_required", "r")
    assert len(got) == 14


SUBSCRIPTIONS = "id long, workspace long, repo string, file string, start int, end int, line int, symbol long"
SITES = "call long, repo string, file string, start int, end int, caller long, callee long, status string, line int, workspace long, origin string, reason string"


def test_handlers(spark):
    sub = lambda i, start, end, symbol=5, line=1, repo="r": (i, 1, repo, "f", start, end, line, symbol)
    site = lambda c, start, end, caller=5, callee=70, status="resolved", line=1, workspace=1, origin="o", reason="why": (c, "r", "f", start, end, caller, callee, status, line, workspace, origin, reason)
    subs = spark.createDataFrame([sub(1, 0, 9), sub(2, 10, 19), sub(3, None, 5), sub(4, 20, 20), sub(5, 30, 39), sub(6, 40, 49, None), sub(7, 50, 59), sub(8, 60, 69), sub(9, 70, 79), sub(10, 80, 89), sub(11, 90, 99), sub(12, -1, 9), sub(13, 0, 9, repo=None), sub(14, 0, 9)], SUBSCRIPTIONS)
    sites = spark.createDataFrame(
        [site(1, 0, 9), site(3, 20, 20), site(4, 30, 39, caller=None), site(5, 40, 49, workspace=None), site(6, 50, 59, line=2), site(7, 60, 69, workspace=2), site(8, 70, 79, status="ambiguous"), site(9, 80, 89, callee=None), site(10, 90, 99, status=None), site(12, -1, 9), (99, None, "f", 0, 9, 5, 1, "resolved", 1, 1, "o", None)]
        + [site(100 + i, 10, 19, origin=None if i else "o") for i in range(50)], SITES)
    got = {r["id"]: (r["status"], r["to_kind"], r["to_id"], r["reason"], r["matches"], r["origin"]) for r in ev.handlers(subs, sites).collect()}
    lost = lambda i, why, n, origin=None: ("unresolved", "subscription_handler", str(i), why, n, origin)
    assert got == {
        1: ("resolved", "symbol", "70", None, 1, "o"), 14: ("resolved", "symbol", "70", None, 1, "o"), 2: ("ambiguous", "subscription_handler", "2", "multiple_handler_role_site_matches", 50, "mixed"),
        3: lost(3, "subscription_call_span_missing", 0), 4: lost(4, "subscription_call_span_missing", 1), 12: lost(12, "subscription_call_span_missing", 1), 13: lost(13, "subscription_handler_role_site_missing", 0),
        5: lost(5, "subscription_handler_caller_mismatch", 1, "o"), 6: ("resolved", "symbol", "70", None, 1, "o"), 7: lost(7, "subscription_handler_source_line_mismatch", 1, "o"), 8: lost(8, "subscription_handler_target_workspace_mismatch", 1, "o"),
        9: ("ambiguous", "symbol_reference", "8", "subscription_handler_reference_ambiguous", 1, "o"), 10: ("unresolved", "symbol_reference", "9", "resolved_handler_symbol_missing", 1, "o"),
        11: ("unresolved", "symbol_reference", "10", "subscription_handler_reference_unresolved", 1, "o")}


def test_handled(spark):
    known = _known(spark)
    told = spark.createDataFrame([(i, "resolved", "symbol", "7", None, "call") for i in (1, 3, 9, 10, 13, 14)], "id long, status string, to_kind string, to_id string, reason string, call_reason string")
    got = {r["id"]: (r["from_kind"], r["status"], r["association"], r["reason"]) for r in ev.handled(ev.edges(_calls(spark), known), told).collect()}
    assert got == {
        1: ("event", "resolved", "resolved", "call"), 3: ("event_candidate", "unresolved", "resolved", "event_environment_declarations_incomplete"), 9: ("event_candidate", "unresolved", "resolved", "event_name_call"),
        10: ("event_candidate", "unresolved", "resolved", "event_receiver_unproven_binding"), 13: ("event_candidate", "unresolved", "resolved", "r"), 14: ("event", "ambiguous", "resolved", "event_environment_declaration_ambiguous")}


def test_received(spark):
    row = lambda edge, i, kind, event, status="resolved", template="x", holes=(), to="7": (edge, 1, i, kind, event, status, "symbol", to, "resolved", template, list(holes), ["k"], ["K"])
    handled = spark.createDataFrame(
        [row(e, 1, "event", "x") for e in range(8)] + [row(20, 2, "event_candidate", "Event: ${k}", "unresolved", "${k}", ["k"]), row(21, 3, "event_candidate", "x", "unresolved"), row(22, 4, "event", "y", template="${k}", holes=["k"]), row(23, 5, "event", "x", template="${k}", holes=["k"]), row(24, 6, "event_candidate", "Event: ${k}${j}", template="${k}${j}", holes=["k", "j"])],
        "edge long, workspace long, id long, from_kind string, event string, status string, to_kind string, to_id string, association string, template string, placeholders array<string>, sources array<string>, canonicals array<string>")
    emitted = spark.createDataFrame([(1, 0, "x")] * 3 + [(1, 1, "x"), (1, 0, "nobody"), (2, 0, "x"), (1, 0, None)], "workspace long, run long, event string")
    runs = spark.createDataFrame([(1, 0, {"K": "x"}), (1, 1, None), (2, 0, {"k": "x"})], "workspace long, run long, vars map<string,string>")
    got = sorted((r["run"], r["subscription"], r["emits"], r["status"], r["strategy"], r["dispatches"], r["shown"]) for r in ev.received(handled, emitted, runs).collect())
    assert got == [
        (0, 1, 3, "resolved", "exact", 8, "0,1,2,3,4"), (0, 2, 3, "resolved", "runtime", 1, "20"), (0, 4, 3, "resolved", "runtime", 1, "22"), (0, 5, 3, "resolved", "exact", 1, "23"),
        (1, 1, 1, "resolved", "exact", 8, "0,1,2,3,4"), (1, 5, 1, "resolved", "exact", 1, "23")]


def test_unmatched_and_multiplicity(spark):
    published = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (1, None)], "workspace long, event string")
    subscribed = spark.createDataFrame(
        [(1, "event", "a", 1, None, None, None), (1, "event_candidate", "b", 2, None, None, None), (2, "event", "c", 3, "x", "enumerated", 9), (2, "event", "d", 4, None, "enumerated", 3), (2, "event", "e", 4, None, "unresolved", None)],
        "workspace long, from_kind string, event string, id long, loop_name string, loop_status string, loop_count int")
    said, heard = ev.unmatched(published, subscribed)
    assert sorted(map(tuple, said.select("workspace", "event").collect()), key=str) == [(1, "b"), (1, None), (2, "a")]
    assert sorted(r["event"] for r in heard.collect()) == ["c", "d", "e"]
    assert tuple(heard.agg(*ev.multiplicity(heard)).first()) == (2, 4, 1)


def test_nothing(spark):
    none = lambda df: df.where("false")
    assert ev.edges(none(_calls(spark)), _known(spark)).count() == 0
    assert ev.environments(_calls(spark), spark.createDataFrame([], BINDINGS), spark.createDataFrame([], "repo string, key string, value string"), spark.createDataFrame([], "repo string, state string")).where("environment = 'not_applicable'").count() == 14
