"""Events between services: names filled from declared values, edges of emits and subscriptions, handlers, and who receives what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions.text import substituted

TEXTS = "map<string,string>"


def _vars(known: Column) -> Column:
    return F.coalesce(known, F.create_map().cast(TEXTS))


def expanded(known: Column, sources: Column, canonicals: Column) -> Column:
    """The variables, and each source key that is not among them with the value of its canonical key."""
    known, sources = _vars(known), F.coalesce(sources, F.array().cast("array<string>"))
    pairs = F.arrays_zip(sources.alias("s"), F.coalesce(canonicals, F.array().cast("array<string>")).alias("c"))
    useful = F.filter(pairs, lambda p, i: (F.array_position(sources, p["s"]) == i + 1) & (p["s"] != "") & (p["c"] != "") & ~F.map_contains_key(known, p["s"]) & F.map_contains_key(known, p["c"]))
    return F.map_concat(known, F.map_from_entries(F.transform(useful, lambda p: F.struct(p["s"], F.element_at(known, p["c"])))))


def environments(calls: DataFrame, bindings: DataFrame, declarations: DataFrame, states: DataFrame) -> DataFrame:
    """(id, environment, variables, reason): what the placeholders of each call's event name stand for in its repository.

    calls(id, repo, vars, sources, canonicals); bindings(id, at, source_key, env_key, transforms,
    refused, reason); declarations(repo, key, value); states(repo, state), one row a repository.

    A key that the variables hold is taken from them. Else the binding asks its repository's
    declarations: it may be refused, the declarations may be incomplete, the key may have
    several values (equal ones are one) or none. `upper` and `lower` are applied in order; the
    first binding of a key that has a value wins. environment: 'ambiguous' if any binding is, then
    'unresolved', then 'resolved'; 'not_applicable' without bindings. A repository without a
    state has no valid declarations: its calls are unresolved and keep the given variables.

    Declarations are one row a (repository, key) before bindings meet them; a hot key is a hot
    key of the bindings' side only. Nothing but a call's own bindings is gathered.
    """
    values = declarations.where("value is not null").groupBy(F.col("repo").alias("of_repo"), F.col("key").alias("env_key")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    at_home = calls.select("id", "repo", expanded(F.col("vars"), F.col("sources"), F.col("canonicals")).alias("known"))
    at_home = at_home.join(states.select("repo", "state"), "repo", "left")
    asked = bindings.join(at_home, "id").join(values.withColumnRenamed("env_key", "has_key"), (F.col("of_repo") == F.col("repo")) & (F.col("has_key") == F.col("env_key")), "left")
    several = (F.col("state") == "ambiguous") | (F.coalesce(F.col("low") < F.col("high"), F.lit(False)))
    given = F.coalesce(F.map_contains_key("known", F.col("source_key")), F.lit(False))
    why = (
        F.when(given, None).when(F.coalesce("refused", F.lit(False)), F.coalesce("reason", F.lit("event_environment_reference_refused")))
        .when(F.col("state") == "incomplete", "event_environment_declarations_incomplete").when(several, "event_environment_declaration_ambiguous")
        .when(F.col("low").isNull(), "event_environment_declaration_missing")
    )
    put = F.aggregate(F.coalesce("transforms", F.array().cast("array<string>")), F.col("low"), lambda v, t: F.when(t == "upper", F.upper(v)).otherwise(F.lower(v)))
    told = asked.select("id", "at", "source_key", why.alias("why"), F.when(why.isNull() & ~given, put).alias("put"), (~given & ~F.coalesce("refused", F.lit(False)) & (F.coalesce("state", F.lit("")) != "incomplete") & several).alias("ambiguous"))
    a_key = told.groupBy("id", "source_key").agg(
        F.min_by("put", F.when(F.col("put").isNotNull(), F.col("at"))).alias("put"), F.min(F.when(F.col("why").isNotNull(), F.struct("at", "why"))).alias("first"), F.max("ambiguous").alias("ambiguous"))
    a_call = a_key.groupBy("id").agg(
        F.collect_list(F.when(F.col("put").isNotNull() & F.col("source_key").isNotNull(), F.struct("source_key", "put"))).alias("puts"),
        F.min("first").alias("first"), F.max("ambiguous").alias("ambiguous"))
    joined = at_home.join(calls.select("id", _vars(F.col("vars")).alias("vars")), "id").join(a_call, "id", "left")
    bound, valid = F.col("puts").isNotNull(), F.col("state").isNotNull()
    status = F.when(~bound, "not_applicable").when(~valid, "unresolved").when(F.col("ambiguous"), "ambiguous").when(F.col("first").isNotNull(), "unresolved").otherwise("resolved")
    reason = F.when(bound & ~valid, "event_environment_declarations_invalid").when(F.col("ambiguous"), "event_environment_declaration_ambiguous").otherwise(F.col("first.why"))
    variables = F.when(bound & ~valid, F.col("vars")).when(bound, F.map_concat("known", F.map_from_entries("puts"))).otherwise(F.col("known"))
    return joined.select("id", status.alias("environment"), variables.alias("variables"), F.when(bound, reason).alias("reason"))


def edges(calls: DataFrame, environments: DataFrame) -> DataFrame:
    """An edge for each emit and subscription: (id, edge_type, status, target_kind, target, is_dynamic, certainty, reason, name_reason, environment, env_reason, template, missing, placeholders).

    calls(id, emits, template, parse_reason, receiver, receiver_reason) and their environments. A
    name with placeholders left, or one that was not understood and has none, is a candidate. So
    is a subscription by a receiver that isn't proven; an emit by one stays an event, told by its
    certainty. A null template is the empty name.
    """
    template = F.coalesce("template", F.lit(""))
    rows = calls.join(environments.withColumnRenamed("reason", "env_reason"), "id")
    effective, placeholders, _, missing, _ = substituted(template, F.col("variables"))
    rows = rows.select("id", "emits", "parse_reason", "receiver", "receiver_reason", "environment", "env_reason", template.alias("template"), effective.alias("effective"), placeholders.alias("placeholders"), missing.alias("missing"))
    open_ = F.size("missing") > 0
    opaque = (F.size("placeholders") == 0) & F.col("parse_reason").isNotNull()
    published = open_ | opaque
    unproven = F.when(~published & (F.col("receiver") == "unproven"), F.coalesce("receiver_reason", F.lit("event_receiver_unproven_binding")))
    rows = rows.withColumns({"unproven": unproven, "dynamic": published | (~F.col("emits") & unproven.isNotNull())})
    dynamic = F.col("dynamic")
    why = F.when(open_, F.concat(F.lit("Dynamic target requires runtime variable overrides: "), F.array_join("missing", ", "))).when(opaque, F.col("parse_reason"))
    certainty = F.when(F.col("unproven").isNotNull(), "receiver_unproven").when(F.col("environment") == "resolved", "environment_declaration_exact").when(dynamic, "runtime_variables_required").otherwise("static_name_only")
    return rows.select(
        "id", F.when(dynamic, "DYNAMIC_EDGE_CANDIDATE").when(F.col("emits"), "HANDLER_EMITS_EVENT").otherwise("EVENT_CONSUMED_BY_HANDLER").alias("edge_type"),
        F.when(dynamic, "dynamic").otherwise("terminal").alias("status"), F.when(dynamic, "event_candidate").otherwise("event").alias("target_kind"),
        F.when(dynamic, F.concat(F.lit("Event: "), F.col("effective"))).otherwise(F.col("effective")).alias("target"), dynamic.alias("is_dynamic"), certainty.alias("certainty"),
        F.coalesce("env_reason", why, "unproven").alias("reason"), F.coalesce(why, "unproven").alias("name_reason"), "environment", "env_reason", "template", "missing", "placeholders")


def _agreed(low: str, high: str) -> Column:
    return F.when(F.col(low) != F.col(high), "mixed").when(F.col(low) != "missing", F.col(low))


def handlers(subscriptions: DataFrame, sites: DataFrame) -> DataFrame:
    """What handles each subscription: (id, status, to_kind, to_id, reason, matches, missing, origin, call_status, call_reason).

    subscriptions(id, workspace, repo, file, start, end, line, symbol); sites(call, repo, file,
    start, end, caller, callee, status, line, workspace, origin, reason), the calls that hand a
    handler over. Exactly one of them has to lie on the subscription's own span, be made by the
    same symbol (where the subscription names one), on the same line, and lead to no other
    workspace. Null spans meet nothing.

    Sites are one row a span before subscriptions meet them, so thousands on one span are one row.
    """
    span = ["repo", "file", "start", "end"]
    told = lambda c: F.coalesce(c, F.lit("missing"))
    one = sites.groupBy(*span).agg(
        F.count("*").alias("n"), F.min_by(F.struct("call", "caller", "callee", "status", "line", "workspace", "origin", "reason"), F.coalesce("call", F.lit(-1))).alias("one"),
        F.min(told("origin")).alias("o1"), F.max(told("origin")).alias("o2"), F.min(told("status")).alias("s1"), F.max(told("status")).alias("s2"))
    rows = subscriptions.join(one, span, "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    broken = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("end") <= F.col("start"))
    lost = (
        F.when(broken, "subscription_call_span_missing").when(n == 0, "subscription_handler_role_site_missing").when(n > 1, None)
        .when(F.col("symbol").isNotNull() & ~F.col("one.caller").eqNullSafe(F.col("symbol")), "subscription_handler_caller_mismatch")
        .when(~F.col("one.line").eqNullSafe(F.col("line")), "subscription_handler_source_line_mismatch")
        .when(F.col("one.workspace").isNotNull() & ~F.col("one.workspace").eqNullSafe(F.col("workspace")), "subscription_handler_target_workspace_mismatch")
    )
    rows = rows.withColumns({"n": n, "lost": lost})
    gone, many, of = F.col("lost").isNotNull(), F.col("lost").isNull() & (F.col("n") > 1), F.col("one.status")
    found = (of == "resolved") & F.col("one.callee").isNotNull()
    reason = (
        F.when(gone, F.col("lost")).when(many, "multiple_handler_role_site_matches").when(found, None).when(of == "ambiguous", "subscription_handler_reference_ambiguous")
        .when(of == "resolved", "resolved_handler_symbol_missing").otherwise("subscription_handler_reference_unresolved")
    )
    status = F.when(gone, "unresolved").when(many, "ambiguous").when(found, "resolved").when(of == "ambiguous", "ambiguous").otherwise("unresolved")
    single = F.col("n") == 1
    return rows.select(
        "id", status.alias("status"), F.when(gone | many, "subscription_handler").when(found, "symbol").otherwise("symbol_reference").alias("to_kind"),
        F.when(gone | many, F.col("id")).when(found, F.col("one.callee")).otherwise(F.col("one.call")).cast("string").alias("to_id"), reason.alias("reason"), F.col("n").alias("matches"), gone.alias("missing"),
        F.when(many | (single & ~broken), _agreed("o1", "o2")).alias("origin"), F.when(many | (single & ~broken), _agreed("s1", "s2")).alias("call_status"), F.when(single & ~broken, F.col("one.reason")).alias("call_reason"))


def handled(edges: DataFrame, handlers: DataFrame) -> DataFrame:
    """An edge from an event to what handles it, for each subscription: (id, from_kind, event, status, to_kind, to_id, association, reason, template, placeholders, is_dynamic).

    A name that is a candidate is unresolved whatever its handler is; an ambiguous environment
    makes the edge ambiguous.
    """
    rows = edges.select("id", "target_kind", "target", "is_dynamic", "environment", "env_reason", "template", "missing", "placeholders", "name_reason")
    rows = rows.join(handlers.select("id", "to_kind", "to_id", "call_reason", F.col("status").alias("association"), F.col("reason").alias("handler_reason")), "id")
    dynamic, unclear = F.col("is_dynamic"), F.col("environment") == "ambiguous"
    named = F.when((F.col("environment") == "unresolved") & F.col("env_reason").isNotNull(), F.col("env_reason")).when(F.size("missing") > 0, "event_template_variables_missing")
    named = F.coalesce(named, F.col("name_reason"), F.lit("event_name_unsupported_constant_expression"))
    reason = F.when(dynamic, named).when(unclear, F.col("env_reason")).otherwise(F.coalesce("handler_reason", "call_reason"))
    return rows.select(
        "id", F.col("target_kind").alias("from_kind"), F.col("target").alias("event"), F.when(dynamic, "unresolved").when(unclear, "ambiguous").otherwise(F.col("association")).alias("status"),
        "to_kind", "to_id", "association", reason.alias("reason"), "template", "placeholders", "is_dynamic")


def received(handled: DataFrame, emitted: DataFrame, runs: DataFrame, most: int = 5) -> DataFrame:
    """Who gets each emitted event: (workspace, run, event, emits, subscription, to_kind, to_id, status, strategy, dispatches, shown).

    handled: the rows of `handled` with `edge` (unique), `workspace`, `sources` and `canonicals`;
    emitted(workspace, run, event); runs(workspace, run, vars). An event gets to the edges of its
    own name, and to those whose template gives that name with the run's variables put in and
    nothing left open; a run of null variables puts in none. Edges that say the same (event,
    subscription, target, status) are one row with their number and the `most` least edges.

    Each run puts its variables into its workspace's templates once; then names meet by equality.
    Emits are counted to distinct events first: a row stands for all emits of that event, so a
    hot event meets its receivers once and no pairs of emits and receivers are formed.
    """
    names = emitted.where("event is not null").groupBy("workspace", "run", "event").agg(F.count("*").alias("emits"))
    told = ["workspace", "run", "event", "emits", "edge", "id", "to_kind", "to_id"]
    exact = handled.where("from_kind = 'event'").join(names, ["workspace", "event"]).select(*told, "status", F.lit("exact").alias("strategy"))
    open_ = handled.where("size(placeholders) > 0").join(runs.where("vars is not null"), "workspace")
    effective, _, _, missing, _ = substituted(F.col("template"), expanded(F.col("vars"), F.col("sources"), F.col("canonicals")))
    filled = open_.select("*", effective.alias("effective"), F.size(missing).alias("open")).where("open = 0 and (from_kind <> 'event' or event <> effective)")
    filled = filled.drop("event").withColumnRenamed("effective", "event").join(names, ["workspace", "run", "event"])
    filled = filled.select(*told, F.coalesce("association", "status").alias("status"), F.lit("runtime").alias("strategy"))
    same = ["workspace", "run", "event", "emits", "id", "to_kind", "to_id", "status"]
    alike = Window.partitionBy(*same)
    ranked = exact.unionByName(filled).withColumns({"k": F.row_number().over(alike.orderBy("edge")), "dispatches": F.count("*").over(alike)}).where(F.col("k") <= most)
    edges_ = F.array_sort(F.collect_list(F.struct("k", F.col("edge").cast("string").alias("e"))))
    few = ranked.groupBy(*same).agg(F.max("dispatches").alias("dispatches"), F.min_by("strategy", "k").alias("strategy"), F.array_join(F.transform(edges_, lambda s: s["e"]), ",").alias("shown"))
    return few.withColumnRenamed("id", "subscription")


def unmatched(published: DataFrame, subscribed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Published events that nothing handles, and edges of subscriptions that nothing publishes.

    published(workspace, event, ...) are the edges of emits with an event as target;
    subscribed(workspace, from_kind, event, ...). A candidate is no match for an event, though it
    may have been published under the name of one.
    """
    heard = subscribed.where("from_kind = 'event'").select("workspace", "event").distinct()
    said = published.select("workspace", "event").distinct()
    return published.join(heard, ["workspace", "event"], "left_anti"), subscribed.join(said, ["workspace", "event"], "left_anti")


def multiplicity(subscribed: DataFrame) -> list[Column]:
    """Sites, registrations and sites of unknown number of edges(id, loop_name, loop_status, loop_count): a loop counts as often as it runs, where that is known."""
    unknown = F.col("loop_status") == "unresolved"
    times = F.when(F.col("loop_name").isNotNull(), 1).when(F.col("loop_status") == "enumerated", F.col("loop_count")).when(unknown, 0).otherwise(1)
    return [F.count_distinct("id").alias("sites"), F.coalesce(F.sum(times), F.lit(0)).alias("registrations"), F.count_distinct(F.when(unknown, F.col("id"))).alias("unknown_sites")]
