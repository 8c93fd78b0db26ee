"""Quality checks over tables of facts: conditional counts, one pass for the facts that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Constructors of the language itself.
BUILT_IN = (
    "Set", "Map", "WeakSet", "WeakMap", "Date", "RegExp", "URL", "URLSearchParams", "Error", "EvalError", "RangeError", "ReferenceError", "SyntaxError", "TypeError", "URIError", "AggregateError", "ArrayBuffer",
    "SharedArrayBuffer", "DataView", "Int8Array", "Uint8Array", "Uint8ClampedArray", "Int16Array", "Uint16Array", "Int32Array", "Uint32Array", "Float32Array", "Float64Array", "BigInt64Array", "BigUint64Array", "Promise", "AbortController")
#: How a name was found in constants.
CONSTANTS = ("const_identifier", "enum_member", "const_object_property", "generated_constant_name")


def _measures(rows: DataFrame, wanted: dict[str, dict[str, Column]], groups: tuple[str, ...] = ()) -> DataFrame:
    """(check, measure, value) of aggregates that are all worked out in one pass."""
    flat = [(check, measure, column) for check, measures in wanted.items() for measure, column in measures.items()]
    one = rows.groupBy(*groups).agg(*(F.coalesce(column.cast("double"), F.lit(0.0)).alias(f"m{i}") for i, (_, _, column) in enumerate(flat)))
    told = F.array(*(F.struct(F.lit(check).alias("check"), F.lit(measure).alias("measure"), F.col(f"m{i}").alias("value")) for i, (check, measure, _) in enumerate(flat)))
    return one.select(*groups, F.inline(told))


def _object(evidence: Column) -> Column:
    """Whether a text is a JSON object; null where it is null or no JSON."""
    return F.startswith(F.schema_of_variant(F.try_parse_json(evidence)), F.lit("OBJECT"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, 4))


def edges_of_calls(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of calls(id, type) with their edges(call, edge_type, status, target, reason, evidence): remote queries and actions, external requests, local calls, evidence.

    A call without an edge counts once, one with several as often. Numeric targets begin with a
    digit. All of it is one join on the call and one pass.
    """
    rows = calls.select("id", "type").join(edges, F.col("call") == F.col("id"), "left")
    kind = lambda name: F.col("type") == name
    status, numeric, evidence = F.col("status"), F.col("target").rlike(r"\A[0-9]"), F.col("evidence")
    query, action, http, local = kind("remote_query"), kind("remote_action"), kind("external_http"), kind("local_service_call") & F.col("call").isNotNull()
    runs, lost, held = F.col("edge_type") == "HANDLER_RUNS_REMOTE_QUERY", status == "unresolved", F.coalesce(_object(evidence), F.lit(False))
    unowned = "local_service_candidate_without_caller_ownership"
    field = lambda path: F.get_json_object("evidence", path)
    linked = F.col("call").isNotNull()
    return _measures(rows, {
        "remote_query": {"total": F.count_if(query), "terminal": F.count_if(query & runs & (status == "terminal")), "numeric": F.count_if(query & runs & numeric), "unresolved": F.count_if(query & ((F.col("edge_type") == "UNRESOLVED_EDGE") | lost))},
        "remote_action": {"total": F.count_if(action), "unresolved": F.count_if(action & lost), "numeric": F.count_if(action & lost & numeric), "semantic": F.count_if(action & lost & F.col("target").isin("Remote action: unknown path", "Remote action: dynamic path"))},
        "external_http": {"total": F.count_if(http), "numeric": F.count_if(http & numeric), "invalid_evidence": F.count_if(http & field("$.externalTarget.kind").isNull())},
        "local_calls": {
            "by_context": F.count_if(local & (status == "resolved") & F.contains(evidence, F.lit("implementation_context_caller_ownership"))),
            "without_ownership": F.count_if(local & (F.coalesce(F.col("reason") == unowned, F.lit(False)) | F.coalesce(F.contains(evidence, F.lit(unowned)), F.lit(False)))),
            "unresolved": F.count_if(local & lost), "outside": F.count_if(local & lost & held & (field("$.candidateCount").try_cast("double") > 0))},
        "graph_evidence": {"total": F.count_if(linked), "non_object": F.count_if(linked & ~held), "with_outbound": F.count_if(linked & field("$.outboundEvidence.parser").isNotNull())},
    })


def calls_alone(calls: DataFrame) -> DataFrame:
    """Counts of calls(id, type, path, bound, owner, entity, reason, evidence): entities known, owners, evidence, missed aliases, open paths. Ratios have four digits."""
    db, action = F.col("type") == "local_db_query", F.col("type") == "remote_action"
    ownerless, evidence = F.col("owner").isNull(), F.col("evidence")
    v, held = F.try_parse_json(evidence), _object(evidence)
    receiver = F.get_json_object("evidence", "$.receiver").isNotNull()
    return _measures(calls, {
        "db_query": {"total": F.count_if(db), "known": F.count_if(db & F.col("entity").isNotNull()), "unknown": F.count_if(db & F.col("entity").isNull()), "ratio": _ratio(F.count_if(db & F.col("entity").isNull()), F.count_if(db))},
        "ownership": {"total": F.count("*"), "without": F.count_if(ownerless), "ratio": _ratio(F.count_if(ownerless), F.count("*"))},
        "outbound_evidence": {"total": F.count("*"), "missing": F.count_if(evidence.isNull()), "invalid": F.count_if(evidence.isNotNull() & v.isNull()), "non_object": F.count_if(v.isNotNull() & ~held)},
        "alias": {"missed": F.count_if(action & F.col("bound").isNull() & receiver)},
        "wrapper_path": {"open": F.count_if(action & (F.col("reason") == "dynamic_operation_path_identifier"))},
    })


def symbol_calls(rows: DataFrame) -> DataFrame:
    """Counts of symbol_calls(expression, status, evidence): evidence, calls of instances, nested receivers."""
    relation, name = F.get_json_object("evidence", "$.relation"), F.get_json_object("evidence", "$.className")
    instance, lost, nested = relation == "class_instance_method", F.col("status") == "unresolved", F.col("expression").rlike(r"(?s)\Athis\..*\..*\z")
    return _measures(rows, {
        "symbol_evidence": {"total": F.count("*"), "non_object": F.count_if(~F.coalesce(_object(F.col("evidence")), F.col("evidence").isNull()))},
        "class_noise": {"total": F.count_if(instance), "unresolved": F.count_if(instance & lost), "built_in": F.count_if(instance & lost & name.isin(*BUILT_IN))},
        "nested_this": {"total": F.count_if(nested), "current_class": F.count_if(nested & (relation == "indexed_this_method")), "helper": F.count_if(nested & instance)},
    })


def registrations(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Counts of registrations(repo, name, class, imported) against classes(class, repo, name): exact ones that don't fit, and pairs with classes of that name elsewhere.

    Pairs are counted, not formed: classes of the name less those of the registration's own repository.
    """
    exact = rows.join(classes.select("class", F.col("repo").alias("c_repo"), F.col("name").alias("c_name")), "class")
    named = classes.where("repo is not null").groupBy("name").agg(F.count("*").alias("everywhere"))
    here = classes.groupBy("name", "repo").agg(F.count("*").alias("here"))
    exact = exact.join(named, "name", "left").join(here, ["name", "repo"], "left")
    others = F.coalesce("everywhere", F.lit(0)) - F.coalesce("here", F.lit(0))
    return _measures(exact, {"registration": {
        "mismatched": F.count_if((F.col("c_repo") != F.col("repo")) | (F.col("c_name") != F.col("name"))), "prevented": F.sum(F.when(F.col("imported").isNotNull() & F.col("repo").isNotNull(), others))}})


def decorators(methods: DataFrame) -> DataFrame:
    """Counts of methods(resolution), a JSON text: names found in constants, names that were not found."""
    kind = F.get_json_object("resolution", "$.resolutionKind")
    return _measures(methods, {"decorator": {"constants": F.count_if(kind.isin(*CONSTANTS)), "unresolved": F.count_if(kind == "unresolved")}})


def unbound_actions(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(status, n) of remote actions with a path and no binding, a row an edge; 'missing_edge' where there is none."""
    rows = calls.where("type = 'remote_action' and path is not null and bound is null").select("id").join(edges.select("call", "status"), F.col("call") == F.col("id"), "left")
    return rows.groupBy(F.coalesce("status", F.lit("missing_edge")).alias("status")).agg(F.count("*").alias("n"))
