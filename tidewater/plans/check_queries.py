"""Queries of request paths and of quality checks: orders stand in for calls, line items for edges, parts for symbols and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import paths
from tidewater.operators import checks
from tidewater.plans.registry import query
from tidewater.session import table


def _case(of, values):
    """Texts and columns by a remainder."""
    found = None
    for i, v in enumerate(values):
        v = v if not isinstance(v, str) else F.lit(v)
        found = F.when(of == i, v) if found is None else found.when(of == i, v)
    return found


PATHS = """with r as (select o_orderkey id, case o_orderkey % 12 when 0 then '/Books' when 1 then '/Books?$top=' || o_custkey % 10 when 2 then '/Books(ID=''' || o_custkey || ''')' when 3 then '/Authors(' || o_custkey || ')/books' when 4 then '/Authors(${id})/content'
  when 5 then '/score(x=1,y=${ v })' when 6 then '/score(x=1)?$select=v' when 7 then '/submit' when 8 then '/${name}/x' when 9 then ' relative ' when 10 then '/Books(' || o_custkey end path,
  case o_custkey % 5 when 0 then 'GET' when 1 then 'post' when 2 then ' DELETE' when 4 then 'PATCH' end as method from orders),
x as (select id, trim(coalesce(path, '')) raw, coalesce(upper(trim(method)), 'GET') verb, len(regexp_extract_all(coalesce(path, ''), '\\(')) <> len(regexp_extract_all(coalesce(path, ''), '\\)')) bad from r),
y as (select *, split_part(raw, '?', 1) base, contains(raw, '?') asked, regexp_matches(raw, '^/[^/?]+/') deep, contains(raw, '(') held, nullif(regexp_extract(raw, '^/?([^/(?]*)', 1), '') head from x),
z as (select *, regexp_matches(base, '/content$') media, coalesce(regexp_matches(head, '^[A-Z]'), false) up, held and not deep and coalesce(regexp_matches(head, '^[a-z]'), false) and not bad called from y)
"""


def _paths(spark, sf_dir):
    c = F.col("o_custkey")
    path = _case(F.col("o_orderkey") % 12, [
        "/Books", F.concat(F.lit("/Books?$top="), c % 10), F.concat(F.lit("/Books(ID='"), c, F.lit("')")), F.concat(F.lit("/Authors("), c, F.lit(")/books")), "/Authors(${id})/content", "/score(x=1,y=${ v })", "/score(x=1)?$select=v", "/submit", "/${name}/x",
        " relative ", F.concat(F.lit("/Books("), c)])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), path.alias("path"), _case(c % 5, ["GET", "post", " DELETE", F.lit(None), "PATCH"]).alias("method"))


@query("odata_intent", PATHS + """select id, verb, case when bad then null else head end head, case when not starts_with(raw, '/') or bad or contains(head, '${') then 'unknown'
  when verb = 'GET' and asked then case when deep then 'entity_navigation_query' when called then 'unknown' else 'entity_query' end when verb = 'GET' and deep then case when media then 'entity_media' else 'entity_navigation_query' end
  when called then 'operation_invocation' when verb = 'GET' and held then 'entity_key_read' when verb = 'GET' then case when up then 'entity_candidate' else 'unknown' end
  when media then 'entity_media' when held or deep or up then case when verb = 'DELETE' then 'entity_delete' else 'entity_mutation' end else 'operation_invocation' end kind,
  case when bad or called or raw not like '%(%${%' then '' else regexp_extract(raw, '\\$\\{ *([^ }]*) *\\}', 1) end key_keys, case when deep and not bad then regexp_extract(base, '^/[^/]*/(.*)$', 1) end navigation from z""")
def odata_intent(spark, sf_dir):
    found = paths.intents(_paths(spark, sf_dir), "path", "method")
    return found.select("id", "verb", "head", "kind", F.array_join("key_keys", ",").alias("key_keys"), "navigation")


@query("odata_invocation", PATHS + """select id, case when raw = '' then null when not bad and held and not asked and not deep then regexp_extract(raw, '^[^(]*') else raw end normalized,
  case when raw = '' then null when bad then 'path_parenthesis_is_unbalanced' when not held then 'no_top_level_parenthesis' when asked then 'query_string_paths_are_not_operation_invocations' when deep then 'operation_segment_contains_navigation_separator' end rejected from z""")
def odata_invocation(spark, sf_dir):
    return paths.invocations(_paths(spark, sf_dir), "path").select("id", "normalized", "rejected")


FACTS = """with c as (select o_orderkey id, case o_orderkey % 6 when 0 then 'remote_action' when 1 then 'remote_query' when 2 then 'external_http' when 3 then 'local_service_call' when 4 then 'local_db_query' else 'remote_entity' end as type,
  case when o_custkey % 4 > 0 then '/f(1)' end path, case when o_custkey % 3 = 0 then 1 end bound, case when o_custkey % 50 > 0 then 1 end owner, case when o_custkey % 4 > 0 then 'E' end entity, case when o_custkey % 9 = 0 then 'dynamic_operation_path_identifier' end reason,
  case o_custkey % 7 when 0 then null when 1 then 'no json' when 2 then '[1]' when 3 then '{"receiver":"srv"}' else '{"parser":"p"}' end evidence from orders),
e as (select l_orderkey call, case l_partkey % 5 when 0 then 'UNRESOLVED_EDGE' when 1 then 'HANDLER_RUNS_REMOTE_QUERY' else 'HANDLER_CALLS' end edge_type, case l_partkey % 4 when 0 then 'unresolved' when 1 then 'terminal' when 2 then 'resolved' else 'dynamic' end status,
  case l_suppkey % 4 when 0 then l_suppkey || '' when 1 then 'Remote action: unknown path' when 2 then 'Remote action: dynamic path' else 'svc1' end target, l_suppkey % 3 = 0 dyn, case when l_partkey % 6 = 0 then 'local_service_candidate_without_caller_ownership' end reason,
  case l_partkey % 7 when 0 then null when 1 then 'x' when 2 then '7' when 3 then '{"outboundEvidence":{"parser":"p"},"candidateCount":2}' when 4 then '{"externalTarget":{"kind":"host"},"candidateCount":0}' when 5 then '{"why":"implementation_context_caller_ownership"}' else '{}' end evidence
  from lineitem where l_linenumber <= 2 and l_orderkey % 5 > 0),
j as (select c.type, e.* from c left join e on call = id),
s as (select case p_partkey % 3 when 0 then 'this.a.b' when 1 then 'this.a' else 'x' end expression, case when p_partkey % 2 = 0 then 'unresolved' else 'resolved' end status,
  case p_partkey % 5 when 0 then '{"relation":"indexed_this_method"}' when 1 then '{"relation":"class_instance_method","className":"Map"}' when 2 then '{"relation":"class_instance_method","className":"Own"}' when 3 then '[]' end evidence from part)
"""


def _facts(spark, sf_dir):
    k, c, p, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("l_partkey"), F.col("l_suppkey")
    calls = table(spark, sf_dir, "orders").select(
        k.alias("id"), _case(k % 6, ["remote_action", "remote_query", "external_http", "local_service_call", "local_db_query", "remote_entity"]).alias("type"), F.when(c % 4 > 0, "/f(1)").alias("path"), F.when(c % 3 == 0, 1).alias("bound"),
        F.when(c % 50 > 0, 1).alias("owner"), F.when(c % 4 > 0, "E").alias("entity"), F.when(c % 9 == 0, "dynamic_operation_path_identifier").alias("reason"),
        _case(c % 7, [F.lit(None), "no json", "[1]", '{"receiver":"srv"}', '{"parser":"p"}', '{"parser":"p"}', '{"parser":"p"}']).alias("evidence"))
    edges = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 and l_orderkey % 5 > 0").select(
        F.col("l_orderkey").alias("call"), _case(p % 5, ["UNRESOLVED_EDGE", "HANDLER_RUNS_REMOTE_QUERY", "HANDLER_CALLS", "HANDLER_CALLS", "HANDLER_CALLS"]).alias("edge_type"), _case(p % 4, ["unresolved", "terminal", "resolved", "dynamic"]).alias("status"),
        _case(s % 4, [s.cast("string"), "Remote action: unknown path", "Remote action: dynamic path", "svc1"]).alias("target"), (s % 3 == 0).alias("is_dynamic"), F.when(p % 6 == 0, "local_service_candidate_without_caller_ownership").alias("reason"),
        _case(p % 7, [F.lit(None), "x", "7", '{"outboundEvidence":{"parser":"p"},"candidateCount":2}', '{"externalTarget":{"kind":"host"},"candidateCount":0}', '{"why":"implementation_context_caller_ownership"}', "{}"]).alias("evidence"))
    return calls, edges


def _sql(source, **measures):
    return FACTS + " union all ".join(f"select '{m}' measure, ({x})::double as value from {source}" for m, x in measures.items())


def _add(name, check, pass_, sql):
    @query(name, sql)
    def run(spark, sf_dir):
        return pass_(spark, sf_dir).where(F.col("check") == check).select("measure", "value")


def _joined(spark, sf_dir):
    return checks.edges_of_calls(*_facts(spark, sf_dir))


def _alone(spark, sf_dir):
    return checks.calls_alone(_facts(spark, sf_dir)[0])


def _symbols(spark, sf_dir):
    p = F.col("p_partkey")
    evidence = _case(p % 5, ['{"relation":"indexed_this_method"}', '{"relation":"class_instance_method","className":"Map"}', '{"relation":"class_instance_method","className":"Own"}', "[]"])
    return checks.symbol_calls(table(spark, sf_dir, "part").select(_case(p % 3, ["this.a.b", "this.a", "x"]).alias("expression"), F.when(p % 2 == 0, "unresolved").otherwise("resolved").alias("status"), evidence.alias("evidence")))


def _n(condition):
    return f"count(*) filter ({condition})"


Q, A, H, L = (f"type = '{t}'" for t in ("remote_query", "remote_action", "external_http", "local_service_call"))
OBJECT = "coalesce(case when json_valid(evidence) then json_type(evidence) = 'OBJECT' end, false)"
_add("gq_remote_query", "remote_query", _joined, _sql("j", total=_n(Q), terminal=_n(f"{Q} and edge_type = 'HANDLER_RUNS_REMOTE_QUERY' and status = 'terminal'"), numeric=_n(f"{Q} and edge_type = 'HANDLER_RUNS_REMOTE_QUERY' and regexp_matches(target, '^[0-9]')"), unresolved=_n(f"{Q} and (edge_type = 'UNRESOLVED_EDGE' or status = 'unresolved')")))
_add("gq_remote_action", "remote_action", _joined, _sql("j", total=_n(A), unresolved=_n(f"{A} and status = 'unresolved'"), numeric=_n(f"{A} and status = 'unresolved' and regexp_matches(target, '^[0-9]')"), semantic=_n(f"{A} and status = 'unresolved' and target like 'Remote action: %'")))
_add("gq_external_http", "external_http", _joined, _sql("j", total=_n(H), numeric=_n(f"{H} and regexp_matches(target, '^[0-9]')"), invalid_evidence=_n(f"{H} and coalesce(evidence, '') not like '%externalTarget%'")))
_add("gq_local_calls", "local_calls", _joined, _sql("j", by_context=_n(f"{L} and status = 'resolved' and evidence like '%implementation_context%'"), without_ownership=_n(f"{L} and reason is not null"), unresolved=_n(f"{L} and status = 'unresolved'"), outside=_n(f"{L} and status = 'unresolved' and evidence like '%:2}}'")))
_add("gq_graph_evidence", "graph_evidence", _joined, _sql("j", total=_n("call is not null"), non_object=_n(f"call is not null and not {OBJECT}"), with_outbound=_n("evidence like '%outboundEvidence%'")))
_add("gq_db_query", "db_query", _alone, _sql("c where type = 'local_db_query'", total="count(*)", known="count(entity)", unknown=_n("entity is null"), ratio=f"round({_n('entity is null')} / count(*), 4)"))
_add("gq_ownership", "ownership", _alone, _sql("c", total="count(*)", without=_n("owner is null"), ratio=f"round({_n('owner is null')} / count(*), 4)"))
_add("gq_json", "outbound_evidence", _alone, _sql("c", total="count(*)", missing=_n("evidence is null"), invalid=_n("not json_valid(evidence)"), non_object=_n(f"json_valid(evidence) and not {OBJECT}")))
_add("gq_alias", "alias", _alone, _sql("c", missed=_n(f"{A} and bound is null and evidence like '%receiver%'")))
_add("gq_wrapper_path", "wrapper_path", _alone, _sql("c", open=_n(f"{A} and reason is not null")))
_add("gq_symbol_evidence", "symbol_evidence", _symbols, _sql("s", total="count(*)", non_object=_n(f"evidence is not null and not {OBJECT}")))
_add("gq_class_noise", "class_noise", _symbols, _sql("s", total=_n("evidence like '%class_instance%'"), unresolved=_n("evidence like '%class_instance%' and status = 'unresolved'"), built_in=_n("evidence like '%\"Map\"%' and status = 'unresolved'")))
_add("gq_nested_this", "nested_this", _symbols, _sql("s where expression like 'this.%.%'", total="count(*)", current_class=_n("evidence like '%indexed_this%'"), helper=_n("evidence like '%class_instance%'")))


@query("gq_dynamic_flag", FACTS + "select count(*) n from e where status = 'terminal' and dyn")
def gq_dynamic_flag(spark, sf_dir):
    return _facts(spark, sf_dir)[1].where("status = 'terminal' and is_dynamic").agg(F.count("*").alias("n"))


@query("gq_no_binding", FACTS + "select coalesce(status, 'missing_edge') status, count(*) n from c left join e on call = id where type = 'remote_action' and path is not null and bound is null group by 1")
def gq_no_binding(spark, sf_dir):
    return checks.unbound_actions(*_facts(spark, sf_dir))


@query("gq_decorator", """select case when m = 1 then 'constants' else 'unresolved' end measure, count(*)::double as value from (select case when c_custkey % 5 in (0, 1) then 1 when c_custkey % 5 = 2 then 2 end m from customer) where m is not null group by m""")
def gq_decorator(spark, sf_dir):
    kind = _case(F.col("c_custkey") % 5, ["const_identifier", "enum_member", "unresolved", "literal"])
    return checks.decorators(table(spark, sf_dir, "customer").select(F.to_json(F.struct(kind.alias("resolutionKind"))).alias("resolution"))).select("measure", "value")


@query("gq_registration", """with g as (select c_custkey % 7 repo, 'C' || c_custkey % 40 as name, c_custkey % 300 class, case when c_custkey % 3 > 0 then 'm' end imported from customer),
k as (select p_partkey class, p_partkey % 7 repo, 'C' || p_partkey % 40 as name from part)
select 'mismatched' measure, count(*)::double as value from g join k using (class) where g.repo <> k.repo or g.name <> k.name
union all select 'prevented', count(*)::double from g join k using (class) join k o on o.name = g.name and o.repo <> g.repo where imported is not null""")
def gq_registration(spark, sf_dir):
    c, p = F.col("c_custkey"), F.col("p_partkey")
    rows = table(spark, sf_dir, "customer").select((c % 7).alias("repo"), F.concat(F.lit("C"), c % 40).alias("name"), (c % 300).alias("class"), F.when(c % 3 > 0, "m").alias("imported"))
    classes = table(spark, sf_dir, "part").select(p.alias("class"), (p % 7).alias("repo"), F.concat(F.lit("C"), p % 40).alias("name"))
    return checks.registrations(rows, classes).select("measure", "value")
