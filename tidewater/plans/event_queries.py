"""Queries of event links: orders stand in for emits and subscriptions, parts for declarations, line items for handed-over handlers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import event_links
from tidewater.operators.ranking import first_few
from tidewater.plans.registry import query
from tidewater.session import table


def _text(*parts):
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


def _facts(spark, sf_dir):
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("p_partkey")
    orders = table(spark, sf_dir, "orders")
    template = F.when(k % 6 == 0, _text("order/", c % 50)).when(k % 6 == 1, "${region}/changed").when(k % 6 == 2, "${region}/${ kind }").when(k % 6 == 4, "done").when(k % 6 == 5, "topic/${kind}")
    entries = F.filter(F.array(
        F.when(c % 5 == 0, F.struct(F.lit("region").alias("k"), F.lit("eu").alias("v"))), F.when(k % 4 == 1, F.struct(F.lit("KIND").alias("k"), _text("k", c % 3).alias("v")))), lambda e: e.isNotNull())
    calls = orders.select(
        k.alias("id"), (k % 3).alias("workspace"), (k % 40).alias("repo"), (c % 2 == 0).alias("emits"), template.alias("template"), F.when((k % 6 == 4) & (c % 3 > 0), "event_name_call").alias("parse_reason"),
        F.when(c % 7 == 0, "unproven").when(c % 7 == 1, "name_fallback").otherwise("proven").alias("receiver"), F.when(c % 14 == 7, "event_receiver_reassigned").alias("receiver_reason"),
        F.map_from_entries(entries).alias("vars"), F.array(F.lit("kind")).alias("sources"), F.array(F.lit("KIND")).alias("canonicals"), c.alias("cust"))
    bound = orders.where(k % 6 < 3).where(k % 6 > 0)
    bindings = bound.select(k.alias("id"), F.lit(0).alias("at"), F.lit("region").alias("source_key"), _text("REGION_", c % 3).alias("env_key"), F.when(k % 5 == 0, F.array(F.lit("lower"), F.lit("upper"))).alias("transforms"), (k % 31 == 0).alias("refused"))
    bindings = bindings.union(bound.where(k % 6 == 2).select(k, F.lit(1), F.lit("kind"), F.lit("KIND"), F.lit(None), F.lit(False))).withColumn("reason", F.lit(None).cast("string"))
    declarations = table(spark, sf_dir, "part").where(p % 8 != 3).select((p % 40).alias("repo"), F.when(p % 7 == 0, "KIND").otherwise(_text("REGION_", p % 3)).alias("key"), F.when(p % 97 == 0, "Us").otherwise("Eu").alias("value"))
    r = F.col("repo")
    states = orders.select((k % 40).alias("repo")).distinct().where(r % 11 > 0).select("repo", F.when(r % 9 == 1, "incomplete").when(r % 13 == 2, "ambiguous").otherwise("complete").alias("state"))
    return calls, bindings, declarations, states


ENVIRONMENTS = """with c as (select o_orderkey id, o_orderkey % 3 workspace, o_orderkey % 40 repo, o_custkey cust, o_custkey % 2 = 0 emits,
  case o_orderkey % 6 when 0 then 'order/' || o_custkey % 50 when 1 then '${region}/changed' when 2 then '${region}/${kind}' when 4 then 'done' when 5 then 'topic/${kind}' else '' end template,
  case when o_orderkey % 6 = 4 and o_custkey % 3 > 0 then 'event_name_call' end parse_reason, case when o_custkey % 7 = 0 then case when o_custkey % 14 = 7 then 'event_receiver_reassigned' else 'event_receiver_unproven_binding' end end receiver,
  case when o_custkey % 5 = 0 then 'eu' end vr, case when o_orderkey % 4 = 1 then 'k' || o_custkey % 3 end vk from orders),
s as (select repo, case when repo % 9 = 1 then 'incomplete' when repo % 13 = 2 then 'ambiguous' else 'complete' end state from (select distinct repo from c where repo % 11 > 0)),
d as (select p_partkey % 40 repo, case when p_partkey % 7 = 0 then 'KIND' else 'REGION_' || p_partkey % 3 end ek, min(case when p_partkey % 97 = 0 then 'Us' else 'Eu' end) lo, count(distinct p_partkey % 97 = 0) n from part where p_partkey % 8 <> 3 group by all),
b as (select id, 0 pos, vr given, 'REGION_' || cust % 3 ek, id % 31 = 0 refused from c where id % 6 in (1, 2) union all select id, 1, vk, 'KIND', false from c where id % 6 = 2),
o as (select b.id, pos, case when given is not null then null when refused then 'event_environment_reference_refused' when state = 'incomplete' then 'event_environment_declarations_incomplete'
  when state = 'ambiguous' or n > 1 then 'event_environment_declaration_ambiguous' when n is null then 'event_environment_declaration_missing' end why,
  case when given is not null then null when b.pos = 0 and b.id % 5 = 0 then upper(lo) else lo end put from b join c using (id) left join s using (repo) left join d on d.repo = c.repo and d.ek = b.ek),
g as (select id, arg_min(why, pos) filter (why is not null) fw, coalesce(bool_or(why = 'event_environment_declaration_ambiguous'), false) amb, max(put) filter (pos = 0 and why is null) pr, max(put) filter (pos = 1 and why is null) pk from o group by 1),
e as (select c.*, case when g.id is null then 'not_applicable' when state is null then 'unresolved' when amb then 'ambiguous' when fw is not null then 'unresolved' else 'resolved' end environment,
  case when g.id is null then null when state is null then 'event_environment_declarations_invalid' when amb then 'event_environment_declaration_ambiguous' else fw end env_reason,
  case when g.id is not null and state is null then vr else coalesce(vr, pr) end r, case when g.id is not null and state is null then null else coalesce(vk, pk) end k from c left join g using (id) left join s using (repo)),
"""
EDGES = ENVIRONMENTS + """m as (select *, replace(replace(template, '${region}', coalesce(r, '${region}')), '${kind}', coalesce(k, '${kind}')) effective, concat_ws(', ', case when contains(template, '${region}') and r is null then 'region' end, case when contains(template, '${kind}') and k is null then 'kind' end) miss,
  contains(template, '${') holes from e),
p as (select *, miss <> '' or parse_reason is not null published from m),
x as (select *, case when not published then receiver end unproven, published or (not emits and receiver is not null) dynamic,
  case when miss <> '' then 'Dynamic target requires runtime variable overrides: ' || miss else parse_reason end why from p),
edge as (select id, workspace, cust, emits, template, holes, miss, environment, env_reason, case when dynamic then 'DYNAMIC_EDGE_CANDIDATE' when emits then 'HANDLER_EMITS_EVENT' else 'EVENT_CONSUMED_BY_HANDLER' end edge_type,
  case when dynamic then 'dynamic' else 'terminal' end status, case when dynamic then 'event_candidate' else 'event' end target_kind, case when dynamic then 'Event: ' else '' end || effective target, dynamic is_dynamic,
  case when unproven is not null then 'receiver_unproven' when environment = 'resolved' then 'environment_declaration_exact' when dynamic then 'runtime_variables_required' else 'static_name_only' end certainty,
  coalesce(env_reason, why, unproven) reason, coalesce(why, unproven) name_reason from x)
"""


@query("g_event_env", ENVIRONMENTS.rstrip(",\n") + " select id, environment, env_reason reason, r region, k kind from e")
def g_event_env(spark, sf_dir):
    found = event_links.environments(*_facts(spark, sf_dir))
    return found.select("id", "environment", "reason", F.element_at("variables", "region").alias("region"), F.element_at("variables", "kind").alias("kind"))


def _edges(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return facts[0], event_links.edges(facts[0], event_links.environments(*facts))


@query("g_event_edge", EDGES + "select id, edge_type, status, target_kind, target, is_dynamic, certainty, reason from edge")
def g_event_edge(spark, sf_dir):
    return _edges(spark, sf_dir)[1].select("id", "edge_type", "status", "target_kind", "target", "is_dynamic", "certainty", "reason")


HANDLERS = """sub as (select o_orderkey id, o_orderkey % 3 workspace, o_orderkey % 40 repo, o_orderkey % 7 file, case when o_custkey % 21 <> 1 then o_orderkey end a, case when o_custkey % 23 = 1 then o_orderkey else o_orderkey + 3 end b, o_orderkey % 1000 line,
  case when o_custkey % 6 <> 1 then o_orderkey % 5 end symbol from orders where o_custkey % 2 = 1),
site as (select l_orderkey * 8 + l_linenumber call, l_orderkey % 40 repo, l_orderkey % 7 file, l_orderkey a, l_orderkey + case when l_linenumber <= l_orderkey % 3 then 3 else 9 end b, l_orderkey % 5 + case when l_partkey % 11 = 0 then 1 else 0 end caller,
  case when l_partkey % 19 > 0 then l_partkey end callee, case l_suppkey % 5 when 0 then 'ambiguous' when 1 then 'unresolved' else 'resolved' end status, l_orderkey % 1000 + case when l_suppkey % 13 = 0 then 1 else 0 end line,
  case when l_partkey % 17 = 0 then 7 when l_partkey % 2 = 0 then l_orderkey % 3 end workspace, case when l_returnflag <> 'N' then l_returnflag end origin, l_linestatus reason from lineitem),
spot as (select repo, file, a, b, count(*) n, arg_min(site, call) one, case when count(distinct coalesce(origin, 'missing')) > 1 then 'mixed' else max(origin) end origin, case when count(distinct status) > 1 then 'mixed' else max(status) end sites from site group by 1, 2, 3, 4),
j as (select sub.*, coalesce(n, 0) matches, one, spot.origin, sites, case when sub.a is null or sub.b <= sub.a then 'subscription_call_span_missing' when n is null then 'subscription_handler_role_site_missing' when n > 1 then null
  when symbol <> one.caller then 'subscription_handler_caller_mismatch' when one.line <> line then 'subscription_handler_source_line_mismatch' when one.workspace <> workspace then 'subscription_handler_target_workspace_mismatch' end lost,
  sub.a is null or sub.b <= sub.a broken from sub left join spot on spot.repo = sub.repo and spot.file = sub.file and spot.a = sub.a and spot.b = sub.b),
h as (select id, case when lost is not null then 'unresolved' when matches > 1 or one.status = 'ambiguous' then 'ambiguous' when one.status = 'resolved' and one.callee is not null then 'resolved' else 'unresolved' end status,
  case when lost is not null or matches > 1 then 'subscription_handler' when one.status = 'resolved' and one.callee is not null then 'symbol' else 'symbol_reference' end to_kind,
  (case when lost is not null or matches > 1 then id when one.status = 'resolved' and one.callee is not null then one.callee else one.call end)::varchar to_id,
  case when lost is not null then lost when matches > 1 then 'multiple_handler_role_site_matches' when one.status = 'ambiguous' then 'subscription_handler_reference_ambiguous'
    when one.status <> 'resolved' then 'subscription_handler_reference_unresolved' when one.callee is null then 'resolved_handler_symbol_missing' end reason,
  matches, lost is not null missing, case when not broken then origin end origin, case when not broken then sites end call_status, case when not broken and matches = 1 then one.reason end call_reason from j)
"""


def _handlers(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    subscriptions = table(spark, sf_dir, "orders").where(c % 2 == 1).select(
        k.alias("id"), (k % 3).alias("workspace"), (k % 40).alias("repo"), (k % 7).alias("file"), F.when(c % 21 != 1, k).alias("start"), F.when(c % 23 == 1, k).otherwise(k + 3).alias("end"), (k % 1000).alias("line"), F.when(c % 6 != 1, k % 5).alias("symbol"))
    o, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    sites = table(spark, sf_dir, "lineitem").select(
        (o * 8 + F.col("l_linenumber")).alias("call"), (o % 40).alias("repo"), (o % 7).alias("file"), o.alias("start"), (o + F.when(F.col("l_linenumber") <= o % 3, 3).otherwise(9)).alias("end"), (o % 5 + F.when(p % 11 == 0, 1).otherwise(0)).alias("caller"),
        F.when(p % 19 > 0, p).alias("callee"), F.when(s % 5 == 0, "ambiguous").when(s % 5 == 1, "unresolved").otherwise("resolved").alias("status"), (o % 1000 + F.when(s % 13 == 0, 1).otherwise(0)).alias("line"),
        F.when(p % 17 == 0, F.lit(7).cast("long")).when(p % 2 == 0, o % 3).alias("workspace"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("origin"), F.col("l_linestatus").alias("reason"))
    return event_links.handlers(subscriptions, sites)


@query("g_sub_handler", "with " + HANDLERS + "select * from h")
def g_sub_handler(spark, sf_dir):
    return _handlers(spark, sf_dir)


@query("j_role_site", "with " + HANDLERS + "select id, matches, origin, call_status from h where matches > 0")
def j_role_site(spark, sf_dir):
    return _handlers(spark, sf_dir).where("matches > 0").select("id", "matches", "origin", "call_status")


def _handled(spark, sf_dir):
    calls, edges = _edges(spark, sf_dir)
    found = event_links.handled(edges, _handlers(spark, sf_dir))
    return calls, edges, found.join(calls.select("id", "workspace", "sources", "canonicals", "cust"), "id").withColumn("edge", F.col("id"))


HANDLED = EDGES.rstrip() + ",\n" + HANDLERS.rstrip() + """,
hb as (select e.id, e.workspace, e.cust, e.target_kind from_kind, e.target event, case when is_dynamic then 'unresolved' when environment = 'ambiguous' then 'ambiguous' else h.status end status, h.to_kind, h.to_id, h.status association,
  case when is_dynamic then case when environment = 'unresolved' then env_reason when miss <> '' then 'event_template_variables_missing' else coalesce(name_reason, 'event_name_unsupported_constant_expression') end
    when environment = 'ambiguous' then env_reason else coalesce(h.reason, call_reason) end reason, template, holes, is_dynamic from edge e join h using (id))
"""


@query("g_event_handled", HANDLED + "select id, from_kind, event, status, to_kind, to_id, association, reason from hb")
def g_event_handled(spark, sf_dir):
    return _handled(spark, sf_dir)[2].select("id", "from_kind", "event", "status", "to_kind", "to_id", "association", "reason")


@query("g_event_bridge", HANDLED.rstrip() + """,
n as (select workspace, cust % 4 // 2 run, target event, count(*) emits from edge where edge_type = 'HANDLER_EMITS_EVENT' group by all),
rt as (select r.run, hb.*, replace(replace(template, '${region}', case r.run when 0 then 'Eu' else 'eu' end), '${kind}', case r.run when 0 then 'k1' else 'k2' end) filled from hb, (select unnest([0, 1]) run) r where holes),
u as (select workspace, run, event, emits, id, to_kind, to_id, status, 'exact' strategy from hb join n using (workspace, event) where from_kind = 'event'
  union all select workspace, run, filled, emits, id, to_kind, to_id, association, 'runtime' from rt join (select workspace, run, event filled, emits from n) using (workspace, run, filled) where from_kind <> 'event' or event <> filled)
select workspace, run, event, emits, id subscription, to_kind, to_id, status, any_value(strategy) strategy, count(*) dispatches, string_agg(id, ',') shown from u group by workspace, run, event, emits, id, to_kind, to_id, status""")
def g_event_bridge(spark, sf_dir):
    """Runs of two sets of variables in each workspace."""
    calls, edges, handled = _handled(spark, sf_dir)
    emitted = edges.where("edge_type = 'HANDLER_EMITS_EVENT'").join(calls.select("id", "workspace", "cust"), "id").select("workspace", F.expr("cust % 4 div 2").alias("run"), F.col("target").alias("event"))
    sets = {0: {"region": "Eu", "kind": "k1"}, 1: {"region": "eu", "KIND": "k2"}}
    runs = spark.createDataFrame([(w, r, v) for w in range(3) for r, v in sets.items()], "workspace long, run long, vars map<string,string>")
    return event_links.received(handled, emitted, runs)


PUBLISHED = "pub as (select * from edge where edge_type = 'HANDLER_EMITS_EVENT' and target_kind = 'event')"


@query("gq_pub_unmatched", HANDLED.rstrip() + f""",
{PUBLISHED}, bad as (select * from pub where not exists (select 1 from hb where hb.workspace = pub.workspace and from_kind = 'event' and event = target))
select workspace, count(*) total, array_to_string(list(id order by id)[1:5], ',') examples from bad group by 1""")
def gq_pub_unmatched(spark, sf_dir):
    calls, edges, handled = _handled(spark, sf_dir)
    published = edges.where("edge_type = 'HANDLER_EMITS_EVENT' and target_kind = 'event'").select("id", F.col("target").alias("event")).join(calls.select("id", "workspace"), "id")
    return first_few(event_links.unmatched(published, handled)[0], "workspace", "id", 5, "total", "examples")


@query("gq_sub_unmatched", HANDLED.rstrip() + f""",
{PUBLISHED}, bad as (select * from hb where not exists (select 1 from pub where hb.workspace = pub.workspace and event = target))
select workspace, count(distinct id) sites, sum(case when cust % 8 = 1 then 1 when cust % 8 = 3 then cust % 5 when cust % 8 = 5 then 0 else 1 end)::bigint registrations, count(distinct id) filter (cust % 8 = 5) unknown_sites from bad group by 1""")
def gq_sub_unmatched(spark, sf_dir):
    calls, edges, handled = _handled(spark, sf_dir)
    published = edges.where("edge_type = 'HANDLER_EMITS_EVENT' and target_kind = 'event'").select("id", F.col("target").alias("event")).join(calls.select("id", "workspace"), "id")
    loop = F.col("cust") % 8
    bad = event_links.unmatched(published, handled)[1].select("workspace", "id", F.when(loop == 1, "x").alias("loop_name"), F.when(loop == 3, "enumerated").when(loop == 5, "unresolved").alias("loop_status"), (F.col("cust") % 5).alias("loop_count"))
    return bad.groupBy("workspace").agg(*event_links.multiplicity(bad))


@query("gq_event_dynamic", EDGES + """select workspace, count(distinct target) filter (target_kind = 'event_candidate') candidates, count(*) total, count(*) filter (holes) recoverable, count(*) filter (not holes) others from edge
where target_kind = 'event_candidate' or edge_type = 'DYNAMIC_EDGE_CANDIDATE' group by 1""")
def gq_event_dynamic(spark, sf_dir):
    calls, edges = _edges(spark, sf_dir)
    rows = edges.where("target_kind = 'event_candidate' or edge_type = 'DYNAMIC_EDGE_CANDIDATE'").join(calls.select("id", "workspace"), "id")
    holes = F.size("placeholders") > 0
    return rows.groupBy("workspace").agg(
        F.count_distinct(F.when(F.col("target_kind") == "event_candidate", F.col("target"))).alias("candidates"), F.count("*").alias("total"), F.count_if(holes).alias("recoverable"), F.count_if(~holes).alias("others"))


@query("gq_receiver", EDGES + """select workspace, count(*) total, count(*) filter (cust % 7 > 1) proven, count(*) filter (cust % 7 = 1) fallback, count(*) filter (cust % 7 = 0) unproven,
count(*) filter (emits and certainty = 'receiver_unproven') emits_unproven, count(*) filter (emits and certainty = 'environment_declaration_exact') emits_declared,
count(*) filter (emits and certainty = 'runtime_variables_required') emits_open, count(*) filter (emits and certainty = 'static_name_only') emits_static from edge group by 1""")
def gq_receiver(spark, sf_dir):
    calls, edges = _edges(spark, sf_dir)
    rows = calls.select("id", "workspace", "receiver", "emits").join(edges.select("id", "certainty"), "id")
    of, sure = F.col("receiver"), lambda c: F.count_if(F.col("emits") & (F.col("certainty") == c))
    return rows.groupBy("workspace").agg(
        F.count("*").alias("total"), F.count_if(of == "proven").alias("proven"), F.count_if(of == "name_fallback").alias("fallback"), F.count_if(of == "unproven").alias("unproven"),
        sure("receiver_unproven").alias("emits_unproven"), sure("environment_declaration_exact").alias("emits_declared"), sure("runtime_variables_required").alias("emits_open"), sure("static_name_only").alias("emits_static"))
