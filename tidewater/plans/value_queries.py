"""Queries for redaction, bounded values, templates, package links and implementation scores, on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import text
from tidewater.operators import linking
from tidewater.plans.log_queries import LOG, log_rows
from tidewater.plans.registry import query
from tidewater.session import table


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SQL_MAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+\b"


@query("f_level", LOG + "select id, app from log where level = 'warn'")
def f_level(spark, sf_dir):
    return log_rows(spark, sf_dir).where("level = 'warn'").select("id", "app")


@query("f_stream", LOG + "select id, source from log where stream = 'ERR'")
def f_stream(spark, sf_dir):
    return log_rows(spark, sf_dir).where("stream = 'ERR'").select("id", "source")


@query("fn_redact_text", f"select doc_id, regexp_replace(text, {_sql(text.ASSIGNED_VALUE)}, '\\1: [REDACTED]', 'g') as text from documents")
def fn_redact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redact_assignments(F.col("text")).alias("text"))


SECRETS = "made as (select doc_id, case doc_id % 7 when 0 then 'jdbc:sap://bob:pw' || doc_id || '@db.example/x' when 1 then 'https://bob@example.net/' || doc_id when 2 then 'Bearer abc' || doc_id || ', more' when 3 then '-----BEGIN RSA PRIVATE KEY----- ' || text else text end as text from documents)"


@query("fn_redact_secret", f"""with {SECRETS}, u as (select *, regexp_replace(text, {_sql(text.USER_INFO)}, '\\1redacted:redacted@\\2') url,
  regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\b(?:Bearer|Basic)\\s+[^\\s,;]+', '[REDACTED]', 'g'), '\\beyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\b', '[REDACTED]', 'g'), {_sql('(^|[^A-Za-z0-9_])' + SQL_MAIL)}, '\\1[REDACTED]', 'g') rest from made)
select doc_id, case when regexp_matches(text, '{text.PEM}') then '[REDACTED]' when starts_with(lower(text), 'jdbc:') and url <> text then url
  when regexp_matches(text, '(?i)(?:^|[^a-z0-9])(?:{text.SECRET_ASSIGNED})\\s*[=:]') then '[REDACTED]' when url <> text then url else rest end as text from u""")
def fn_redact_secret(spark, sf_dir):
    kind = F.col("doc_id") % 7
    made = (
        F.when(kind == 0, F.concat(F.lit("jdbc:sap://bob:pw"), "doc_id", F.lit("@db.example/x"))).when(kind == 1, F.concat(F.lit("https://bob@example.net/"), "doc_id"))
        .when(kind == 2, F.concat(F.lit("Bearer abc"), "doc_id", F.lit(", more"))).when(kind == 3, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY----- "), "text")).otherwise(F.col("text"))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", made.alias("text"))
    return rows.select("doc_id", text.redact_secrets(F.col("text")).alias("text"))


@query("fn_redact_json")
def fn_redact_json(spark, sf_dir):
    inner = F.struct(F.col("text").alias("body"), F.lit("x").alias("apiKey"), F.array(F.lit("a"), F.lit("token=abc")).alias("list"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("source", inner.alias("inner"))).alias("raw"))
    return rows.select("doc_id", text.redact_json(F.col("raw")).alias("json"))


@query("byte_truncate", "select doc_id, left(text, list_max(list_filter(range(0, 101), lambda n: strlen(left(text, n)) <= 100))) preview, strlen(text) > 100 truncated from documents")
def byte_truncate(spark, sf_dir):
    preview, truncated = text.byte_prefix(F.col("text"), 100)
    return table(spark, sf_dir, "documents").select("doc_id", preview.alias("preview"), truncated.alias("truncated"))


@query("cell_window", "select doc_id, length(text) original_length, substring(text, 11, 40) window_text, strlen(text) original_bytes, '0x' || substring(lower(hex(encode(text))), 21, 40) window_binary from documents")
def cell_window(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").cast("long").alias("original_length"), F.substring("text", 11, 40).alias("window_text"), F.octet_length("text").cast("long").alias("original_bytes"),
        F.concat(F.lit("0x"), F.lower(F.hex(F.substring(raw, 11, 20)))).alias("window_binary"))


@query("fn_day_key", "select event_id, case event_id % 3 when 0 then strftime(ts, '%Y-%m-%d') when 1 then strftime(ts, '%Y-%m-%d') end as day from events")
def fn_day_key(spark, sf_dir):
    kind = F.col("event_id") % 3
    started = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+0700'")).when(kind == 1, F.date_format("ts", "yyyy/MM/dd HH:mm")).otherwise("yesterday")
    day = F.coalesce(F.nullif(F.regexp_extract("started", r"^\d{4}-\d{2}-\d{2}", 0), F.lit("")), F.date_format(F.try_to_timestamp("started", F.lit("yyyy/MM/dd HH:mm")), "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", started.alias("started")).select("event_id", day.alias("day"))


CELLS = "cells as (select event_id, case event_id % 8 when 0 then props when 1 then 'x' || props when 2 then '[1, 2]' when 3 then '\"s\"' when 4 then '1.5' when 5 then 'true' when 6 then 'null' end cell from events)"


@query("fn_json_valid", f"with {CELLS} select event_id, coalesce(json_valid(cell), false) valid from cells")
def fn_json_valid(spark, sf_dir):
    return _cells(spark, sf_dir).select("event_id", F.try_parse_json("cell").isNotNull().alias("valid"))


@query("fn_json_type", f"with {CELLS} select event_id, case event_id % 8 when 0 then 'object' when 2 then 'array' when 3 then 'text' when 4 then 'real' when 5 then 'true' when 6 then 'null' end as type from cells")
def fn_json_type(spark, sf_dir):
    kind = F.schema_of_variant("v")
    named = (
        F.when(F.startswith(kind, F.lit("OBJECT")), "object").when(F.startswith(kind, F.lit("ARRAY")), "array").when(kind == "STRING", "text").when(kind == "BIGINT", "integer")
        .when(kind == "BOOLEAN", F.try_variant_get("v", "$", "string")).when(kind == "VOID", "null").when(kind.isNotNull(), "real")
    )
    return _cells(spark, sf_dir).select("event_id", F.try_parse_json("cell").alias("v")).select("event_id", named.alias("type"))


def _cells(spark, sf_dir):
    kind = F.col("event_id") % 8
    cell = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("x"), "props")).when(kind == 2, "[1, 2]").when(kind == 3, '"s"').when(kind == 4, "1.5").when(kind == 5, "true").when(kind == 6, "null")
    return table(spark, sf_dir, "events").select("event_id", cell.alias("cell"))


@query("template_subst", "select p_partkey, p_name || '/' || p_brand || '/' || case when p_partkey % 3 = 0 then '${missing}' else p_brand end || '/${zone}' effective, case when p_partkey % 3 = 0 then 'brand,missing,zone' else 'brand,zone' end placeholders, 'brand' supplied, case when p_partkey % 3 = 0 then 'missing,zone' else 'zone' end missing, true changed from part")
def template_subst(spark, sf_dir):
    made = F.concat("p_name", F.lit("/${ brand }/"), F.when(F.col("p_partkey") % 3 == 0, "${missing}").otherwise("${brand}"), F.lit("/${zone}"))
    found = table(spark, sf_dir, "part").select("p_partkey", *text.substituted(made, F.create_map(F.lit("brand"), F.col("p_brand"))))
    lists = [F.array_join(c, ",").alias(c) for c in ("placeholders", "supplied", "missing")]
    return found.select("p_partkey", "effective", *lists, "changed")


@query("s_stable_rank", "select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_returnflag = 'R' desc, l_quantity desc, l_discount desc, l_linestatus, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_linenumber) as rank from lineitem")
def s_stable_rank(spark, sf_dir):
    order = [F.desc(F.col("l_returnflag") == "R"), F.desc("l_quantity"), F.desc("l_discount"), "l_linestatus", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber"]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long").alias("rank"))


@query("a_path_pattern", """with u as (select regexp_extract(url, '^[^:]+://([^/?#]*)', 1) host, nullif(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '') path from pages),
e as (select host, min(path) lo, max(path) hi from u group by 1),
p as (select *, left(lo, list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), lambda n: left(lo, n) = left(hi, n)))) prefix from e),
r as (select u.host, min(reverse(substring(path, length(prefix) + 1))) a, max(reverse(substring(path, length(prefix) + 1))) b from u join p on u.host = p.host where path is not null group by 1)
select p.host, coalesce(case when lo = hi then lo else prefix || '*' || reverse(left(a, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda n: left(a, n) = left(b, n))))) end, '') pattern from p left join r on p.host = r.host""")
def a_path_pattern(spark, sf_dir):
    at = "^[^:]+://([^/?#]*)([^?#]*)"
    return linking.path_patterns(table(spark, sf_dir, "pages").select(F.regexp_extract("url", at, 1).alias("host"), F.regexp_extract("url", at, 2).alias("path")), "host")


REPOS = """repos as (select p_partkey id, 'Svc_' || (p_partkey % 170) as name, case p_partkey % 3 when 0 then '@org/svc-' || (p_partkey % 90) when 1 then 'lib' || (p_partkey % 40) end package_name from part),
deps as (select p_partkey id, '@org/svc-' || (p_partkey * 7 % 200) dependency from part union select p_partkey, 'lib' || (p_partkey * 11 % 60) from part union select p_partkey, case when p_partkey % 5 = 0 then 'lib' || (p_partkey % 40) end from part)"""
DEP_EDGES = f"""with {REPOS}, plain as (select id, regexp_replace(regexp_replace(lower(name), '^@[^/]+/', ''), '[^a-z0-9]+', '', 'g') plain, package_name from repos),
asked as (select distinct id, dependency, regexp_replace(regexp_replace(lower(dependency), '^@[^/]+/', ''), '[^a-z0-9]+', '', 'g') plain from deps where dependency is not null),
exact as (select a.id, dependency, count(*) n, min(r.id) to_id from asked a join plain r on r.package_name = a.dependency and r.id <> a.id group by all),
near as (select a.id, dependency, count(*) n, min(r.id) to_id from asked a join plain r on r.plain = a.plain and r.id <> a.id group by all),
found as (select *, 'exact_package_name' as match from exact union all select near.*, 'normalized_directory' from near anti join exact using (id, dependency))
"""


def _repos(spark, sf_dir):
    i = F.col("p_partkey")
    rows = table(spark, sf_dir, "part")
    package = F.when(i % 3 == 0, F.concat(F.lit("@org/svc-"), i % 90)).when(i % 3 == 1, F.concat(F.lit("lib"), i % 40))
    repos = rows.select(i.alias("id"), F.concat(F.lit("Svc_"), i % 170).alias("name"), package.alias("package_name"))
    asked = F.array(F.concat(F.lit("@org/svc-"), i * 7 % 200), F.concat(F.lit("lib"), i * 11 % 60), F.when(i % 5 == 0, F.concat(F.lit("lib"), i % 40)))
    return repos, rows.select(i.alias("id"), F.explode(asked).alias("dependency"))


@query("j_dependency", DEP_EDGES + "select id, dependency, match, n candidates from found")
def j_dependency(spark, sf_dir):
    return linking.dependency_edges(*_repos(spark, sf_dir)).select("id", "dependency", "match", "candidates")


@query("g_dep_edge", DEP_EDGES + "select id, dependency, match, n candidates, case when n = 1 then 'resolved' else 'ambiguous' end status, case when n = 1 then to_id end to_id, case when n = 1 then 1.0::double else 0.5::double end confidence from found")
def g_dep_edge(spark, sf_dir):
    return linking.dependency_edges(*_repos(spark, sf_dir))


SIGN_BITS = ["model_is_application", "model_is_handler", "local_service_path", "application_needs_model", "application_needs_handler", "handler_needs_model", "imports_handler",
             "db_model", "has_local_services", "has_local_registration", "same_repo_registration", "method_matches", "method_contradicted"]
SPARSE = {"model_is_application": 5, "model_is_handler": 7, "method_contradicted": 11}
_bits = ", ".join(f"(l_partkey * {3 + 2 * k} + l_suppkey * {5 + k} + l_linenumber * {k + 1}) % {SPARSE.get(c, 2)} = 0 as {c}" for k, c in enumerate(SIGN_BITS))
SCORED = f"""with c as (select l_orderkey, l_linenumber, {_bits} from lineitem),
h as (select *, (db_model or not has_local_registration) and method_matches and same_repo_registration and imports_handler and not (has_local_services or model_is_application or model_is_handler or local_service_path or application_needs_model or application_needs_handler or handler_needs_model) helper_owned from c),
s as (select *, 100 * model_is_application::int + 100 * model_is_handler::int + 80 * local_service_path::int + 70 * application_needs_model::int + 30 * application_needs_handler::int + 20 * handler_needs_model::int + 60 * helper_owned::int + 10 * imports_handler::int score,
  model_is_application or model_is_handler or local_service_path or handler_needs_model or helper_owned or (application_needs_model and (model_is_handler or application_needs_handler or not imports_handler)) has_ownership from h),
f as (select *, has_ownership and method_matches and not method_contradicted and not (has_local_services and not (local_service_path or application_needs_model or model_is_application or model_is_handler)) accepted from s) """


def _candidates(spark, sf_dir):
    bit = lambda k, c: ((F.col("l_partkey") * (3 + 2 * k) + F.col("l_suppkey") * (5 + k) + F.col("l_linenumber") * (k + 1)) % SPARSE.get(c, 2) == 0).alias(c)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(bit(k, c) for k, c in enumerate(SIGN_BITS)))
    return linking.implementation_scores(rows)


@query("g_impl_score", SCORED + "select l_orderkey, l_linenumber, score, has_ownership, accepted from f")
def g_impl_score(spark, sf_dir):
    return _candidates(spark, sf_dir).select("l_orderkey", "l_linenumber", "score", "has_ownership", "accepted")


@query("g_impl_decision", SCORED + """, d as (select l_orderkey, count(*) candidates, count(*) filter (accepted) accepted, coalesce(max(score) filter (accepted), 0) top_score from f group by 1),
w as (select d.*, (select count(*) from f where f.l_orderkey = d.l_orderkey and f.accepted and f.score = d.top_score) winners from d)
select *, case when winners = 1 then 'resolved' when winners > 1 then 'ambiguous' else 'unresolved' end status from w""")
def g_impl_decision(spark, sf_dir):
    return linking.implementation_decisions(_candidates(spark, sf_dir), "l_orderkey")


TREE = """lines as (select user_id, event_id pos, case event_id % 9 when 0 then '# branch.head topic-' || user_id when 1 then case when user_id % 4 = 0 then '# no' else '# branch.upstream o/m' end when 2 then '# branch.ab +' || (user_id % 3) || ' -' || (user_id % 2) when 3 then '1 .M N... a' when 4 then case when user_id % 5 = 0 then '2 R. N... b' else '! x' end when 5 then '? new' end line from events)"""


@query("status_porcelain", f"""with {TREE}, s as (select user_id, coalesce(arg_max(substring(line, 15), pos) filter (starts_with(line, '# branch.head ')), 'HEAD') branch, coalesce(bool_or(starts_with(line, '# branch.upstream ')), false) followed,
  coalesce(arg_max(regexp_extract(line, '\\+(\\d+) -(\\d+)', 1), pos) filter (starts_with(line, '# branch.ab ')), '0')::int ahead, coalesce(arg_max(regexp_extract(line, '\\+(\\d+) -(\\d+)', 2), pos) filter (starts_with(line, '# branch.ab ')), '0')::int behind,
  coalesce(bool_or(regexp_matches(line, '^[12] [^.?]')), false) staged, coalesce(bool_or(regexp_matches(line, '^[12] .[^.?]')), false) unstaged, coalesce(bool_or(starts_with(line, '? ')), false) untracked from lines group by 1)
select user_id, branch, case when not followed then 'no_remote' when ahead > 0 and behind > 0 then 'diverged' when ahead > 0 then 'ahead' when behind > 0 then 'behind' else 'in_sync' end branch_status, staged, unstaged, untracked, ahead, behind from s""")
def status_porcelain(spark, sf_dir):
    u, kind = F.col("user_id"), F.col("event_id") % 9
    line = (
        F.when(kind == 0, F.concat(F.lit("# branch.head topic-"), u)).when(kind == 1, F.when(u % 4 == 0, "# no").otherwise("# branch.upstream o/m"))
        .when(kind == 2, F.concat(F.lit("# branch.ab +"), u % 3, F.lit(" -"), u % 2)).when(kind == 3, "1 .M N... a")
        .when(kind == 4, F.when(u % 5 == 0, "2 R. N... b").otherwise("! x")).when(kind == 5, "? new")
    )
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), line.alias("line"))
    return linking.work_tree_states(rows, "user_id")
