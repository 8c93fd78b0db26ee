"""Queries over service facts, traces and timelines on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import text
from tidewater.operators.ranking import first_few, sole_least
from tidewater.plans.log_queries import LOG, log_rows
from tidewater.plans.registry import query
from tidewater.session import table


def t(spark, sf_dir, *names):
    found = [table(spark, sf_dir, n) for n in names]
    return found[0] if len(found) == 1 else found


@query("f_source", LOG + "select id from log where contains(lower(source), 'proc')")
def f_source(spark, sf_dir):
    return log_rows(spark, sf_dir).where(F.contains(F.lower("source"), F.lit("proc"))).select("id")


@query("f_tenant", LOG + "select id from log where tenant = 'tenant-3' and stream = 'ERR'")
def f_tenant(spark, sf_dir):
    return log_rows(spark, sf_dir).where("tenant = 'tenant-3' and stream = 'ERR'").select("id")


@query("f_apps_in", LOG + "select app, count(*) n from log where app in (select 'app-' || n_regionkey from nation where n_name like '%2') group by 1")
def f_apps_in(spark, sf_dir):
    apps = t(spark, sf_dir, "nation").where("n_name like '%2'").select(F.concat(F.lit("app-"), "n_regionkey").alias("app")).distinct()
    return log_rows(spark, sf_dir).join(F.broadcast(apps), "app", "left_semi").groupBy("app").agg(F.count("*").alias("n"))


@query("f_include_kind", "select event_type, count(*) n from events where event_type in ('view') or (true and event_type = 'click') or (false and event_type = 'error') group by 1")
def f_include_kind(spark, sf_dir):
    kinds = {"click": True, "error": False}
    wanted = ["view", *(k for k, on in kinds.items() if on)]
    return t(spark, sf_dir, "events").where(F.col("event_type").isin(wanted)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("raw_rebuild", LOG + "select id, strftime(ts, '%H:%M:%S') || ' [' || source || '] ' || stream || ' ' || message line from log")
def raw_rebuild(spark, sf_dir):
    return log_rows(spark, sf_dir).select("id", F.format_string("%s [%s] %s %s", F.date_format("ts", "HH:mm:ss"), "source", "stream", "message").alias("line"))


@query("json_request_id", "select event_id, coalesce(nullif(json_extract_string(props, '$.id'), ''), nullif(json_extract_string(props, '$.k'), '')) request_id from events")
def json_request_id(spark, sf_dir):
    first = F.coalesce(*(F.nullif(text.json_at(F.col("props"), p), F.lit("")) for p in ("/id", "/request", "/k")))
    return t(spark, sf_dir, "events").select("event_id", first.alias("request_id"))


@query("crash_record", "select event_id, coalesce(json_extract_string(props, '$.reason'), json_extract_string(props, '$.k')) reason, cast(null as bigint) exit_status from events where event_type = 'error'")
def crash_record(spark, sf_dir):
    p = F.col("props")
    rows = t(spark, sf_dir, "events").where("event_type = 'error'")
    return rows.select("event_id", F.coalesce(text.json_at(p, "/reason"), text.json_at(p, "/k")).alias("reason"), text.json_at(p, "/exit_status").try_cast("long").alias("exit_status"))


@query("trace_event_parse", "select page_id, upper(case when page_id % 2 = 0 then 'get' else 'Post' end) as method, greatest(page_id - 100, 0) bytes from pages where url is not null and url <> ''")
def trace_event_parse(spark, sf_dir):
    i = F.col("page_id")
    rows = t(spark, sf_dir, "pages").where("url is not null and url <> ''")
    return rows.select(i, F.upper(F.when(i % 2 == 0, "get").otherwise("Post")).alias("method"), F.greatest(i - 100, F.lit(0)).alias("bytes"))


@query("body_format", """select page_id, case when b = '' then 'empty' when b like '{%' then 'json' when lower(b) like '<!doctype html%' then 'html' when b like '<%' then 'xml' when regexp_matches(b, '^[^=&\\s]+=[^&\\s]*(&|$)') then 'form' else 'text' end format
from (select page_id, case page_id % 6 when 0 then '' when 1 then '{"a":1}' when 2 then html when 3 then '<x/>' when 4 then 'a=1&b=2' else 'plain words' end b from pages)""")
def body_format(spark, sf_dir):
    i = F.col("page_id") % 6
    b = F.when(i == 0, "").when(i == 1, '{"a":1}').when(i == 2, F.col("html")).when(i == 3, "<x/>").when(i == 4, "a=1&b=2").otherwise("plain words")
    c = F.col("b")
    kind = (
        F.when(c == "", "empty").when(F.startswith(c, F.lit("{")) & F.try_parse_json(c).isNotNull(), "json").when(F.startswith(F.lower(c), F.lit("<!doctype html")), "html")
        .when(F.startswith(c, F.lit("<")), "xml").when(c.rlike(r"^[^=&\s]+=[^&\s]*(&|$)"), "form").otherwise("text"))
    return t(spark, sf_dir, "pages").select("page_id", b.alias("b")).select("page_id", kind.alias("format"))


@query("header_ci", "select page_id, 'text/' || page_id % 3 content_type from pages")
def header_ci(spark, sf_dir):
    headers = F.create_map(F.lit("Content-TYPE"), F.concat(F.lit("text/"), F.col("page_id") % 3), F.lit("X-Other"), F.lit("1"))
    return t(spark, sf_dir, "pages").select("page_id", F.transform_keys(headers, lambda k, v: F.lower(k)).alias("h")).select("page_id", F.col("h")["content-type"].alias("content_type"))


@query("src_app_table", "select c_custkey, 'app' || c_custkey as name, (c_custkey % 3 + c_custkey % 2)::bigint running from customer")
def src_app_table(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.concat(F.lit("app"), k, F.lit("   started   web:"), k % 3, F.lit("/4, task:"), k % 2, F.lit("/1   route.example"))
    cells = F.split("line", r"\s{2,}")
    counts = F.regexp_extract_all(F.get(cells, F.lit(2)), F.lit(r"(\d+)/\d+"), F.lit(1))
    rows = t(spark, sf_dir, "customer").select(k, line.alias("line"))
    return rows.select("c_custkey", F.get(cells, F.lit(0)).alias("name"), F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("running"))


@query("src_json_rows", "select n_nationkey, n_name as name, case when n_nationkey % 2 = 0 then n_name else '' end alias from nation")
def src_json_rows(spark, sf_dir):
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_name").alias("alias")))).otherwise(F.to_json(F.struct(F.col("n_name").alias("name"))))
    rows = t(spark, sf_dir, "nation").select("n_nationkey", F.from_json(raw, "name string, alias string").alias("r"))
    return rows.select("n_nationkey", "r.name", F.coalesce("r.alias", F.lit("")).alias("alias"))


@query("template_scan", r"select p_partkey, regexp_extract_all(p_name || '/${key' || (p_partkey % 3) || '}/${x}', '\$\{([^{}]+)\}', 1)[1] first_key from part")
def template_scan(spark, sf_dir):
    made = F.concat("p_name", F.lit("/${key"), F.col("p_partkey") % 3, F.lit("}/${x}"))
    return t(spark, sf_dir, "part").select("p_partkey", F.get(F.regexp_extract_all(made, F.lit(r"\$\{([^{}]+)\}"), F.lit(1)), F.lit(0)).alias("first_key"))


@query("event_skeleton", "select p_partkey, sha256(regexp_replace(p_name || '-' || p_partkey, '[0-9]+', '{}', 'g')) signature from part")
def event_skeleton(spark, sf_dir):
    shape = F.regexp_replace(F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")), r"[0-9]+", "{}")
    return t(spark, sf_dir, "part").select("p_partkey", F.sha2(shape, 256).alias("signature"))


@query("j_signature", "with s as (select p_partkey k, regexp_replace(p_name, '[0-9]+', '#', 'g') sig, p_brand b from part) select b, count(*) pairs from s group by b, sig having count(*) > 1 and false union all select x.b, count(*) from s x join s y on x.sig = y.sig and x.b = y.b and x.k < y.k group by x.b")
def j_signature(spark, sf_dir):
    s = t(spark, sf_dir, "part").select(F.regexp_replace("p_name", "[0-9]+", "#").alias("sig"), F.col("p_brand").alias("b"))
    n = F.col("n")
    return s.groupBy("b", "sig").agg(F.count("*").alias("n")).groupBy("b").agg(F.sum((n * (n - 1) / 2).cast("long")).alias("pairs")).where("pairs > 0")


@query("j_event_artifact", "select coalesce(a.o_orderkey, b.l_orderkey) k, case when a.o_orderkey is null then 'no event' when b.l_orderkey is null then 'no artifact' else 'both' end status from (select o_orderkey from orders where o_orderkey % 3 <> 0) a full join (select distinct l_orderkey from lineitem where l_orderkey % 5 <> 0) b on a.o_orderkey = b.l_orderkey")
def j_event_artifact(spark, sf_dir):
    o, l = t(spark, sf_dir, "orders", "lineitem")
    a = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.lit(True).alias("a"))
    b = l.where("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("k")).distinct().withColumn("b", F.lit(True))
    return a.join(b, "k", "full").select("k", F.when(F.col("a").isNull(), "no event").when(F.col("b").isNull(), "no artifact").otherwise("both").alias("status"))


@query("j_lateral_json", "select o_orderkey, unnest(['a', o_orderstatus, o_orderpriority]) item from orders")
def j_lateral_json(spark, sf_dir):
    doc = F.to_json(F.array(F.lit("a"), "o_orderstatus", "o_orderpriority"))
    return t(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.from_json(doc, "array<string>")).alias("item"))


@query("j_merge_exists", "select c_custkey, c_acctbal from customer where exists (select 1 from supplier where s_nationkey = c_nationkey and s_acctbal > c_acctbal)")
def j_merge_exists(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer", "supplier")
    best = s.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("most"))
    return c.join(best, "c_nationkey").where("most > c_acctbal").select("c_custkey", "c_acctbal")


@query("a_status_counts", "select event_type, count(*) filter (event_id % 4 = 0) resolved, count(*) filter (event_id % 4 = 1) ambiguous, count(*) filter (event_id % 4 > 1) unresolved from events group by 1")
def a_status_counts(spark, sf_dir):
    k = F.col("event_id") % 4
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(k == 0).alias("resolved"), F.count_if(k == 1).alias("ambiguous"), F.count_if(k > 1).alias("unresolved"))


@query("a_reason_buckets", "with c as (select p_type reason, count(*) n from part group by 1), r as (select *, row_number() over (order by n desc, reason) k from c) select reason, n from r where k <= 16 union all select '(omitted)', count(*) from r where k > 16")
def a_reason_buckets(spark, sf_dir):
    counts = t(spark, sf_dir, "part").groupBy(F.col("p_type").alias("reason")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "reason").limit(16)
    return top.unionByName(counts.agg(F.greatest(F.count("*") - 16, F.lit(0)).alias("n")).select(F.lit("(omitted)").alias("reason"), "n"))


@query("a_edge_aggregate", "select o_custkey src, o_orderstatus dst, count(*) n, min(o_orderkey) first_at, array_to_string(list_sort(list(distinct o_orderpriority)), ',') reasons from orders group by 1, 2")
def a_edge_aggregate(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("dst")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_at"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("reasons"))


@query("a_tree_rollup", "with f as (select r_name || '/' || n_name || '/' || c_custkey p, c_custkey size from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey), d as (select split_part(p, '/', 1) folder, size from f union all select split_part(p, '/', 1) || '/' || split_part(p, '/', 2), size from f) select folder, count(*) files, sum(size)::bigint bytes from d group by 1")
def a_tree_rollup(spark, sf_dir):
    c, n, r = t(spark, sf_dir, "customer", "nation", "region")
    f = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.concat_ws("/", "r_name", "n_name", F.col("c_custkey").cast("string")).alias("p"), F.col("c_custkey").alias("size"))
    parts = F.split("p", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return f.select(F.explode(above).alias("folder"), "size").groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("w_owner_select", "with r as (select l_orderkey, l_linenumber, rank() over (partition by l_orderkey order by l_quantity) k from lineitem), b as (select l_orderkey, count(*) n, min(l_linenumber) line from r where k = 1 group by 1) select l_orderkey, case when n = 1 then line end as owner, n > 1 ambiguous from b")
def w_owner_select(spark, sf_dir):
    return sole_least(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_linenumber", "owner", "ambiguous")


@query("w_first_last", LOG + "select app, arg_min(message, (ts, id)) first_message, arg_max(message, (ts, id)) last_message from log group by app")
def w_first_last(spark, sf_dir):
    order = F.struct("ts", "id")
    return log_rows(spark, sf_dir).groupBy("app").agg(F.min_by("message", order).alias("first_message"), F.max_by("message", order).alias("last_message"))


@query("s_tail_order", LOG + "select app, id, row_number() over (partition by app order by case when id % 9 = 0 then null else ts end nulls last, id)::int place from log")
def s_tail_order(spark, sf_dir):
    w = Window.partitionBy("app").orderBy(F.col("at").asc_nulls_last(), "id")
    rows = log_rows(spark, sf_dir).withColumn("at", F.when(F.col("id") % 9 != 0, F.col("ts")))
    return rows.select("app", "id", F.row_number().over(w).alias("place"))


@query("l_bounded", "select o_custkey, count(*) total, least(count(*), 5) shown, greatest(count(*) - 5, 0) omitted from orders group by 1")
def l_bounded(spark, sf_dir):
    n = F.count("*")
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(n.alias("total"), F.least(n, F.lit(5)).alias("shown"), F.greatest(n - 5, F.lit(0)).alias("omitted"))


@query("u_region_merge", "select coalesce(n.k, o.k) k, coalesce(n.v, o.v) v, o.k is null is_new from (select n_nationkey k, n_name v from nation where n_nationkey < 20) o full join (select n_nationkey k, lower(n_name) v from nation where n_nationkey % 2 = 0) n using (k)")
def u_region_merge(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    old = n.where("k < 20").withColumn("old", F.lit(True))
    new = n.where("k % 2 = 0").select("k", F.lower("v").alias("w"))
    return old.join(new, "k", "full").select("k", F.coalesce("w", "v").alias("v"), F.col("old").isNull().alias("is_new"))


@query("fn_text_search", "select doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 hits, instr(text, 'the')::int as first_at from documents where contains(text, 'the')")
def fn_text_search(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").where(F.contains("text", F.lit("the")))
    return rows.select("doc_id", (F.size(F.split("text", "the", -1)) - 1).cast("long").alias("hits"), F.instr("text", "the").alias("first_at"))


@query("fn_json_len", "select o_orderkey, 3::int n, 'array' kind from orders")
def fn_json_len(spark, sf_dir):
    doc = F.to_json(F.array(F.lit("a"), "o_orderstatus", "o_orderpriority"))
    return t(spark, sf_dir, "orders").select("o_orderkey", F.json_array_length(doc).alias("n"), F.when(F.startswith(F.schema_of_variant(F.try_parse_json(doc)), F.lit("ARRAY")), "array").otherwise("other").alias("kind"))


@query("fn_context_hash", "select n_nationkey, sha256('{\"k\":\"' || n_regionkey || '\",\"name\":\"' || n_name || '\"}') h from nation")
def fn_context_hash(spark, sf_dir):
    entries = F.array_sort(F.array(F.struct(F.lit("name").alias("key"), F.col("n_name").alias("value")), F.struct(F.lit("k").alias("key"), F.col("n_regionkey").cast("string").alias("value"))))
    return t(spark, sf_dir, "nation").select("n_nationkey", F.sha2(F.to_json(F.map_from_entries(entries)), 256).alias("h"))


@query("g_stale", "select n_regionkey, max(n_nationkey) + 1 generation, bool_or(n_nationkey > 20) stale from nation group by 1")
def g_stale(spark, sf_dir):
    return t(spark, sf_dir, "nation").groupBy("n_regionkey").agg((F.max("n_nationkey") + 1).alias("generation"), F.bool_or(F.col("n_nationkey") > 20).alias("stale"))


@query("g_invalidate", "select distinct l_orderkey from lineitem where l_partkey in (select p_partkey from part where p_brand = 'Brand#13')")
def g_invalidate(spark, sf_dir):
    l, p = t(spark, sf_dir, "lineitem", "part")
    changed = p.where("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("l_partkey"))
    return l.join(changed, "l_partkey", "left_semi").select("l_orderkey").distinct()


@query("g_hint", "select c_custkey, case when n is null then 'automatic' when n = 1 then 'hinted' else 'tied' end verdict from customer left join (select o_custkey, count(*) n from orders where o_orderpriority = '1-URGENT' group by 1) on c_custkey = o_custkey")
def g_hint(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    hints = o.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return c.join(hints, "c_custkey", "left").select("c_custkey", F.when(F.col("n").isNull(), "automatic").when(F.col("n") == 1, "hinted").otherwise("tied").alias("verdict"))


@query("gq_local_calls_types", "select count(*) filter (event_type = 'view') resolved, count(*) filter (event_type = 'click' and user_id % 2 = 0) unowned, count(*) filter (event_type = 'error') unresolved from events")
def gq_local_calls_types(spark, sf_dir):
    kind = F.col("event_type")
    return t(spark, sf_dir, "events").agg(F.count_if(kind == "view").alias("resolved"), F.count_if((kind == "click") & (F.col("user_id") % 2 == 0)).alias("unowned"), F.count_if(kind == "error").alias("unresolved"))


@query("gq_json_types", "select event_type, count(*) filter (props is null) missing, count(*) filter (not json_valid(props)) invalid, count(*) filter (json_type(props) <> 'OBJECT') not_object from events group by 1")
def gq_json_types(spark, sf_dir):
    p, v = F.col("props"), F.try_parse_json("props")
    return t(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_if(p.isNull()).alias("missing"), F.count_if(p.isNotNull() & v.isNull()).alias("invalid"), F.count_if(v.isNotNull() & ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))).alias("not_object"))


@query("gq_no_impl", "select s_nationkey, count(*) calls, array_to_string(list_sort(list(s_suppkey))[1:3], ',') examples from supplier where not exists (select 1 from customer where c_nationkey = s_nationkey and c_mktsegment = 'BUILDING' and c_acctbal > 9000) group by 1")
def gq_no_impl(spark, sf_dir):
    s, c = t(spark, sf_dir, "supplier", "customer")
    rows = s.join(c.where("c_mktsegment = 'BUILDING' and c_acctbal > 9000"), s.s_nationkey == c.c_nationkey, "left_anti")
    return first_few(rows, "s_nationkey", "s_suppkey", 3, "calls", "examples")
