"""Queries that rank candidates, page results and expand definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import paging
from tidewater.plans.log_queries import LOG, log_rows
from tidewater.plans.registry import query
from tidewater.session import Scratch, table


def t(spark, sf_dir, *names):
    found = [table(spark, sf_dir, n) for n in names]
    return found[0] if len(found) == 1 else found


def suggest_score(name: Column, asked: Column) -> Column:
    """100 for the same letters and digits, 92 for a plural, 80 and 70 less the extra length for a start and an end, else by edit distance; null below 45."""
    norm = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    a, b = norm(name), norm(asked)
    extra = F.abs(F.length(a) - F.length(b))
    most = F.greatest(F.length(a), F.length(b))
    edits = F.levenshtein(a, b)
    near = F.when(edits <= F.greatest(F.lit(3), F.floor(most * 0.35)), F.round(75 * (1 - edits / most)))
    score = (
        F.when(a == b, 100).when(F.regexp_replace(a, "S$", "") == F.regexp_replace(b, "S$", ""), 92)
        .when(F.startswith(a, b) | F.startswith(b, a), 80 - extra).when(F.endswith(a, b) | F.endswith(b, a), 70 - extra).otherwise(near)
    ).cast("long")
    return F.when(score >= 45, score)


@query("fn_suggest_score", """with n as (select n_name, regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g') a, 'NATION1S' b from nation),
s as (select n_name, case when a = b then 100 when regexp_replace(a, 'S$', '') = regexp_replace(b, 'S$', '') then 92 when starts_with(a, b) or starts_with(b, a) then 80 - abs(length(a) - length(b)) when ends_with(a, b) or ends_with(b, a) then 70 - abs(length(a) - length(b))
 when levenshtein(a, b) <= greatest(3, floor(greatest(length(a), length(b)) * 0.35)) then round(75 * (1 - levenshtein(a, b) / greatest(length(a), length(b)))) end::bigint score from n)
select n_name, score from s where score >= 45""")
def fn_suggest_score(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_name", suggest_score(F.col("n_name"), F.lit("Nation-1s")).alias("score")).where("score is not null")


@query("w_infer_margin", """with r as (select o_custkey, o_orderkey, o_totalprice / max(o_totalprice) over (partition by o_custkey) - 0.1 * (o_orderkey % 2) score from orders),
k as (select *, lead(score) over w nxt, row_number() over w k from r window w as (partition by o_custkey order by score desc, o_orderkey))
select o_custkey, case when score >= 0.85 and (nxt is null or score - nxt > 0.05) then o_orderkey end chosen from k where k = 1""")
def w_infer_margin(spark, sf_dir):
    score = F.col("o_totalprice") / F.max("o_totalprice").over(Window.partitionBy("o_custkey")) - 0.1 * (F.col("o_orderkey") % 2)
    rows = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", score.alias("score"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("score"), "o_orderkey")
    top = rows.withColumn("nxt", F.lead("score").over(w)).withColumn("k", F.row_number().over(w)).where("k = 1")
    sure = (F.col("score") >= 0.85) & (F.col("nxt").isNull() | (F.col("score") - F.col("nxt") > 0.05))
    return top.select("o_custkey", F.when(sure, F.col("o_orderkey")).alias("chosen"))


@query("s_newest_event", "select event_id, ts from events order by ts desc, event_id desc limit 100")
def s_newest_event(spark, sf_dir):
    return t(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "ts").limit(100)


@query("l_probe", "select count(*) > 50 more from (select 1 from events where event_type = 'error' limit 51)")
def l_probe(spark, sf_dir):
    return t(spark, sf_dir, "events").where("event_type = 'error'").limit(51).agg((F.count("*") > 50).alias("more"))


@query("l_page_budget", """with recursive e as (select 'run-' || user_id % 7 run, event_id * 2 seq, event_id % 11 = 0 wide, case when user_id % 7 = 6 then 90 when user_id % 7 = 3 and event_id % 97 = 5 then 3000 else 80 + event_id * 7919 % 60 end compact,
  case when user_id % 7 = 6 then 0 else event_id % 5 * 20 end more from events),
p as (select *, row_number() over w - 1 i, count(*) over (partition by run) c, lag(seq) over w last, sum(compact) over w pc, sum(compact + more) over w pp, sum(compact + more + case when wide then 400 else 0 end) over w pf from e window w as (partition by run order by seq)),
k as (select a.run, a.i, a.c, coalesce(a.last + 1, 0) from_seq, a.c - a.i left_, b.i - a.i + 1 k, b.seq + 1 as following, b.pc - a.pc + a.compact sc, b.pp - a.pp + a.compact + a.more sp, b.pf - a.pf + a.compact + a.more + case when a.wide then 400 else 0 end sf
  from p a join p b on a.run = b.run and b.i between a.i and a.i + 19
  union all select run, i, c, coalesce(last + 1, 0), c - i, 0, null, 0, 0, 0 from p),
z as (select *, length('{"runId":"' || run || '","total":' || c || ',"matching":' || left_ || ',"shown":' || k || ',"returned":' || k || ',"from":' || from_seq || ',"hasMore":' || (k < left_) || case when k > 0 and k < left_ then ',"nextSeq":' || following else '' end || ',"events":[]}') + 1 + greatest(k - 1, 0) env, k = least(left_, 20) whole from k),
f as (select run, i, c, from_seq, left_, k, following, unnest(case when whole then [{'r': 1, 'form': 'full', 'b': sf + env}, {'r': 2, 'form': 'capped', 'b': sp + env}, {'r': 3, 'form': 'compact', 'b': sc + env}] when k > 0 then [{'r': 4, 'form': 'shrunk', 'b': sc + env}] else [{'r': 5, 'form': case when env <= 2400 then 'summary' else 'too_small' end, 'b': env}] end) t from z),
b as (select * from f where t.b <= 2400 or k = 0 qualify row_number() over (partition by run, i order by t.r, k desc) = 1),
r as (select b.* from b where i = 0 union all select b.* from r join b on b.run = r.run and b.i = r.i + r.k where r.k > 0)
select run, from_seq, c total, left_ matching, k shown, t.form form, t.b::bigint bytes, k < left_ has_more, case when k > 0 and k < left_ then following end next_seq from r""")
def l_page_budget(spark, sf_dir):
    """All pages of runs of events of 20 events and 2,400 bytes at most."""
    i, u = F.col("event_id"), F.col("user_id") % 7
    compact = F.when(u == 6, F.lit(90)).when((u == 3) & (i % 97 == 5), F.lit(3000)).otherwise(i * 7919 % 60 + 80)
    capped = F.col("compact") + F.when(F.col("u") == 6, 0).otherwise(i % 5 * 20)
    rows = t(spark, sf_dir, "events").select(i, u.alias("u"), compact.alias("compact")).withColumn("capped", capped)
    rows = rows.select(F.concat(F.lit("run-"), "u").alias("run"), (i * 2).alias("seq"), (F.col("capped") + F.when(i % 11 == 0, 400).otherwise(0)).alias("full"), "capped", "compact")
    return paging.pages(rows, Scratch(spark, "paging"), limit=20, budget=2400)


@query("fn_offset_fix", LOG + "select id, '10:00+0' || (id % 10) || ':30' fixed from log")
def fn_offset_fix(spark, sf_dir):
    raw = F.concat(F.lit("10:00+0"), F.col("id") % 10, F.lit("30"))
    return log_rows(spark, sf_dir).select("id", F.regexp_replace(raw, r"([+-]\d{2})(\d{2})$", "$1:$2").alias("fixed"))


@query("fn_hours", "select o_orderkey, round(cast(floor(o_totalprice / 1000) as bigint) / 60.0, 2)::double as hours from orders")
def fn_hours(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", F.round(F.floor(F.col("o_totalprice") / 1000) / 60, 2).cast("double").alias("hours"))


@query("g_expand", "select r_name, n_name, s_name, case when s_name is null then 'missing' else 'ok' end label from region join nation on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey")
def g_expand(spark, sf_dir):
    r, n, s = t(spark, sf_dir, "region", "nation", "supplier")
    found = r.join(n, r.r_regionkey == n.n_regionkey).join(s, n.n_nationkey == s.s_nationkey, "left")
    return found.select("r_name", "n_name", "s_name", F.when(F.col("s_name").isNull(), "missing").otherwise("ok").alias("label"))


@query("g_sub_handler_names", """select c_custkey, case when c_custkey % 7 = 0 then 'no handler name' when n is null then 'no symbol' when n > 1 then 'several symbols' else 'resolved' end verdict
from customer left join (select s_nationkey, count(*) n from supplier group by 1) on s_nationkey = c_nationkey""")
def g_sub_handler_names(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer", "supplier")
    symbols = s.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n"))
    n = F.col("n")
    verdict = F.when(F.col("c_custkey") % 7 == 0, "no handler name").when(n.isNull(), "no symbol").when(n > 1, "several symbols").otherwise("resolved")
    return c.join(symbols, "c_nationkey", "left").select("c_custkey", verdict.alias("verdict"))


@query("g_shape_candidate", """with p as (select p_partkey, split_part(p_name, ' ', 1) sig from part), c as (select sig, count(*) filter (p_partkey % 2 = 0) pubs, count(*) filter (p_partkey % 2 = 1) subs from p group by 1)
select sig, pubs * subs pairs, case when subs > 100 then 'refused' else 'candidate' end verdict, 0.3::double confidence from c where pubs > 0 and subs > 0""")
def g_shape_candidate(spark, sf_dir):
    k = F.col("p_partkey") % 2
    counts = t(spark, sf_dir, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("sig")).agg(F.count_if(k == 0).alias("pubs"), F.count_if(k == 1).alias("subs"))
    return counts.where("pubs > 0 and subs > 0").select("sig", (F.col("pubs") * F.col("subs")).alias("pairs"), F.when(F.col("subs") > 100, "refused").otherwise("candidate").alias("verdict"), F.lit(0.3).alias("confidence"))


@query("g_selector", "select 'nation' kind, n_nationkey::bigint id from nation where n_name = 'NATION_7' union all select 'supplier', s_suppkey from supplier join nation on s_nationkey = n_nationkey where n_name = 'NATION_7'")
def g_selector(spark, sf_dir):
    n, s = t(spark, sf_dir, "nation", "supplier")
    found = n.where("n_name = 'NATION_7'")
    a = found.select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"))
    return a.union(s.join(found, s.s_nationkey == found.n_nationkey).select(F.lit("supplier"), "s_suppkey"))
