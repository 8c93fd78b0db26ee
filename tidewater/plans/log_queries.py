"""Queries over log rows. `events` stands in for a log: one line per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import logs, traces
from tidewater.plans.registry import query
from tidewater.session import Scratch, table

RAW = """select event_id id, ts, 'app-' || (user_id % 5) app, 'tenant-' || (user_id % 20) tenant, cast(200 + 100 * (event_id % 4) as int) status, event_type,
  case when event_id % 3 = 0 then 'RTR/0' when event_id % 3 = 1 then 'APP/PROC/WEB/' || (event_id % 2) else 'STG' end source,
  case when event_type = 'error' then 'ERR' else 'OUT' end stream,
  case event_type when 'error' then 'error' when 'purchase' then 'warn' when 'signup' then 'info' when 'view' then 'debug' else 'trace' end level,
  case event_type when 'error' then 'Request failed for user ' when 'purchase' then 'warning: slow purchase by ' when 'signup' then 'new  user ' else 'saw ' end || user_id message
  from events"""
LOG = f"with log as ({RAW}) "
STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+0700'"
LINES = f"with log as ({RAW}), raw as (select *, {STAMP} || ' [' || source || '] ' || stream || ' ' || message line from log) "
ROUTER = """r as (select id, 'host-' || (id % 7) || '.example - [x] "GET /odata/v' || (id % 3) || '/Items%20' || (id % 5) || '?a=1+2 HTTP/1.1" ' || status || ' 0 response_time:' || (id % 2500) / 1000.0 || ' x' body from log)"""


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, i, u = F.col("event_type"), F.col("event_id"), F.col("user_id")
    text = lambda s: F.lit(s)
    return table(spark, sf_dir, "events").select(
        i.alias("id"), "ts", F.concat(text("app-"), u % 5).alias("app"), F.concat(text("tenant-"), u % 20).alias("tenant"), (200 + 100 * (i % 4)).cast("int").alias("status"), t.alias("event_type"),
        F.when(i % 3 == 0, "RTR/0").when(i % 3 == 1, F.concat(text("APP/PROC/WEB/"), i % 2)).otherwise("STG").alias("source"),
        F.when(t == "error", "ERR").otherwise("OUT").alias("stream"),
        F.when(t == "error", "error").when(t == "purchase", "warn").when(t == "signup", "info").when(t == "view", "debug").otherwise("trace").alias("level"),
        F.concat(F.when(t == "error", "Request failed for user ").when(t == "purchase", "warning: slow purchase by ").when(t == "signup", "new  user ").otherwise("saw "), u).alias("message"),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+0700"))
    return log_rows(spark, sf_dir).withColumn("line", F.concat(stamp, F.lit(" ["), "source", F.lit("] "), "stream", F.lit(" "), "message"))


def router_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    latency = ((i % 2500) / 1000.0).cast("double")
    return log_rows(spark, sf_dir).select("id", F.concat(
        F.lit("host-"), i % 7, F.lit('.example - [x] "GET /odata/v'), i % 3, F.lit("/Items%20"), i % 5, F.lit('?a=1+2 HTTP/1.1" '), "status", F.lit(" 0 response_time:"), latency.cast("string"), F.lit(" x")).alias("body"))


@query("parse_line", LINES + "select id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+0700' timestamp_raw, source, stream, message body from raw")
def parse_line(spark, sf_dir):
    return raw_lines(spark, sf_dir).select("id", *logs.parse_line(F.col("line")))


@query("parse_continuation", LINES + """, parts as (select app, id * 2 pos, line from raw union all select app, id * 2 + 1, '  at ' || id from raw where event_type = 'error'),
n as (select *, max(case when ltrim(line) like '20%' then pos end) over (partition by app order by pos) entry from parts)
select app, entry, string_agg(line, chr(10) order by pos) text, count(*) n_lines from n group by app, entry""")
def parse_continuation(spark, sf_dir):
    raw = raw_lines(spark, sf_dir)
    more = raw.where("event_type = 'error'").select("app", (F.col("id") * 2 + 1).alias("pos"), F.concat(F.lit("  at "), "id").alias("line"))
    joined = logs.join_continuations(raw.select("app", (F.col("id") * 2).alias("pos"), "line").union(more), "app", Scratch(spark, "continuation"))
    return joined.withColumnRenamed("at", "entry")


@query("drop_system", LINES + "select id, line from (select id, case when id % 10 = 0 then 'Retrieving logs for app x' when id % 10 = 1 then '  ' else line end line from raw) where not (trim(line) = '' or trim(line) like 'Retrieving logs for app%')")
def drop_system(spark, sf_dir):
    rows = raw_lines(spark, sf_dir).select("id", F.when(F.col("id") % 10 == 0, "Retrieving logs for app x").when(F.col("id") % 10 == 1, "  ").otherwise(F.col("line")).alias("line"))
    return rows.where(~logs.is_system(F.col("line")))


@query("level_norm", LOG + """select id, case when id % 4 = 0 then level when source like 'RTR%' then case when status >= 500 then 'error' when status >= 400 then 'warn' else 'info' end
 when message like '%failed%' then 'error' when message like '%warning%' then 'warn' when stream = 'ERR' then 'error' else 'info' end level from log""")
def level_norm(spark, sf_dir):
    said = F.when(F.col("id") % 4 == 0, F.when(F.col("level") == "warn", " WARNING").otherwise(F.upper("level")))
    return log_rows(spark, sf_dir).select("id", logs.level(said, F.col("status"), F.col("message"), F.col("stream"), F.col("source")).alias("level"))


@query("level_router", LOG + "select status, case when status >= 500 then 'error' when status >= 400 then 'warn' else 'info' end level, count(*) n from log group by all")
def level_router(spark, sf_dir):
    return log_rows(spark, sf_dir).groupBy("status", logs.router_level(F.col("status")).alias("level")).agg(F.count("*").alias("n"))


ACCESS = """a as (select event_id id, case when event_id % 9 = 0 then '-' else 'h' || (event_id % 7) || '.example' end host, case when event_id % 4 = 0 then 'POST' else 'GET' end verb,
  case event_id % 5 when 0 then '/a%20b/' || event_id when 1 then '/bad%E9/' || event_id when 2 then '/p/' || repeat('x', 150) when 3 then '/q?x=%2F1+2' else '/%zz?y=%41' end target,
  case event_id % 5 when 0 then '/a b/' || event_id when 1 then '/bad%E9/' || event_id when 2 then '/p/' || repeat('x', 150) when 3 then '/q?x=/1+2' else '/%zz?y=A' end shown,
  case when event_id % 11 = 0 then '-' else cast(200 + 100 * (event_id % 4) as varchar) end code, case when event_id % 6 = 0 then '-' else cast((event_id % 2500) / 1000.0 as varchar) end secs,
  case when event_id % 3 = 0 then '-' else 't' || user_id % 20 end ten, case event_id % 4 when 0 then '1.1.1.1' when 1 then '-' else '' end ip1, case when event_id % 3 = 1 then '2.2.2.2' else '-' end ip2,
  case when event_id % 2 = 0 then ' 3.3.3.3, 4.4.4.4' else '-' end ip3, case when event_id % 5 = 2 then 'c' || event_id else '-' end rid1, case when event_id % 7 > 2 then 'v' || event_id else '' end rid2 from events)"""


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router access lines with '-' for what is unknown, targets that can't be decoded and very long ones."""
    i, u, say = F.col("event_id"), F.col("user_id"), lambda s: F.lit(s)
    host = F.when(i % 9 == 0, "-").otherwise(F.concat(say("h"), i % 7, say(".example")))
    target = F.when(i % 5 == 0, F.concat(say("/a%20b/"), i)).when(i % 5 == 1, F.concat(say("/bad%E9/"), i)).when(i % 5 == 2, "/p/" + "x" * 150).when(i % 5 == 3, "/q?x=%2F1+2").otherwise("/%zz?y=%41")
    code = F.when(i % 11 == 0, "-").otherwise((200 + 100 * (i % 4)).cast("string"))
    secs = F.when(i % 6 == 0, "-").otherwise(((i % 2500) / 1000.0).cast("decimal(6,3)").cast("string"))
    tag = lambda k, v: F.concat(say(f' {k}:"'), v, say('"'))
    return table(spark, sf_dir, "events").select(i.alias("id"), F.concat(
        host, say(' - [2024-01-01] "'), F.when(i % 4 == 0, "POST").otherwise("GET"), say(" "), target, say(' HTTP/1.1" '), code, say(" 0 response_time:"), secs,
        tag("tenantid", F.when(i % 3 == 0, "-").otherwise(F.concat(say("t"), u % 20))), tag("x_cf_true_client_ip", F.when(i % 4 == 0, "1.1.1.1").when(i % 4 == 1, "-").otherwise("")),
        tag("true_client_ip", F.when(i % 3 == 1, "2.2.2.2").otherwise("-")), tag("x_forwarded_for", F.when(i % 2 == 0, " 3.3.3.3, 4.4.4.4").otherwise("-")),
        tag("x_correlationid", F.when(i % 5 == 2, F.concat(say("c"), i)).otherwise("-")), tag("vcap_request_id", F.when(i % 7 > 2, F.concat(say("v"), i)).otherwise("")),
    ).alias("body"))


@query("router_fields", "with " + ACCESS + """select id, case when host = '-' then '' else host end host, verb as method, case when length(verb || ' ' || shown) <= 120 then verb || ' ' || shown else verb || ' ' || left(shown, 114 - length(verb)) || '...' end request,
  case when code = '-' then '' else code end status, case when secs = '-' then '' when id % 2500 = 0 then '0 ms' when id % 2500 < 1000 then (id % 2500) || ' ms' else regexp_replace(printf('%.3f', (id % 2500) / 1000.0), '\\.?0+$', '') || ' s' end latency,
  case when ten = '-' then '' else ten end tenant, case when ip1 not in ('', '-') then ip1 when ip2 <> '-' then ip2 when ip3 <> '-' then '3.3.3.3' else '' end client_ip, case when rid1 <> '-' then rid1 else rid2 end request_id from a""")
def router_fields(spark, sf_dir):
    return access_lines(spark, sf_dir).select("id", *logs.router_fields(F.col("body")))


@query("log_entries", LINES + """, parts as (select app, id * 4 pos, case when id % 10 = 3 then stamp || ' [APP/0] OUT {"level":"Warning","n":' || id || '}' when id % 10 = 7 then stamp || ' [APP/0] OUT {broken}' else line end line from (select *, @@STAMP@@ stamp from raw)
  union all select app, id * 4 + 1, '  it failed at ' || id from raw where event_type = 'error' union all select app, id * 4 + 2, ' ' from raw where id % 8 = 1 union all select app, id * 4 + 3, 'OKAY ' || id from raw where id % 16 = 1
  union all select distinct app, -5, 'Server error, status code: 500' from raw union all select distinct app, -4, 'orphan one' from raw union all select distinct app, -3, ' fatal orphan' from raw),
k as (select app, pos, trim(line) line, regexp_matches(trim(line), '^20') and not line like '%{broken}' head from parts where trim(line) <> '' and trim(line) not like 'Server error%'),
n as (select *, coalesce(max(case when head then pos end) over (partition by app order by pos), -99) entry from k),
e as (select app, min(pos) pos, max(case when head then line end) h, string_agg(line, chr(10) order by pos) filter (not head) more, count(*) n_lines from n group by app, entry),
m as (select app, pos, h, case when h is null then 'N/A' else split_part(h, ' ', 1) end timestamp_raw, case when h is null then 'SYSTEM' else regexp_extract(h, '\\[([^]]+)\\]', 1) end source, case when h like '%] ERR%' then 'ERR' else 'OUT' end stream,
  case when h is null then more else regexp_replace(h, '^\\S+ \\[[^]]+\\] (OUT|ERR) ', '') || coalesce(chr(10) || more, '') end message, n_lines from e)
select app, pos, timestamp_raw, source, stream, case when message like '{"level":"Warning"%' and h is not null and not contains(message, chr(10)) then 'warn' when h like '%{"level":"Warning"%' then 'warn' when source like 'RTR%' then 'info'
  when message like '%fatal%' then 'fatal' when message ilike '%failed%' then 'error' when message like '%warning%' then 'warn' when stream = 'ERR' then 'error' else 'info' end level, message, n_lines from m""".replace("@@STAMP@@", STAMP))
def log_entries(spark, sf_dir):
    raw = raw_lines(spark, sf_dir)
    i = F.col("id")
    stamp = F.substring_index("line", " ", 1)
    line = F.when(i % 10 == 3, F.concat(stamp, F.lit(' [APP/0] OUT {"level":"Warning","n":'), i, F.lit("}"))).when(i % 10 == 7, F.concat(stamp, F.lit(" [APP/0] OUT {broken}"))).otherwise(F.col("line"))
    more = lambda where, k, text: raw.where(where).select("app", (i * 4 + k).alias("pos"), text.alias("line"))
    lines = raw.select("app", (i * 4).alias("pos"), line.alias("line")).union(more("event_type = 'error'", 1, F.concat(F.lit("  it failed at "), i)))
    lines = lines.union(more("id % 8 = 1", 2, F.lit(" "))).union(more("id % 16 = 1", 3, F.concat(F.lit("OKAY "), i)))
    for pos, text in ((-5, "Server error, status code: 500"), (-4, "orphan one"), (-3, " fatal orphan")):
        lines = lines.union(raw.select("app").distinct().select("app", F.lit(pos).cast("long"), F.lit(text)))
    return logs.entries(lines, "app", Scratch(spark, "entries"))


@query("duration_parse", "select event_id id, case event_id % 8 when 0 then event_id * 1000 when 1 then event_id % 100 * 60000 when 2 then cast(round((event_id % 50 + 0.5) * 3600000) as bigint) when 3 then event_id when 4 then event_id % 30 * 86400000 when 5 then event_id * 1000 end ms, case event_id % 8 when 1 then nullif(event_id % 100 * 60000, 0) when 4 then nullif(event_id % 30 * 86400000, 0) end strict_ms from events")
def duration_parse(spark, sf_dir):
    i = F.col("event_id")
    text = F.when(i % 8 == 0, i.cast("string")).when(i % 8 == 1, F.concat(i % 100, F.lit("m"))).when(i % 8 == 2, F.concat(i % 50, F.lit(".5H"))).when(i % 8 == 3, F.concat(i, F.lit(" ms")))
    text = text.when(i % 8 == 4, F.concat(F.lit(" "), i % 30, F.lit("d "))).when(i % 8 == 5, F.concat(i, F.lit("  s"))).when(i % 8 == 6, "soon").otherwise("-5m")
    return table(spark, sf_dir, "events").select(i.alias("id"), logs.duration_ms(text).alias("ms"), logs.since_ms(text).alias("strict_ms"))


@query("s_newest_first", LOG + "select id, ts from log order by ts desc, app desc, id desc limit 300")
def s_newest_first(spark, sf_dir):
    return log_rows(spark, sf_dir).orderBy(F.desc("ts"), F.desc("app"), F.desc("id")).limit(300).select("id", "ts")


def _pairs(column):
    return f"select app, string_agg(v || '=' || n, ',' order by v) x from (select app, cast({column} as varchar) v, count(*) n from log where {column} is not null group by all) group by app"


@query("a_summary_app", LOG + f""", s as ({_pairs('source')}), b as ({_pairs("((status // 100) || 'xx')")}), t as ({_pairs('tenant')}), r as (select *, row_number() over (partition by app order by ts, id) k, count(*) over (partition by app) n from log)
select app, count(*) total, {", ".join(f"count(*) filter (level = '{x}') n_{x}" for x in logs.SEVERITY)}, any_value(s.x) sources, any_value(b.x) buckets, any_value(t.x) tenants, max(ts) filter (k = 1) first_at, max(ts) filter (k = n) last_at
from r join s using (app) join b using (app) join t using (app) group by app""")
def a_summary_app(spark, sf_dir):
    """Each map of counts is a two-step count, so no row of an application is gathered."""
    rows = log_rows(spark, sf_dir).withColumn("bucket", F.concat(F.substring(F.col("status").cast("string"), 1, 1), F.lit("xx")))
    order = F.struct("ts", "id")
    out = rows.groupBy("app").agg(F.count("*").alias("total"), *_levels(), F.min_by("ts", order).alias("first_at"), F.max_by("ts", order).alias("last_at"))
    for column, name in (("source", "sources"), ("bucket", "buckets"), ("tenant", "tenants")):
        counted = rows.where(F.col(column).isNotNull()).groupBy("app", column).agg(F.count("*").alias("n"))
        pair = F.concat(F.col(column), F.lit("="), F.col("n"))
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(column).alias("v"), pair.alias("p")))), lambda x: x["p"]), ",")
        out = out.join(counted.groupBy("app").agg(listed.alias(name)), "app", "left")
    return out


@query("url_query_redact", """with u as (select page_id, url || case when contains(url, '?') then '&' else '?' end k from pages)
select page_id, case page_id % 5 when 0 then k || 'to%6Ben=redacted&x=1' when 1 then k || 'API-key=redacted#f?token=2' when 2 then k || 'monkey=3' when 3 then k || 'sig=redacted' else k || 'p=%zz&Client_Secret=redacted' end url from u""")
def url_query_redact(spark, sf_dir):
    i = F.col("page_id")
    more = F.when(i % 5 == 0, "to%6Ben=a&x=1").when(i % 5 == 1, "API-key=b=c#f?token=2").when(i % 5 == 2, "monkey=3").when(i % 5 == 3, "sig").otherwise("p=%zz&Client_Secret=")
    sep = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    return table(spark, sf_dir, "pages").select(i, logs.redacted_query(F.concat("url", sep, more)).alias("url"))


@query("first_nonempty", LOG + "select id, case when id % 3 = 0 then 'a-' || id when id % 5 = 0 then 'b-' || id else 'c-' || id end client from log")
def first_nonempty(spark, sf_dir):
    i = F.col("id")
    a = F.when(i % 3 == 0, F.concat(F.lit("a-"), i)).otherwise("-")
    b = F.when(i % 5 == 0, F.concat(F.lit("b-"), i)).otherwise("")
    return log_rows(spark, sf_dir).select("id", logs.first_known(a, b, F.concat(F.lit("c-"), i)).alias("client"))


@query("request_summary", LOG + ", " + ROUTER + "select id, '/odata/v' || (id % 3) || '/Items ' || (id % 5) || '?a=1+2' target from r")
def request_summary(spark, sf_dir):
    target = F.regexp_extract("body", r"\"[A-Z]+ (\S+)", 1)
    return router_lines(spark, sf_dir).select("id", F.substring(logs.percent_decoded(target), 1, 120).alias("target"))


@query("clock_fmt", "select event_id id, strftime(ts, '%H:%M:%S') clock from events")
def clock_fmt(spark, sf_dir):
    return raw_lines(spark, sf_dir).select("id", F.regexp_extract("line", r"T(\d{2}:\d{2}:\d{2})", 1).alias("clock"))


@query("source_family", LOG + "select split_part(source, '/', 1) family, count(*) n from log group by 1")
def source_family(spark, sf_dir):
    return log_rows(spark, sf_dir).groupBy(logs.source_family(F.col("source")).alias("family")).agg(F.count("*").alias("n"))


@query("compact_row", LOG + ", m as (select id, trim(regexp_replace(message, '\\s+', ' ', 'g')) message from log) select id, case when length(message) <= 500 then message else left(message, 497) || '...' end message from m")
def compact_row(spark, sf_dir):
    return log_rows(spark, sf_dir).select("id", logs.compacted(F.col("message")).alias("message"))


@query("searchable_text", LOG + "select id, lower(app || ' ' || source || ' ' || level || ' ' || message || ' status=' || status || ' tenant=' || tenant) text from log")
def searchable_text(spark, sf_dir):
    return log_rows(spark, sf_dir).select("id", F.lower(F.concat_ws(" ", "app", "source", "level", "message", F.concat(F.lit("status="), "status"), F.concat(F.lit("tenant="), "tenant"))).alias("text"))


@query("fn_epoch", "select event_id id, epoch_us(ts) // 1000 - 7 * 3600000 ms from events")
def fn_epoch(spark, sf_dir):
    return raw_lines(spark, sf_dir).select("id", logs.epoch_ms(F.regexp_extract("line", logs.LINE, 1)).alias("ms"))


@query("f_min_level", LOG + "select id, level from log where level in ('warn', 'error', 'fatal')")
def f_min_level(spark, sf_dir):
    rows = log_rows(spark, sf_dir)
    return rows.where(logs.severity(F.col("level")) >= logs.SEVERITY["warn"]).select("id", "level")


@query("f_search", LOG + "select id from log where contains(lower(message), 'slow purchase by 1')")
def f_search(spark, sf_dir):
    return log_rows(spark, sf_dir).where(F.contains(F.lower("message"), F.lower(F.lit("SLOW purchase by 1")))).select("id")


@query("f_status", LOG + "select id, status from log where status between 400 and 499 or status between 500 and 599")
def f_status(spark, sf_dir):
    s = F.col("status")
    return log_rows(spark, sf_dir).where(logs.status_filter(s, "499-400") | logs.status_filter(s, "5xx")).select("id", "status")


@query("f_since_until", "select event_id id from events where ts >= timestamp '2024-01-20 00:00:00'")
def f_since_until(spark, sf_dir):
    return log_rows(spark, sf_dir).where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).select("id")


@query("f_since_renumber", "select row_number() over (order by event_id) id, event_id old_id from events where ts >= timestamp '2024-01-30 00:00:00'")
def f_since_renumber(spark, sf_dir):
    rows = log_rows(spark, sf_dir).where(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz"))
    # numbers over all rows: ranges are numbered apart and shifted by the rows before them, so no task sees them all
    ranged = rows.select(F.col("id").alias("old_id")).repartitionByRange("old_id").withColumn("p", F.spark_partition_id())
    ranged = Scratch(spark, "renumber").keep(ranged, "ranged")  # both branches below read the same ranges
    local = ranged.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("old_id")))
    sizes = ranged.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before), "p").select((F.col("k") + F.col("before")).cast("long").alias("id"), "old_id")


@query("f_app", LOG + "select app, count(*) n from log where app <> 'app-0' and app not like '%4' and (app in ('app-1') or regexp_matches(app, '-[23]$')) group by 1")
def f_app(spark, sf_dir):
    return log_rows(spark, sf_dir).where(logs.app_filter(F.col("app"), ("app-1",), "-[23]$", ("app-0",), "4$")).groupBy("app").agg(F.count("*").alias("n"))


@query("f_type", "select event_type, count(*) n from events where event_type in ('error', 'signup') group by 1")
def f_type(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("f_pattern_word", LOG + "select id from log where regexp_matches(lower(source), '^rtr\\b')")
def f_pattern_word(spark, sf_dir):
    return log_rows(spark, sf_dir).where(F.col("source").rlike(r"(?i)^rtr\b")).select("id")


LEVELS = ", ".join(f"count(*) filter (level = '{x}') n_{x}" for x in logs.SEVERITY)


def _levels():
    return [F.count_if(F.col("level") == x).alias(f"n_{x}") for x in logs.SEVERITY]


@query("a_summary_total", LOG + f"select count(*) total, {LEVELS} from log")
def a_summary_total(spark, sf_dir):
    return log_rows(spark, sf_dir).agg(F.count("*").alias("total"), *_levels())


@query("sum_by_app", LOG + f"select app, count(*) total, {LEVELS}, arg_min(id, id) first_id, arg_max(id, id) last_id, arg_max(message, id) last_message from log group by app")
def sum_by_app(spark, sf_dir):
    return log_rows(spark, sf_dir).groupBy("app").agg(F.count("*").alias("total"), *_levels(), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max_by("message", "id").alias("last_message"))


@query("a_status_bucket", LOG + "select app, (status // 100) || 'xx' bucket, count(*) n from log group by all")
def a_status_bucket(spark, sf_dir):
    return log_rows(spark, sf_dir).groupBy("app", F.concat(F.substring(F.col("status").cast("string"), 1, 1), F.lit("xx")).alias("bucket")).agg(F.count("*").alias("n"))


@query("a_compact_summary", LOG + "select level, split_part(source, '/', 1) family, count(*) n, min(id) first_id, max(id) last_id from log group by all")
def a_compact_summary(spark, sf_dir):
    return log_rows(spark, sf_dir).groupBy("level", logs.source_family(F.col("source")).alias("family")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("a_top_tenants", LOG + "select tenant, count(*) n from log group by 1 order by n desc, tenant limit 5")
def a_top_tenants(spark, sf_dir):
    return log_rows(spark, sf_dir).groupBy("tenant").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tenant").limit(5)


@query("a_crash_app", "select user_id, count(*) crashes, max(ts) last_at, arg_max(event_id, ts) last_id from events where event_type = 'error' group by 1")
def a_crash_app(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    return rows.groupBy("user_id").agg(F.count("*").alias("crashes"), F.max("ts").alias("last_at"), F.max_by("event_id", "ts").alias("last_id"))


@query("a_crash_space", "select coalesce(nullif(case when user_id % 7 = 0 then '' else 'user-' || user_id end, ''), '(unknown app)') app, count(*) crashes, max(ts) last_at from events where event_type = 'error' group by 1")
def a_crash_space(spark, sf_dir):
    name = F.when(F.col("user_id") % 7 == 0, "").otherwise(F.concat(F.lit("user-"), "user_id"))
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("app", F.coalesce(logs.known(name), F.lit("(unknown app)")))
    return rows.groupBy("app").agg(F.count("*").alias("crashes"), F.max("ts").alias("last_at"))


@query("a_ssh_active", "select user_id, count(*) sessions, count(*) filter (ts between timestamp '2024-01-30 11:00:00' and timestamp '2024-01-30 12:00:00') active from events where event_type in ('signup', 'purchase') group by 1")
def a_ssh_active(spark, sf_dir):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-30 11:00:00", "2024-01-30 12:00:00"))
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase"))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.count_if(F.col("ts").between(lo, hi)).alias("active"))


@query("w_last_n", LOG + "select app, id from log qualify row_number() over (partition by app order by id desc) <= 300")
def w_last_n(spark, sf_dir):
    return logs.last_n(log_rows(spark, sf_dir), 300, "app", "id").select("app", "id")


@query("w_new_rows", LOG + "select app, id from log l where id > (select max(id) from log s where s.app = l.app and s.id % 4 = 0)")
def w_new_rows(spark, sf_dir):
    rows = log_rows(spark, sf_dir)
    seen = rows.where("id % 4 = 0").groupBy("app").agg(F.max("id").alias("seen"))
    return rows.join(seen, "app").where("id > seen").select("app", "id")


@query("s_max_rows", LOG + "select id, ts from log order by ts desc, id desc limit 50")
def s_max_rows(spark, sf_dir):
    return log_rows(spark, sf_dir).orderBy(F.desc("ts"), F.desc("id")).limit(50).select("id", "ts")


@query("u_merge_apps", LOG + "select 'a' tag, id, ts from log where app = 'app-1' union all select 'b', id, ts from log where app = 'app-2'")
def u_merge_apps(spark, sf_dir):
    rows = log_rows(spark, sf_dir)
    part = lambda tag, app: rows.where(F.col("app") == app).select(F.lit(tag).alias("tag"), "id", "ts")
    return part("a", "app-1").unionByName(part("b", "app-2"))


@query("a_url_summary", r"""with u as (select page_id pos, page_id // 3 as moment, case page_id % 3 when 0 then 'GET' when 1 then 'POST' else 'PUT' end as method, (case page_id % 6 when 0 then 200 when 1 then 302 when 2 then 404 when 3 then 503 when 4 then 99 end)::int status, page_id / 2.0::double duration_ms,
  coalesce(url, '') url, regexp_extract(trim(coalesce(url, '')), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^#]*)', 1) rest from pages),
s as (select *, case when trim(url) = '' then url when starts_with(rest, '/') then rest else '/' || rest end shown_url from u)
select shown_url, string_agg(distinct method, ',' order by method) methods, count(*) total, count(*) filter (status between 200 and 299) n_2xx, count(*) filter (status between 300 and 399) n_3xx, count(*) filter (status between 400 and 499) n_4xx,
  count(*) filter (status between 500 and 599) n_5xx, count(*) filter (status is null or status not between 200 and 599) n_unknown, arg_max_null(status, pos) last_status, arg_max(duration_ms, pos) last_duration_ms, max(moment) last_at from s group by 1""")
def a_url_summary(spark, sf_dir):
    i = F.col("page_id")
    status = F.when(i % 6 == 0, 200).when(i % 6 == 1, 302).when(i % 6 == 2, 404).when(i % 6 == 3, 503).when(i % 6 == 4, 99)
    events = table(spark, sf_dir, "pages").select(
        traces.shown_url(F.lit(None).cast("string"), F.col("url"), F.lit("")).alias("shown_url"), F.when(i % 3 == 0, "GET").when(i % 3 == 1, "POST").otherwise("PUT").alias("method"),
        status.alias("status"), (i / 2).alias("duration_ms"), F.floor(i / 3).alias("at"), i.alias("pos"),
    )
    return traces.url_summaries(events)


@query("url_normalize", "select page_id, regexp_replace(url, '^[^:]+://[^/?#]*([^#]*).*$', '\\1') target from pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^[^:]+://[^/?#]*([^#]*).*$", "$1").alias("target"))


@query("latency_fmt", "select event_id id, case when event_id % 2500 = 0 then '0 ms' when event_id % 2500 < 1000 then (event_id % 2500) || ' ms' else regexp_replace(printf('%.3f', (event_id % 2500) / 1000.0), '\\.?0+$', '') || ' s' end latency from events")
def latency_fmt(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), logs.latency_text(((F.col("event_id") % 2500) / 1000.0).cast("double")).alias("latency"))
