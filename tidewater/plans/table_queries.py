"""Queries over tables: joins, aggregates, windows, limits, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import text
from tidewater.operators.numbering import number
from tidewater.operators.ranking import first_few
from tidewater.plans.registry import query
from tidewater.session import Scratch, table

PRIORITY = "strftime(o_orderdate, '%Y-%m-%d')"


def t(spark, sf_dir, *names):
    found = [table(spark, sf_dir, n) for n in names]
    return found[0] if len(found) == 1 else found


@query("where_eq", "select c_custkey from customer where c_mktsegment = 'BUILDING' and c_nationkey = 5")
def where_eq(spark, sf_dir):
    return spark.sql("select c_custkey from {c} where c_mktsegment = :seg and c_nationkey = :nation", args={"seg": "BUILDING", "nation": 5}, c=t(spark, sf_dir, "customer"))


@query("f_optional_param", "select c_custkey from customer where (null is null or c_nationkey = null) and c_acctbal > 0")
def f_optional_param(spark, sf_dir):
    return spark.sql("select c_custkey from {c} where (:n is null or c_nationkey = :n) and c_acctbal > :low", args={"n": None, "low": 0}, c=t(spark, sf_dir, "customer"))


@query("f_like_any", "select p_partkey from part where p_name = 'x' or p_brand = 'Brand#11' or p_type like '%BRASS'")
def f_like_any(spark, sf_dir):
    return t(spark, sf_dir, "part").where((F.col("p_name") == "x") | (F.col("p_brand") == "Brand#11") | F.col("p_type").like("%BRASS")).select("p_partkey")


@query("f_worklog", f"select o_orderkey from orders where o_orderpriority = '1-URGENT' and {PRIORITY} between '1995-01-01' and '1995-12-31'")
def f_worklog(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t(spark, sf_dir, "orders").where((F.col("o_orderpriority") == "1-URGENT") & day.between("1995-01-01", "1995-12-31")).select("o_orderkey")


@query("f_expired", "select event_id from events where ts + interval 2 hour > timestamp '2024-01-30 12:00:00'")
def f_expired(spark, sf_dir):
    return t(spark, sf_dir, "events").where(F.expr("ts + interval 2 hours > timestamp_ntz '2024-01-30 12:00:00'")).select("event_id")


@query("f_seq", "select conv_id, turn from conversations where turn >= 2 and role = 'user'")
def f_seq(spark, sf_dir):
    return t(spark, sf_dir, "conversations").where("turn >= 2 and role = 'user'").select("conv_id", "turn")


@query("j_inner_chain", "select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'")
def j_inner_chain(spark, sf_dir):
    c, n, r = t(spark, sf_dir, "customer", "nation", "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).where("r_name = 'ASIA'").select("c_custkey", "n_name", "r_name")


@query("j_left_chain", "select c_custkey, count(o_orderkey) n from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by 1")
def j_left_chain(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    return c.join(o.where("o_orderstatus = 'F'"), c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("j_cast_key", "select c_custkey, o_orderkey from (select c_custkey, case when c_custkey % 5 = 0 then 'x' else c_custkey || '' end k from customer) c join orders on try_cast(k as bigint) = o_custkey")
def j_cast_key(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    k = F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(F.col("c_custkey").cast("string"))
    return c.select("c_custkey", k.try_cast("long").alias("o_custkey")).join(o, "o_custkey").select("c_custkey", "o_orderkey")


@query("j_json_key", "select event_id, n_name from events join nation on cast(json_extract_string(props, '$.k') as int) = n_nationkey")
def j_json_key(spark, sf_dir):
    e, n = t(spark, sf_dir, "events", "nation")
    keyed = e.select("event_id", text.json_at(F.col("props"), "/k").try_cast("int").alias("n_nationkey"))
    return keyed.join(n, "n_nationkey").select("event_id", "n_name")


@query("j_or_condition", "select distinct s_suppkey, c_custkey from supplier join customer on s_suppkey = c_custkey or s_name = c_name or (s_nationkey = c_nationkey and s_acctbal = c_acctbal)")
def j_or_condition(spark, sf_dir):
    s, c = t(spark, sf_dir, "supplier", "customer")
    on = [s.s_suppkey == c.c_custkey, s.s_name == c.c_name, (s.s_nationkey == c.c_nationkey) & (s.s_acctbal == c.c_acctbal)]
    found = [s.join(c, x).select("s_suppkey", "c_custkey") for x in on]
    return found[0].union(found[1]).union(found[2]).distinct()


@query("j_interval_contain", "select a.event_id, b.event_id inner_id from events a join events b on a.user_id = b.user_id and a.event_id <> b.event_id and b.ts >= a.ts and b.ts <= a.ts + interval 1 hour where a.event_type = 'purchase'")
def j_interval_contain(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("t0"))
    b = e.select(F.col("event_id").alias("inner_id"), "user_id", F.col("ts").alias("t1"))
    return a.join(b, "user_id").where("event_id <> inner_id and t1 >= t0 and t1 <= t0 + interval 1 hour").select("event_id", "inner_id")


@query("j_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def j_semi(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    return c.join(o.where("o_orderpriority = '1-URGENT'"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("j_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def j_anti(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("j_anti_left_null", "select n_name from nation left join supplier on n_nationkey = s_nationkey and s_acctbal > 9000 where s_suppkey is null")
def j_anti_left_null(spark, sf_dir):
    n, s = t(spark, sf_dir, "nation", "supplier")
    return n.join(s.where("s_acctbal > 9000"), n.n_nationkey == s.s_nationkey, "left_anti").select("n_name")


@query("j_self_siblings", "select n_name, (select count(*) from nation m where m.n_regionkey = n.n_regionkey and m.n_nationkey <> n.n_nationkey) siblings from nation n")
def j_self_siblings(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    return n.join(n.groupBy("n_regionkey").agg((F.count("*") - 1).alias("siblings")), "n_regionkey").select("n_name", "siblings")


@query("j_refmap", "select l_orderkey, l_linenumber, s_name from lineitem left join supplier on l_suppkey = s_suppkey")
def j_refmap(spark, sf_dir):
    l, s = t(spark, sf_dir, "lineitem", "supplier")
    return l.join(s, l.l_suppkey == s.s_suppkey, "left").select("l_orderkey", "l_linenumber", "s_name")


@query("j_neq_residual", "select a.s_suppkey a_key, b.s_suppkey b_key from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey")
def j_neq_residual(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    a, b = (s.select(F.col("s_suppkey").alias(k), "s_nationkey") for k in ("a_key", "b_key"))
    return a.join(b, "s_nationkey").where("a_key < b_key").select("a_key", "b_key")


@query("j_union_refs", "select k, name, min(priority) priority from (select s_suppkey k, s_name as name, 1 priority from supplier union all select c_custkey, c_name, 2 from customer) group by all")
def j_union_refs(spark, sf_dir):
    s, c = t(spark, sf_dir, "supplier", "customer")
    both = s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit(1).alias("priority")).unionByName(c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit(2).alias("priority")))
    return both.groupBy("k", "name").agg(F.min("priority").alias("priority"))


@query("a_worklog", f"select o_orderpriority issue, {PRIORITY} as day, sum(cast(floor(o_totalprice / 1000) as bigint)) as minutes, round(sum(cast(floor(o_totalprice / 1000) as bigint)) / 60.0, 2)::double as hours from orders group by all")
def a_worklog(spark, sf_dir):
    minutes = F.floor(F.col("o_totalprice") / 1000)
    rows = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("issue"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.sum(minutes).alias("minutes"))
    return rows.withColumn("hours", text.hours(F.col("minutes")).cast("double"))


@query("a_count_table", "select count(*) n from orders where o_orderstatus = 'O'")
def a_count_table(spark, sf_dir):
    return t(spark, sf_dir, "orders").where("o_orderstatus = 'O'").agg(F.count("*").alias("n"))


@query("a_count_having", "select l_orderkey, count(*) n from lineitem group by 1 having count(*) <> 1")
def a_count_having(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n <> 1")


@query("a_having_global", "select count(*) n from orders having count(*) > 10")
def a_having_global(spark, sf_dir):
    return t(spark, sf_dir, "orders").agg(F.count("*").alias("n")).where("n > 10")


@query("a_sum_case", "select l_returnflag, sum(case when l_discount > 0.05 then 1 else 0 end)::bigint discounted, count(*) filter (l_tax > 0.04) taxed from lineitem group by 1")
def a_sum_case(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("discounted"), F.count_if(F.col("l_tax") > 0.04).alias("taxed"))


@query("a_ratio", "select c_mktsegment, round(count(*) filter (c_acctbal < 0)::double / nullif(count(*), 0), 4) ratio from customer group by 1")
def a_ratio(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") < 0).alias("bad"), F.count("*").alias("n"))
    return rows.select("c_mktsegment", F.round(F.col("bad") / F.nullif("n", F.lit(0)), 4).alias("ratio"))


@query("a_count_distinct", "select l_shipdate::date as day, count(distinct l_suppkey) n, count(distinct case when l_quantity > 25 then l_partkey end) n_big from lineitem group by 1")
def a_count_distinct(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count_distinct("l_suppkey").alias("n"), F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("n_big"))


@query("a_array_agg", "select n_regionkey, string_agg(n_name, ',' order by n_name) names from nation group by 1")
def a_array_agg(spark, sf_dir):
    return t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("a_topn_group", "select p_brand, count(*) n from part group by 1 order by n desc, p_brand limit 10")
def a_topn_group(spark, sf_dir):
    return t(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


@query("a_agreed_or_mixed", "select o_custkey, case when count(distinct o_orderstatus) = 1 then min(o_orderstatus) else 'mixed' end status from orders group by 1")
def a_agreed_or_mixed(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(F.min("o_orderstatus") == F.max("o_orderstatus"), F.min("o_orderstatus")).otherwise("mixed").alias("status"))


@query("a_dup_families", "select p_name, count(distinct p_brand) n from part group by 1 having count(distinct p_brand) > 1")
def a_dup_families(spark, sf_dir):
    return t(spark, sf_dir, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("n")).where("n > 1")


@query("a_merge_candidates", "select l_orderkey, max(l_extendedprice) score, bool_or(l_returnflag = 'R') accepted, string_agg(distinct l_linestatus, ',' order by l_linestatus) reasons from lineitem group by 1")
def a_merge_candidates(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("score"), F.bool_or(F.col("l_returnflag") == "R").alias("accepted"), F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("reasons"))


@query("a_provenance_group", "select o_custkey, count(*) total, greatest(count(*) - 5, 0) omitted, array_to_string(list_sort(list(o_orderkey))[1:5], ',') shown from orders group by 1")
def a_provenance_group(spark, sf_dir):
    few = first_few(t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 5, "total", "shown")
    return few.select("o_custkey", "total", F.greatest(F.col("total") - 5, F.lit(0)).alias("omitted"), "shown")


@query("a_collision", "select props, count(distinct user_id) users from events group by 1 having count(distinct user_id) > 1")
def a_collision(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("props").agg(F.count_distinct("user_id").alias("users")).where("users > 1")


@query("w_dense_rank", "select o_custkey, o_orderkey, cast(dense_rank() over (partition by o_custkey order by o_orderpriority, o_orderdate) as int) rank from orders qualify rank <= 2")
def w_dense_rank(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate")
    return t(spark, sf_dir, "orders").withColumn("rank", F.dense_rank().over(w)).where("rank <= 2").select("o_custkey", "o_orderkey", "rank")


@query("w_rank_gap", """with r as (select l_orderkey, l_linenumber, l_extendedprice, lead(l_extendedprice) over w nxt, row_number() over w k from lineitem window w as (partition by l_orderkey order by l_extendedprice desc, l_linenumber))
select l_orderkey, l_linenumber, case when nxt is null or l_extendedprice - nxt >= 1000 then 'resolved' else 'ambiguous' end verdict from r where k = 1""")
def w_rank_gap(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.lead("l_extendedprice").over(w).alias("second"), F.row_number().over(w).alias("k")).where("k = 1")
    clear = F.col("second").isNull() | (F.col("l_extendedprice") - F.col("second") >= 1000)
    return rows.select("l_orderkey", "l_linenumber", F.when(clear, "resolved").otherwise("ambiguous").alias("verdict"))


@query("w_status_order", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end, o_orderkey) = 1")
def w_status_order(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    best = F.min_by("o_orderkey", F.struct(rank, "o_orderkey"))
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("o_orderkey"))


@query("l_auto_limit", "select o_orderkey, (select count(*) from orders) > 100 truncated from orders order by o_orderkey limit 100")
def l_auto_limit(spark, sf_dir):
    found = t(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").limit(101)
    w = Window.orderBy("o_orderkey")
    return found.select("o_orderkey", F.row_number().over(w).alias("k"), (F.count("*").over(Window.partitionBy()) > 100).alias("truncated")).where("k <= 100").drop("k")


@query("l_order_limit_offset", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 20 offset 10")
def l_order_limit_offset(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(10).limit(20)


@query("l_refuse", "select l_suppkey, case when count(*) > 600 then 'refused' else 'kept' end verdict, count(*) n from lineitem group by 1")
def l_refuse(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.when(F.count("*") > 600, "refused").otherwise("kept").alias("verdict"), F.count("*").alias("n"))


@query("u_union_all", "select 'customer' kind, c_name as name from customer union all select 'supplier', s_name from supplier union all select 'part', p_name from part")
def u_union_all(spark, sf_dir):
    parts = [t(spark, sf_dir, k).select(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("u_distinct", "select distinct l_partkey, l_suppkey from lineitem")
def u_distinct(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("u_catalog_diff", "select coalesce(a.k, b.k) k, case when a.k is null then 'added' else 'removed' end change from (select c_custkey k from customer where c_custkey % 3 <> 0) a full join (select c_custkey k from customer where c_custkey % 5 <> 0) b using (k) where a.k is null or b.k is null")
def u_catalog_diff(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    a, b = c.where("k % 3 <> 0"), c.where("k % 5 <> 0")
    return b.join(a, "k", "left_anti").withColumn("change", F.lit("added")).union(a.join(b, "k", "left_anti").withColumn("change", F.lit("removed")))


@query("u_upsert", "select k, arg_max(v, version) v from (select c_custkey k, c_name v, 1 version from customer union all select c_custkey + 10, 'new-' || c_custkey, 2 from customer where c_custkey % 4 = 0) group by 1")
def u_upsert(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(1).alias("version"))
    new = c.where("c_custkey % 4 = 0").select((F.col("c_custkey") + 10).alias("k"), F.concat(F.lit("new-"), "c_custkey").alias("v"), F.lit(2).alias("version"))
    return old.union(new).groupBy("k").agg(F.max_by("v", "version").alias("v"))


@query("u_reconcile", """select coalesce(a.k, b.k) k, case when b.k is null then 'delete' when a.k is null then 'insert' when a.v is distinct from b.v then 'update' else 'keep' end act
from (select s_suppkey k, s_nationkey v from supplier where s_suppkey % 3 <> 0) a full join (select s_suppkey k, case when s_suppkey % 2 = 0 then s_nationkey else 0 end v from supplier where s_suppkey % 5 <> 0) b using (k)""")
def u_reconcile(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    a = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"), F.lit(True).alias("old"))
    b = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).otherwise(0).alias("w"), F.lit(True).alias("new"))
    act = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").when(~F.col("v").eqNullSafe(F.col("w")), "update").otherwise("keep")
    return a.join(b, "k", "full").select("k", act.alias("act"))


@query("u_pending", "select s_nationkey, array_to_string(list_sort(list(s_suppkey) filter (s_acctbal >= 0)), ',') pending from supplier group by 1")
def u_pending(spark, sf_dir):
    done = F.coalesce(F.collect_list(F.when(F.col("s_acctbal") < 0, F.col("s_suppkey"))), F.array())
    rows = t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.array_except(F.collect_list("s_suppkey"), done)).alias("p"))
    return rows.select("s_nationkey", F.when(F.size("p") > 0, F.array_join(F.col("p").cast("array<string>"), ",")).alias("pending"))


@query("fn_levenshtein", "select n_nationkey, levenshtein(n_name, 'GERMANY') d from nation")
def fn_levenshtein(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", F.levenshtein("n_name", F.lit("GERMANY")).cast("long").alias("d"))


@query("fn_fuzzy_score", "with s as (select n_name, case when lower(n_name) = 'nation_1' then -2000 when contains(lower(n_name), 'nation_1') then -1001 + instr(lower(n_name), 'nation_1') else levenshtein(lower(n_name), 'nation_1') end score from nation) select n_name, score::bigint score from s where score <= 3")
def fn_fuzzy_score(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_name", text.fuzzy_score(F.col("n_name"), F.lit("nation_1")).cast("long").alias("score")).where("score is not null")


@query("fn_month_key", "select o_orderkey, strftime(o_orderdate, '%Y%m') as month, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def fn_month_key(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("month"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("fn_month_range", "select o_custkey, strftime(unnest(range(date_trunc('month', min(o_orderdate)), max(o_orderdate) + interval 1 microsecond, interval 1 month)), '%Y%m') as month from orders group by 1")
def fn_month_range(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    months = F.explode(F.sequence(F.trunc("a", "month"), F.col("b").cast("date"), F.expr("interval 1 month")))
    return rows.select("o_custkey", months.alias("m")).select("o_custkey", F.date_format("m", "yyyyMM").alias("month"))


@query("fn_csv_escape", """select page_id, case when regexp_matches(html, '[",\r\n]') then '"' || replace(html, '"', '""') || '"' else coalesce(html, '') end cell from pages""")
def fn_csv_escape(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", text.csv_escape(F.col("html")).alias("cell"))


@query("fn_md_escape", r"select doc_id, regexp_replace(replace(replace(text, '\', '\\'), '|', '\|'), '\r?\n', ' ', 'g') cell from documents")
def fn_md_escape(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.md_escape(F.col("text")).alias("cell"))


@query("fn_redact_literal", "select c_custkey, replace(replace(c_name, 'Customer#', '***'), '00', '***') name from customer")
def fn_redact_literal(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", text.redact_literals(F.col("c_name"), ["00", "Customer#"]).alias("name"))


@query("fn_redact_mail", r"select doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') text from documents")
def fn_redact_mail(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.redact_mail(F.col("text")).alias("text"))


@query("fn_slug_hash", "select p_partkey, substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 40) || '-' || substr(sha256(p_name), 1, 12) slug from part")
def fn_slug_hash(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.slug_hash(F.col("p_name")).alias("slug"))


@query("fn_hash_color", "with h as (select n_name, list_reduce(list_prepend(0::bigint, list_transform(string_split(n_name, ''), lambda c: ascii(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296) h from nation) select n_name, (abs(case when h >= 2147483648 then h - 4294967296 else h end) % 10)::int color from h")
def fn_hash_color(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_name", text.hash_color(F.col("n_name")).alias("color"))


@query("fn_a1_col", "select n_nationkey, (case when n_nationkey < 26 then n_nationkey + 1 end)::int col from nation")
def fn_a1_col(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", text.a1_column(F.char((F.col("n_nationkey") + 65).cast("long"))).alias("col"))


@query("fn_json_extract", "select event_id, json_extract_string(props, '$.k') k, json_valid(props) valid from events")
def fn_json_extract(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", text.json_at(F.col("props"), "/k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("fn_instr_substr", "select p_partkey, instr(p_name, ' ')::int as at, substr(p_name, 1, 5) head from part")
def fn_instr_substr(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.instr("p_name", " ").alias("at"), F.substring("p_name", 1, 5).alias("head"))


@query("cell_preview", r"select doc_id, substr(translate(text, chr(10) || chr(9), '  '), 1, 80) preview, length(text) n, length(text) > 80 truncated from documents")
def cell_preview(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.substring(F.translate("text", "\n\t", "  "), 1, 80).alias("preview"), F.length("text").cast("long").alias("n"), (F.length("text") > 80).alias("truncated"))


@query("bool_norm", "select o_orderkey, case o_orderstatus when 'F' then true when 'O' then false end flag from orders")
def bool_norm(spark, sf_dir):
    raw = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "false").otherwise("?")
    said = F.lower(raw)
    return t(spark, sf_dir, "orders").select("o_orderkey", F.when(said.isin("1", "true"), True).when(said.isin("0", "false"), False).alias("flag"))


@query("src_worksheet", "select n_nationkey, n_name from (select *, row_number() over (order by n_nationkey) r from nation) where r between 3 and 10")
def src_worksheet(spark, sf_dir):
    numbered = number(t(spark, sf_dir, "nation"), ["n_nationkey"], Scratch(spark, "worksheet"), "rows")
    return numbered.where("n between 2 and 9").select("n_nationkey", "n_name")


@query("sink_json", "select n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' as row_json from nation")
def sink_json(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("row_json"))
