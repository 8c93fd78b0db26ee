"""Which operation a call means: candidates by path or name, scores from several signals, and the lead that decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.templates import HOLE

SIGNALS = ["operation_path", "service_path", "service_name", "alias", "destination", "repo_id", "is_dynamic", "has_override"]
#: What each signal adds, and the score and lead that resolve a call.
BASE, OWNED_BASE, PATH_EXACT, PATH_OTHER, QUALIFIED, SIMPLE, BY_PATH, SUFFIX_ONE, SUFFIX_MANY, OVERRIDE, RECOVERED = 0.2, 0.95, 0.75, -0.1, 0.8, 0.75, 0.7, 0.65, 0.2, 0.2, 0.9
LEAST_SCORE, LEAST_LEAD = 0.9, 0.25


def _said(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def _last(name: Column) -> Column:
    return F.element_at(F.split(name, r"\.", -1), -1)


def _keys(text: Column, name: Column) -> Column:
    return F.array_distinct(F.array(F.concat(F.lit("p"), text), F.concat(F.lit("p/"), _last(name)), F.concat(F.lit("n"), name), F.concat(F.lit("n"), _last(name))))


def resolve_operations(calls: DataFrame, operations: DataFrame, owners: DataFrame) -> DataFrame:
    """calls(id, *SIGNALS) -> (id, status, operation_id, candidates, score, lead, reasons), one row a call.

    operations(operation_id, operation_path, operation_name, service_path, service_name,
    qualified_name, repo_id, repo_name): candidates have the call's path or name, or the last
    part of it. A call with a repo_id takes those of its own repository; if there are none and
    it names a service, those of that service which owners(operation_id, repo_id, direct) ties
    to the repository: direct ones, else a sole other one.

    Status: dynamic (holes in a signal, or a dynamic target without override or service path),
    resolved (the best score is LEAST_SCORE or more and LEAST_LEAD above the next, and its
    service is the one asked for), else ambiguous with several candidates and unresolved with
    one or none. `lead` is null without a second candidate. Null and empty signals say nothing.

    Calls of the same signals are resolved once. Operations meet distinct paths of calls; they
    are counted by the words (names, paths and their tails) that any call asks for, and a call
    meets only counts with a word of its own. The rest of its candidates score least and are a
    difference of counts, so calls and candidates are never paired.
    """
    named = calls.select("id", F.md5(F.to_json(F.struct(*SIGNALS), {"ignoreNullFields": "false"})).alias("sid"), *SIGNALS)
    asked = named.drop("id").dropDuplicates(["sid"])
    holes = lambda c: F.coalesce(F.transform(F.regexp_extract_all(c, F.lit(HOLE), F.lit(1)), lambda k: F.trim(k)), F.array().cast("array<string>"))
    asked = asked.withColumn("missing", F.array_distinct(F.concat(*(holes(c) for c in ("service_path", "alias", "destination", "operation_path")))))
    asked = asked.withColumn("override", F.coalesce("has_override", F.lit(False)))
    name = F.regexp_replace("operation_path", "^/", "")
    path_is_open = F.col("operation_path").rlike(HOLE)
    texts = asked.where(_said("operation_path") & ~path_is_open).select(F.col("operation_path").alias("text"), name.alias("name")).distinct()
    wanted = texts.select("text", F.explode(_keys(F.col("text"), F.col("name"))).alias("key"))
    offered = operations.select("operation_id", F.explode(F.array(F.concat(F.lit("p"), "operation_path"), F.concat(F.lit("n"), "operation_name"))).alias("key"))
    met = wanted.join(offered.where("key is not null"), "key").select("text", "operation_id").distinct()

    # what calls name of an operation, and which of it any call names; operations that differ in nothing else are counted together
    simple = _last(F.col("service_name"))
    slash = F.concat(F.lit("/"), simple)
    asks = F.when(_said("service_name"), F.array(
        F.concat(F.lit("q"), "service_name"), F.concat(F.lit("n"), "service_name"), F.concat(F.lit("n"), simple),
        F.concat(F.lit("p"), "service_name"), F.concat(F.lit("p/"), "service_name"), F.concat(F.lit("p"), slash), F.concat(F.lit("s"), simple),
    )).otherwise(F.array().cast("array<string>"))
    asks = F.array_distinct(F.concat(asks, F.when(_said("service_path"), F.array(F.concat(F.lit("p"), "service_path"))).otherwise(F.array().cast("array<string>"))))
    asked = asked.withColumn("asks", asks)
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split("service_path", "/")) - 1), lambda i: F.concat(F.lit("s"), F.call_function("substring_index", F.col("service_path"), F.lit("/"), -i)))
    tails = F.when(F.contains("service_path", F.lit("/")), tails).otherwise(F.array().cast("array<string>"))
    says = F.array_compact(F.concat(F.array(F.concat(F.lit("q"), "qualified_name"), F.concat(F.lit("n"), "service_name"), F.concat(F.lit("p"), "service_path")), F.coalesce(tails, F.array().cast("array<string>"))))
    said = operations.select("operation_id", F.explode(F.array_distinct(says)).alias("word")).distinct()
    said = said.join(asked.select(F.explode("asks").alias("word")).distinct(), "word").groupBy("operation_id").agg(F.sort_array(F.collect_set("word")).alias("words"))
    rows = met.join(operations.select("operation_id", F.col("repo_id").alias("its_repo"), F.struct("repo_name", F.col("service_path").alias("its_path"), "operation_name", "operation_id").alias("first")), "operation_id").join(said, "operation_id", "left")
    rows = rows.withColumn("words", F.coalesce("words", F.array().cast("array<string>")))

    # scopes: a call takes candidates of any repository, of its own, or those that its own owns
    each = rows.select("text", F.explode(F.array(F.struct(F.lit("any").alias("scope"), F.lit(None).cast(rows.schema["its_repo"].dataType).alias("of")), F.struct(F.lit("own").alias("scope"), F.col("its_repo").alias("of")))).alias("s"), "words", "first", F.lit(False).alias("direct"))
    tied = owners.select("operation_id", F.col("repo_id").alias("of"), "direct").groupBy("operation_id", "of").agg(F.max("direct").alias("direct")).where("direct is not null and of is not null")
    tied = rows.where("size(words) > 0").join(tied, "operation_id").select("text", F.lit("owned").alias("scope"), "of", "words", "first", "direct")
    each = each.select("text", "s.*", "words", "first", "direct").where("scope = 'any' or of is not null").union(tied)
    each = each.groupBy("text", "scope", "of", "words").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.count_if("direct").alias("n_direct"), F.min(F.when(F.col("direct"), F.col("first"))).alias("first_direct"))
    totals = each.where("scope <> 'owned'").groupBy("text", "scope", "of").agg(F.sum("n").alias("total"), F.min("first").alias("sole"))
    in_all = totals.where("scope = 'any'").select("text", F.col("total").alias("met"), F.col("sole").alias("sole_of_all"))
    in_own = totals.where("scope = 'own'").select("text", F.col("of").alias("repo_id"), F.col("total").alias("locals"), F.col("sole").alias("sole_local"))
    calls_ = asked.withColumn("text", F.when(_said("operation_path") & ~path_is_open, F.col("operation_path"))).join(in_all, "text", "left").join(in_own, ["text", "repo_id"], "left")
    whole, own = F.col("repo_id").isNull(), F.col("locals").isNotNull()
    by_owner = ~whole & ~own & _said("service_name") & F.col("met").isNotNull()
    calls_ = calls_.withColumn("by_owner", by_owner).withColumn("total", F.when(whole, F.col("met")).when(own, F.col("locals"))).withColumn("sole", F.when(whole, F.col("sole_of_all")).when(own, F.col("sole_local")))
    scopes = F.when(whole, F.array(F.lit("any"))).when(own, F.array(F.lit("own"))).when(by_owner, F.array(F.lit("owned"), F.lit("any"))).otherwise(F.array().cast("array<string>"))
    calls_ = calls_.drop("sole_of_all", "sole_local")
    looks = calls_.where("met is not null").select("sid", "text", "repo_id", "service_path", "service_name", "asks", F.explode(scopes).alias("scope")).select("*", F.explode("asks").alias("word"))
    looks = looks.withColumn("of", F.when(F.col("scope") != "any", F.col("repo_id")))
    has = each.where("size(words) > 0").select("*", F.explode("words").alias("word"))
    # null-safe on `of`; a call and a kind of operations that have several words in common meet by the first of them
    found = looks.join(has.withColumnRenamed("text", "t").withColumnRenamed("scope", "sc").withColumnRenamed("of", "its").withColumnRenamed("word", "w"), F.expr("text = t and scope = sc and word = w and of <=> its")).where("word = array_intersect(asks, words)[0]")
    one_of = lambda *words: F.arrays_overlap("words", F.array(*words))
    word = lambda mark, c: F.concat(F.lit(mark), c)
    kind = (
        F.when(~_said("service_name"), F.lit(None)).when(one_of(word("q", "service_name")), "exact_local_qualified_service_name")
        .when(one_of(word("n", "service_name"), word("n", simple)), "exact_local_simple_service_name")
        .when(one_of(word("p", "service_name"), word("p/", "service_name"), word("p", slash)), "exact_local_service_path")
        .when(one_of(word("s", simple)), "suffix_local_service_path").otherwise("local_service_name_mismatch")
    )
    no = F.lit(False)
    exact = F.coalesce(_said("service_path") & one_of(word("p", "service_path")), no)
    found = found.select("sid", "scope", kind.alias("kind"), exact.alias("exact"), (_said("service_name") & F.coalesce(one_of(word("s", simple)), no)).alias("suffix"), "n", "first", "n_direct", "first_direct")
    found = found.groupBy("sid", "scope", "kind", "exact", "suffix").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("n_direct").alias("n_direct"), F.min("first_direct").alias("first_direct"))
    matching = F.coalesce(F.col("kind") != "local_service_name_mismatch", no)
    classes = F.struct("kind", "exact", "suffix", "n", "first", "n_direct", "first_direct")
    found = found.groupBy("sid").agg(
        F.collect_list(F.when((F.col("scope") == "own") | (F.col("scope") == "any"), classes)).alias("of_scope"), F.collect_list(F.when((F.col("scope") == "owned") & matching, classes)).alias("of_owner"),
        F.sum(F.when((F.col("scope") == "any") & matching, F.col("n"))).alias("matches"),
    )
    used = calls_.join(found, "sid", "left")
    none = F.array().cast(found.schema["of_scope"].dataType)
    total_of = lambda xs, c: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x[c])
    used = used.withColumn("of_scope", F.coalesce("of_scope", none)).withColumn("of_owner", F.coalesce("of_owner", none))
    used = used.withColumn("directs", total_of(F.col("of_owner"), "n_direct")).withColumn("owned", total_of(F.col("of_owner"), "n")).withColumn("inside", total_of(F.col("of_scope"), "n"))
    taken = lambda x, n, first: F.struct(x["kind"].alias("kind"), x["exact"].alias("exact"), x["suffix"].alias("suffix"), x[n].alias("n"), x[first].alias("first"))
    rest = F.struct(F.when(_said("service_name"), "local_service_name_mismatch").alias("kind"), no.alias("exact"), no.alias("suffix"), (F.col("total") - F.col("inside")).alias("n"), F.col("sole").alias("first"))
    plain_ = F.concat(F.transform("of_scope", lambda x: taken(x, "n", "first")), F.array(rest))
    owned_ = F.when(F.col("directs") > 0, F.transform("of_owner", lambda x: taken(x, "n_direct", "first_direct"))).when(F.col("owned") == 1, F.transform("of_owner", lambda x: taken(x, "n", "first")))
    used = used.withColumn("classes", F.filter(F.when(F.col("by_owner"), owned_).when(F.col("total").isNotNull(), plain_), lambda x: x["n"] > 0))
    used = used.withColumn("n", total_of(F.col("classes"), "n")).withColumn("n_suffix", F.aggregate("classes", F.lit(0).cast("long"), lambda n, x: F.when(x["suffix"], n + x["n"]).otherwise(n)))

    by_name = lambda k: F.when(k.isNull(), 0.0).when(k == "exact_local_qualified_service_name", QUALIFIED).when(k == "exact_local_simple_service_name", SIMPLE).when(k == "exact_local_service_path", BY_PATH).when(k == "suffix_local_service_path", F.when(F.col("n_suffix") == 1, SUFFIX_ONE).otherwise(SUFFIX_MANY)).otherwise(0.0)
    recovered = lambda x: F.col("repo_id").isNotNull() & (F.col("n") == 1) & F.coalesce(x["kind"] == "local_service_name_mismatch", no)

    def score(x: Column) -> Column:
        s = F.when(F.col("by_owner"), OWNED_BASE).otherwise(BASE) + F.when(_said("service_path"), F.when(x["exact"], PATH_EXACT).otherwise(PATH_OTHER)).otherwise(0.0)
        s = s + by_name(x["kind"]) + F.when(F.col("override"), OVERRIDE).otherwise(0.0)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(recovered(x), F.greatest(s, F.lit(RECOVERED))).otherwise(s)))

    # of equal scores the least operation; operations without a word in common with the call score less than all others
    ranked = F.array_sort(F.transform("classes", lambda x: F.struct((-score(x)).alias("down"), x["first"].alias("first"), x["n"].alias("n"), x["kind"].alias("kind"), x["exact"].alias("exact"), recovered(x).alias("recovered"))))
    used = used.withColumn("ranked", ranked).withColumn("b", F.get("ranked", F.lit(0)))
    used = used.withColumn("score", -F.col("b.down")).withColumn("second", F.when(F.col("b.n") > 1, F.col("score")).otherwise(-F.get("ranked", F.lit(1))["down"])).withColumn("operation_id", F.col("b.first.operation_id"))
    reasons = F.array_compact(F.array(
        F.lit("operation_path_match"), F.when(F.col("by_owner"), "implementation_context_caller_ownership"), F.when(_said("service_path"), F.when(F.col("b.exact"), "exact_service_path").otherwise("service_path_mismatch")), F.col("b.kind"),
        F.when(F.col("override"), F.when(F.col("repo_id").isNotNull(), "explicit_local_service_call").otherwise("explicit_dynamic_override")), F.when(F.col("b.recovered"), "same_repo_unique_operation_path_with_lookup_mismatch"),
    ))
    fits = F.col("b.exact") | (_said("service_name") & ((F.col("b.kind") != "local_service_name_mismatch") | F.col("b.recovered")))
    told = used.withColumn("why", reasons).withColumn("fits", F.coalesce(fits, no))
    n, met_n, none_met = F.coalesce("n", F.lit(0)), F.coalesce("met", F.lit(0)), F.coalesce("matches", F.lit(0)) == 0
    early, open_ = F.size("missing") > 0, F.coalesce("is_dynamic", no) & ~F.col("override") & ~_said("service_path")
    strong = _said("service_path") | _said("service_name") | _said("alias") | _said("destination") | F.col("override")
    lead = F.col("score") - F.col("second")
    resolved = (F.col("score") >= LEAST_SCORE) & F.col("fits") & F.coalesce(lead >= LEAST_LEAD, F.lit(True))
    of_many = F.when(n > 1, "ambiguous").otherwise("unresolved")
    wants_owner = F.col("repo_id").isNotNull() & _said("service_name")
    one = lambda text: F.array(F.lit(text))
    status = F.when(early, "dynamic").when(~_said("operation_path") | (n == 0), "unresolved").when(open_, "dynamic").when(~strong, of_many).when(resolved, "resolved").otherwise(of_many)
    why = (
        F.when(early, F.transform("missing", lambda k: F.concat(F.lit("missing_variable:"), k))).when(~_said("operation_path"), one("missing_operation_path"))
        .when((n == 0) & wants_owner & ~none_met, one("local_service_candidate_without_caller_ownership")).when(n == 0, one("no_operation_candidates"))
        .when(open_, one("dynamic_target_without_override")).when(~strong, one("operation_path_only_has_no_strong_target_signal"))
        .when(resolved, F.col("why")).otherwise(one("candidate_score_below_resolution_threshold"))
    )
    listed = F.when(early, met_n).when((n == 0) & wants_owner, F.coalesce("matches", F.lit(0))).otherwise(n)
    told = told.select(
        "sid", status.alias("status"), F.when(status == "resolved", F.col("operation_id")).alias("operation_id"), listed.cast("long").alias("candidates"),
        F.when(early, None).otherwise(F.col("score")).alias("score"), F.when(early, None).otherwise(lead).alias("lead"), why.alias("reasons"),
    )
    return named.select("id", "sid").join(told, "sid").drop("sid")
