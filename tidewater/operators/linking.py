"""Links between repositories and their packages, scores of implementations, patterns of paths, states of work trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import common_prefix

#: What each sign of ownership adds to an implementation's score.
SIGNS = {
    "model_is_application": 100, "model_is_handler": 100, "local_service_path": 80, "application_needs_model": 70,
    "application_needs_handler": 30, "handler_needs_model": 20, "helper_owned": 60, "imports_handler": 10,
}


def plain_name(name: Column) -> Column:
    """Lower case, without the scope, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "^@[^/]+/", ""), "[^a-z0-9]+", "")


def dependency_edges(repos: DataFrame, dependencies: DataFrame) -> DataFrame:
    """repos(id, name, package_name), dependencies(id, dependency) -> (id, dependency, match, candidates, status, to_id, confidence).

    Candidates are the other repositories of exactly this package name, else those whose plain
    name is the dependency's. One candidate resolves the edge (1.0), more leave it ambiguous
    (0.5, to_id null), none gives no row. Ids are unique; rows with null ids or dependencies
    match nothing. Names are counted before the joins, so a name that very many repositories
    share costs one row.
    """

    def named(key: Column, as_: str) -> DataFrame:
        # all that is needed to leave out the asking repository: how many there are, and the two ends
        return repos.select(key.alias(as_), "id").where(F.col(as_).isNotNull()).groupBy(as_).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))

    own = repos.select("id", F.col("package_name").alias("own_package"), plain_name(F.col("name")).alias("own_name"))
    asked = dependencies.where("dependency is not null").select("id", "dependency").distinct().withColumn("plain", plain_name(F.col("dependency"))).join(own, "id")

    def tier(rows: DataFrame, key: str, own_key: str, label: str) -> DataFrame:
        mine = F.coalesce(F.col(own_key) == F.col(key), F.lit(False))
        n = F.coalesce("n", F.lit(0)) - mine.cast("int")
        other = F.when(mine & (F.col("lo") == F.col("id")), F.col("hi")).otherwise(F.col("lo"))
        return rows.withColumn(f"{label}_n", n).withColumn(f"{label}_to", other).drop("n", "lo", "hi")

    rows = tier(asked.join(named(F.col("package_name"), "dependency"), "dependency", "left"), "dependency", "own_package", "exact")
    rows = tier(rows.join(named(plain_name(F.col("name")), "plain"), "plain", "left"), "plain", "own_name", "near")
    exact = F.col("exact_n") > 0
    rows = rows.select(
        "id", "dependency", F.when(exact, "exact_package_name").otherwise("normalized_directory").alias("match"),
        F.when(exact, F.col("exact_n")).otherwise(F.col("near_n")).cast("long").alias("candidates"), F.when(exact, F.col("exact_to")).otherwise(F.col("near_to")).alias("to"),
    ).where("candidates > 0")
    one = F.col("candidates") == 1
    return rows.select(
        "id", "dependency", "match", "candidates", F.when(one, "resolved").otherwise("ambiguous").alias("status"),
        F.when(one, F.col("to")).alias("to_id"), F.when(one, 1.0).otherwise(0.5).alias("confidence"),
    )


def implementation_scores(candidates: DataFrame) -> DataFrame:
    """Adds score, has_ownership and accepted to candidates with the boolean columns of the rule.

    Columns: those of SIGNS but helper_owned, and db_model, has_local_services,
    has_local_registration, same_repo_registration, method_matches, method_contradicted.
    Null counts as false.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    direct = yes("model_is_application") | yes("model_is_handler")
    helper = (
        (yes("db_model") | ~yes("has_local_registration")) & yes("method_matches") & yes("same_repo_registration") & yes("imports_handler") & ~yes("has_local_services") & ~direct
        & ~yes("local_service_path") & ~yes("application_needs_model") & ~yes("application_needs_handler") & ~yes("handler_needs_model")
    )
    across = yes("application_needs_model") & (yes("model_is_handler") | yes("application_needs_handler") | ~yes("imports_handler"))
    contradicted = yes("has_local_services") & ~yes("local_service_path") & ~yes("application_needs_model") & ~direct
    signs = {c: helper if c == "helper_owned" else yes(c) for c in SIGNS}
    score = sum((F.when(signs[c], n).otherwise(0) for c, n in SIGNS.items()), F.lit(0))
    owned = direct | yes("local_service_path") | across | yes("handler_needs_model") | helper
    accepted = yes("method_matches") & ~yes("method_contradicted") & ~contradicted & owned
    return candidates.select("*", score.alias("score"), owned.alias("has_ownership"), accepted.alias("accepted"))


def implementation_decisions(scored: DataFrame, operation: str) -> DataFrame:
    """One row per operation: candidates, accepted, top score, winners, and resolved, ambiguous or unresolved.

    Families of packages of the same name are not looked at. Candidates are counted by score
    first, so an operation with very many of them is no hot group.
    """
    by_score = scored.groupBy(operation, F.when(F.col("accepted"), F.col("score")).alias("score")).agg(F.count("*").alias("n"))
    kept = F.col("score").isNotNull()
    told = by_score.groupBy(operation).agg(
        F.sum("n").alias("candidates"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("accepted"),
        F.coalesce(F.max("score"), F.lit(0)).alias("top_score"), F.coalesce(F.max_by("n", "score"), F.lit(0)).alias("winners"),
    )
    told = told.withColumn("winners", F.when(F.col("accepted") == 0, F.lit(0)).otherwise(F.col("winners")).cast("long"))
    return told.withColumn("status", F.when(F.col("winners") == 1, "resolved").when(F.col("winners") > 1, "ambiguous").otherwise("unresolved"))


def path_patterns(paths: DataFrame, group: str) -> DataFrame:
    """paths(group, path) -> (group, pattern): the one path, or what all begin with, '*', and what the rest ends with.

    Null and empty paths don't count; a group without others has the pattern ''. Only least and
    greatest texts are gathered: what these two begin with, all do.
    """
    some = paths.select(F.col(group).alias("of"), F.nullif("path", F.lit("")).alias("path"))
    ends = some.groupBy(F.col("of").alias("whose")).agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    ends = ends.withColumn("prefix", common_prefix(F.col("lo"), F.col("hi")))
    rest = some.where("path is not null").join(ends, F.col("of").eqNullSafe(F.col("whose")))
    turned = rest.select("of", F.reverse(F.substring(F.col("path"), F.length("prefix") + 1, F.length("path"))).alias("r"))
    tails = turned.groupBy("of").agg(F.min("r").alias("a"), F.max("r").alias("b"))
    found = ends.join(tails, F.col("of").eqNullSafe(F.col("whose")), "left")
    pattern = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.concat("prefix", F.lit("*"), F.reverse(common_prefix(F.col("a"), F.col("b")))))
    return found.select(F.col("whose").alias(group), F.coalesce(pattern, F.lit("")).alias("pattern"))


def work_tree_states(lines: DataFrame, group: str) -> DataFrame:
    """lines(group, pos, line) of `status --porcelain=v2` -> one row per group: branch, branch_status, staged, unstaged, untracked, ahead, behind."""
    line = F.col("line")
    head, counts = F.startswith(line, F.lit("# branch.head ")), F.startswith(line, F.lit("# branch.ab ")) & line.rlike(r"\+[0-9]+ -[0-9]+")
    entry = F.startswith(line, F.lit("1 ")) | F.startswith(line, F.lit("2 "))
    changed = lambda at: entry & (F.length(F.substring(line, at, 1)) > 0) & ~F.substring(line, at, 1).isin(".", "?")
    last = lambda value, when: F.max_by(value, F.when(when, F.col("pos")))
    number = lambda g: F.regexp_extract(line, r"\+([0-9]+) -([0-9]+)", g).try_cast("int")
    some = lambda when: F.coalesce(F.bool_or(when), F.lit(False))
    found = lines.groupBy(group).agg(
        F.coalesce(last(F.trim(F.substring(line, 15, 1 << 30)), head), F.lit("HEAD")).alias("branch"), some(F.startswith(line, F.lit("# branch.upstream "))).alias("followed"),
        F.coalesce(last(number(1), counts), F.lit(0)).alias("ahead"), F.coalesce(last(number(2), counts), F.lit(0)).alias("behind"),
        some(changed(3)).alias("staged"), some(changed(4)).alias("unstaged"), some(F.startswith(line, F.lit("? "))).alias("untracked"),
    )
    status = F.when(~F.col("followed"), "no_remote").when((F.col("ahead") > 0) & (F.col("behind") > 0), "diverged").when(F.col("ahead") > 0, "ahead").when(F.col("behind") > 0, "behind").otherwise("in_sync")
    return found.select(group, "branch", status.alias("branch_status"), "staged", "unstaged", "untracked", "ahead", "behind")
