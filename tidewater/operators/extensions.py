"""Services that extend others: which service they build on, and the operations that they inherit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an inherited operation takes from the base's.
COPIED = ["type", "params", "returns", "file", "line"]


def module_path(source_file: Column, specifier: Column) -> Column:
    """A relative specifier seen from a file, without `.`, `..` and a last `.cds`; `..` above the top is dropped."""
    steps = F.concat(F.slice(F.split(source_file, "/"), F.lit(1), F.size(F.split(source_file, "/")) - 1), F.split(specifier, "/"))
    none = F.array().cast("array<string>")
    up = lambda a: F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(none)
    kept = F.aggregate(steps, none, lambda a, s: F.when(s.isin("", "."), a).when(s == "..", up(a)).otherwise(F.concat(a, F.array(s))))
    return F.regexp_replace(F.array_join(kept, "/"), r"\.cds\z", "")


def package_name(specifier: Column) -> Column:
    """The package of a specifier: its first part, with a scope its first two."""
    return F.regexp_extract(specifier, r"\A(@[^/]*/[^/]*|[^/]*)", 1)


def bases(services: DataFrame) -> DataFrame:
    """services(service_id, repo_id, package_name, service_name, qualified_name, source_file, is_extend,
    module_specifier, imported_symbol, import_kind) -> (service_id, status, base_id) of each that extends.

    The symbol (or else the service's own name) is looked for among the names and qualified
    names of services that extend nothing: with import kind `relative` in the file that the
    specifier leads to (with or without `.cds`), with `package` in that package and, if the
    specifier goes on, in that file, else in the same repository. One found is resolved, several
    are ambiguous, none unresolved. As bases extend nothing themselves, there are no chains and
    no cycles. service_ids are unique; a null name, package or file fits nothing.

    Bases are counted by each way to look for them, so an extension meets one or two rows.
    """
    plain = services.where(~F.coalesce("is_extend", F.lit(False)))
    names = F.array_distinct(F.array_compact(F.array("qualified_name", "service_name")))
    way = lambda scope, owner, file: F.struct(F.lit(scope).alias("scope"), owner.cast("string").alias("owner"), file.isNotNull().alias("in_file"), F.coalesce(file, F.lit("")).alias("file"))
    anywhere, file = F.lit(None).cast("string"), F.col("source_file")
    ways = F.array_distinct(F.array(way("repo", F.col("repo_id"), anywhere), way("repo", F.col("repo_id"), file), way("package", F.col("package_name"), anywhere), way("package", F.col("package_name"), file)))
    key = ["scope", "owner", "in_file", "file", "symbol"]
    index = plain.select("service_id", F.explode(names).alias("symbol"), ways.alias("ways")).select("service_id", "symbol", F.inline("ways"))
    index = index.where("owner is not null").groupBy(*key).agg(F.count("*").alias("n"), F.min("service_id").alias("base_id"))

    spec = F.col("module_specifier")
    path, package = module_path(F.coalesce(file, F.lit("")), spec), package_name(spec)
    inner = F.regexp_replace(F.substr(spec, F.length(package) + 1), r"\A/", "")
    both = lambda scope, owner, p: F.array(way(scope, owner, p), way(scope, owner, F.concat(p, F.lit(".cds"))))
    given = F.coalesce(spec, F.lit("")) != ""
    asked = F.when(given & (F.col("import_kind") == "relative"), both("repo", F.col("repo_id"), path))
    asked = asked.when(given & (F.col("import_kind") == "package"), F.when(inner == "", F.array(way("package", package, anywhere))).otherwise(both("package", package, inner)))
    asked = asked.otherwise(F.array(way("repo", F.col("repo_id"), anywhere)))
    extending = services.where("is_extend").select("service_id", F.coalesce("imported_symbol", "service_name").alias("symbol"), F.inline(asked))
    found = extending.join(index, key, "left").groupBy(extending.service_id).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("base_id").alias("base_id"))
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return found.select("service_id", status.alias("status"), F.when(F.col("n") == 1, F.col("base_id")).alias("base_id"))


def inherited(found: DataFrame, operations: DataFrame) -> DataFrame:
    """found(service_id, base_id), operations(operation_id, service_id, name, path, COPIED..., provenance, base_operation_id)
    -> (service_id, name, path, action, operation_id, base_operation_id).

    An extension inherits the direct operations of its base that it has none of the same name
    and path for. Against the inherited operations that are stored, actions are add, update
    (something in COPIED or the base operation differs), keep, and delete for those that are no
    longer inherited. Of stored ones of one name and path the latest (largest operation_id) is
    compared, the others are left alone. Names and paths are not null.
    """
    key = ["service_id", "name", "path"]
    direct, stored = operations.where("provenance = 'direct'"), operations.where("provenance = 'inherited'").join(found.select("service_id"), "service_id", "left_semi")
    offered = direct.select(F.col("service_id").alias("base_id"), "operation_id", "name", "path", *COPIED)
    desired = found.where("base_id is not null").select("service_id", "base_id").join(offered, "base_id").drop("base_id").join(direct.select(*key), key, "left_anti")
    latest = stored.groupBy(*key).agg(F.max(F.struct("operation_id", F.struct(*COPIED, F.col("base_operation_id").alias("of")).alias("was"))).alias("s"))
    same = F.col("s.was").eqNullSafe(F.struct(*COPIED, F.col("operation_id").alias("of")))
    action = F.when(F.col("s").isNull(), "add").when(same, "keep").otherwise("update")
    put = desired.join(latest, key, "left").select(*key, action.alias("action"), F.col("s.operation_id").alias("operation_id"), F.col("operation_id").alias("base_operation_id"))
    gone = stored.join(desired.select(*key), key, "left_anti").select(*key, F.lit("delete").alias("action"), "operation_id", "base_operation_id")
    return put.unionByName(gone)
