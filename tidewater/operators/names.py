"""Dotted names: which definition a shortened name means, and who refers to a definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tails(name: Column) -> Column:
    """What follows each dot of a name, longest first: a.b.c has b.c and c."""
    parts = F.split(name, r"\.")
    rest = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(F.size(parts) > 1, rest).otherwise(F.array().cast("array<string>"))


def _known(definitions: DataFrame) -> DataFrame:
    return definitions.where("name is not null").groupBy("name").agg(F.min(F.struct("package", "kind")).alias("d")).select("name", "d.package", "d.kind")


def resolve(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """refs(target, package, ...), definitions(name, package, kind) -> refs with found_name, found_kind, status, tier.

    A target means the definition of that name (tier exact), else the only one whose name ends
    in `.target` (suffix), else the only such one of the reference's own package (package).
    status is resolved, missing if no name fits, and ambiguous. Names are told by definitions'
    `name`: repeated rows of it are one, with the least package and kind. A null target is
    missing; a null package has no third tier.

    Names meet by equality of their tails with the distinct targets, and candidates are counted
    by target and package, so that a target of any number of references or candidates never
    forms pairs. Only the last join carries all references.
    """
    asked = refs.where("target is not null").select("target", "package").distinct()
    targets = asked.select("target").distinct()
    known = _known(definitions)
    exact = known.select(F.col("name").alias("target"), F.struct("name", "kind").alias("exact"))
    fits = known.select("package", F.struct("name", "kind").alias("d"), F.explode(tails(F.col("name"))).alias("target")).join(targets, "target", "left_semi")
    near = fits.groupBy("target", "package").agg(F.count("*").alias("near"), F.min("d").alias("near_one"))
    far = near.groupBy("target").agg(F.sum("near").alias("far"), F.min("near_one").alias("far_one"))
    told = asked.join(exact, "target", "left").join(far, "target", "left").join(near.where("package is not null and near = 1"), ["target", "package"], "left")
    tier = F.when(F.col("exact").isNotNull(), "exact").when(F.col("far") == 1, "suffix").when((F.col("far") > 1) & (F.col("near") == 1), "package")
    found = F.when(tier == "exact", F.col("exact")).when(tier == "suffix", F.col("far_one")).when(tier == "package", F.col("near_one"))
    told = told.select(F.col("target").alias("_target"), F.col("package").alias("_package"), found.alias("_found"), tier.alias("tier"), F.col("far").isNotNull().alias("_any"))
    met = refs.join(told, (F.col("target") == F.col("_target")) & F.col("package").eqNullSafe(F.col("_package")), "left")
    status = F.when(F.col("tier").isNotNull(), "resolved").when(F.col("_any"), "ambiguous").otherwise("missing")
    return met.select(*(refs[c] for c in refs.columns), F.col("_found.name").alias("found_name"), F.col("_found.kind").alias("found_kind"), status.alias("status"), "tier")


def incoming(refs: DataFrame, definitions: DataFrame, entities: DataFrame) -> DataFrame:
    """refs(source, field, kind, target, package), entities(entity) -> (entity, source, field, via_type, status).

    Who refers to an entity by an association, by the type of a field (only if the name means a
    definition of kind `type`; built-in `cds.` types refer to nothing) or by a projection
    (kind projection, reported once a source as field `(projection)`). An entity without a dot
    means all definitions of that name or ending in it; with a dot the exact one goes first.
    An entity that no definition fits gives one row of status unknown_entity, one that nobody
    refers to gives none.
    """
    known = _known(definitions).select("name")
    asked = entities.where("entity is not null").select("entity").distinct()
    exact = asked.join(known, asked.entity == known.name)
    fits = known.select("name", F.explode(tails(F.col("name"))).alias("entity")).join(asked, "entity", "left_semi").select("entity", "name")
    dotted = F.contains("entity", F.lit("."))
    wanted = exact.unionByName(fits.where(~dotted)).unionByName(fits.where(dotted).join(exact, "entity", "left_anti"))
    meant = refs.where("kind in ('association', 'type', 'projection')").where((F.col("kind") != "type") | ~F.startswith("target", F.lit("cds.")))
    meant = resolve(meant.select("source", "field", "kind", "target", "package"), definitions).where("status = 'resolved' and (kind <> 'type' or found_kind = 'type')")
    field = F.when(F.col("kind") == "projection", "(projection)").otherwise(F.col("field"))
    shown = meant.select("source", field.alias("field"), (F.col("kind") == "type").alias("via_type"), F.col("found_name").alias("name"))
    told = wanted.join(shown, "name").select("entity", "source", "field", "via_type").distinct().withColumn("status", F.lit("reference"))
    unknown = asked.join(wanted, "entity", "left_anti").select("entity", *(F.lit(None).cast(k).alias(c) for c, k in (("source", "string"), ("field", "string"), ("via_type", "boolean"))), F.lit("unknown_entity").alias("status"))
    return told.unionByName(unknown)
