"""A few rows of each group, without gathering the group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_few(rows: DataFrame, group: str, item: str, most: int, total: str, shown: str) -> DataFrame:
    """(group, total, shown): how many rows a group has, and its `most` least items in order, joined by commas.

    Ranks are cut before anything is gathered, already where the rows are read, so a group of
    any size sends few rows. Null items count, but are not shown; a group of nulls shows ''.
    """
    counts = rows.groupBy(F.col(group).alias("of")).agg(F.count("*").alias(total))
    least = Window.partitionBy(group).orderBy(item)
    few = rows.where(F.col(item).isNotNull()).select(group, item, F.row_number().over(least).alias("k")).where(F.col("k") <= most)
    few = few.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(item)).cast("array<string>"), ",").alias(shown))
    found = counts.join(few, F.col("of").eqNullSafe(F.col(group)), "left")
    return found.select(F.col("of").alias(group), total, F.coalesce(shown, F.lit("")).alias(shown))


def sole_least(rows: DataFrame, group: str, by: str, item: str, owner: str, ambiguous: str) -> DataFrame:
    """(group, owner, ambiguous): the item of the row with the least `by`, null where several rows have it.

    Rows with a null `by` take no part, groups of none but those give no row.
    """
    ties = rows.where(F.col(by).isNotNull()).groupBy(group, by).agg(F.count("*").alias("n"), F.min(item).alias("item"))
    best = ties.groupBy(group).agg(F.min_by(F.struct("n", "item"), by).alias("b"))
    return best.select(group, F.when(F.col("b.n") == 1, F.col("b.item")).alias(owner), (F.col("b.n") > 1).alias(ambiguous))
