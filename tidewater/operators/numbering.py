"""Places of rows in an order over the whole table, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.session import Scratch


def number(rows: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with a column n, of any table size: their place in the order of `by`, from 0 and without gaps.

    Strings are ordered by their bytes, nulls come first. The columns `by` should tell rows
    apart: rows that are equal in all of them lie in one task, in any order.

    Ranges of the order are sorted each by itself and written to the shared folder; a range's
    first number is the sum of the sizes before it. Only these sizes, one for each range, are
    brought together.
    """
    order = [F.col(c).asc_nulls_first() for c in by]
    kept = scratch.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    # the upper bits are the range, the lower 33 the place in it
    placed = kept.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(first), "_range").select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_first") + F.col("_at")).alias("n"))
