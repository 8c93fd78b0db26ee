"""What tells rows apart where a doc_id may repeat or be null, and bounds on what is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a few numbers each that are broadcast; larger tables are joined by shuffle.
MAX_BROADCAST_ROWS = 1_000_000


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of doc_id and text together: rows with the same key are repeats of one row."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.md5(F.concat(part(doc_id.cast("string")), part(text)).cast("binary")))


def small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast where the counted rows, of a few numbers each, allow it; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def long_ids(df: DataFrame, column: str) -> Column:
    """The column as long; a clear error where it is no whole number, which packed ids and their order ask for."""
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} must be a whole number of 64 bits at most, not {kind}: map other ids to numbers first")
    return F.col(column).cast("long").alias(column)
