"""Structured Streaming forms of the live log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream; new files are new rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def level_counts(rows: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """rows(at timestamp, app, level) -> counts by window, application and level.

    Rows later than `late` behind the newest are dropped and their windows' state is freed;
    rows without a time belong to no window.
    """
    timed = rows.where("at is not null").withWatermark("at", late)
    counts = timed.groupBy(F.window("at", window).alias("w"), "app", "level").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "app", "level", "n")


def fresh(rows: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Rows once for each (app, id), however often they arrive within the lateness."""
    return rows.where("at is not null").withWatermark("at", late).dropDuplicatesWithinWatermark(["app", "id"])


def active_sessions(rows: DataFrame, gap: str = "60 minutes", late: str = "60 minutes") -> DataFrame:
    """rows(at, app) -> sessions of an application: its rows less than `gap` apart."""
    timed = rows.where("at is not null").withWatermark("at", late)
    found = timed.groupBy(F.session_window("at", gap).alias("s"), "app").agg(F.count("*").alias("n"))
    return found.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "app", "n")


def to_folder(rows: DataFrame, path: str, checkpoint: str, by: list[str] | None = None, mode: str = "append") -> StreamingQuery:
    """Writes a stream as Parquet until all that is there is read; the checkpoint makes restarts exact."""
    out = rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (out.partitionBy(*by) if by else out).trigger(availableNow=True).start()
