"""Readers and writers of text logs, JSON records, CSV and Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.logs import is_system, parse_line


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, as file, line and the fields of header lines; blank and client lines are dropped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.where(~is_system(F.col("line"))).select("file", "line", *parse_line(F.col("line")))


def find_text(spark: SparkSession, path: str, text: str, most: int) -> DataFrame:
    """Lines that hold a fixed text, in all folders below; one more than `most` tells that there are more."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.where(F.contains("value", F.lit(text))).select(F.col("_metadata.file_path").alias("file"), "value").limit(most + 1)


def read_records(spark: SparkSession, path: str, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """JSON records by a fixed schema, absent texts to their defaults; records that are none are dropped."""
    rows = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.where("_corrupt is null").drop("_corrupt")
    return rows.fillna(defaults) if defaults else rows


def append_history(rows: DataFrame, path: str, day: str) -> None:
    """Appends JSON lines by day; whole days can be pruned."""
    rows.withColumn("day", F.date_format(day, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Quoted only where needed, quotes doubled, null to nothing."""
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def read_md_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of Markdown tables: cells between bars, escaped bars kept; heads, rules and rows of another width are dropped."""
    lines = spark.read.text(path).where(F.trim("value").rlike(r"^\|.*\|$"))
    inner = F.regexp_replace(F.trim("value"), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.regexp_replace(F.trim(c), r"\\\|", "|"))
    rows = lines.select(cells.alias("c")).where(F.size("c") == len(names)).where(~F.get("c", F.lit(0)).rlike(r"^:?-+:?$"))
    return rows.where(F.get("c", F.lit(0)) != names[0]).select(*(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)))
