"""The corpus pipeline: quality, toxicity, near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the
stage before it kept. `run` writes each stage's rows as Parquet in the shared folder and
reads them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, decontaminate, near_duplicates, quality, toxicity
from tidewater.llm.labelled import fold
from tidewater.llm.vocabulary import VOCABULARY
from tidewater.session import Scratch, table


def _filtered(docs: DataFrame, keep: Callable) -> DataFrame:
    """Rows that `keep` lets through, by their text; columns of any names stay as they are."""
    plain = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out documents that the quality classifier, fitted on this stage's labelled documents, holds for bad."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return _filtered(docs, quality.keeper(model))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out documents that the toxicity tagger, fitted on this stage's labelled documents, holds for toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return _filtered(docs, toxicity.keeper(model))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, with the least doc_id, of each group of near duplicates."""
    return near_duplicates.keep_one(docs, Scratch(spark, "pipeline-near"))


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "pipeline-leaks"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left, decodes it again, and gives sizes and digests by document."""
    return bpe.digests(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", no_leaks),
    ("tokens", token_ids),
]

#: Learned scores and BPE have no SQL form: tests hold the stages to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
