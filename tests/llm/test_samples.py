"""Bounds of labelled samples, and ids that packed formats can't take."""

import pytest
from pyspark.sql import functions as F

from tidewater.llm import labelled, token_files, vector_search
from tidewater.llm.vocabulary import VOCABULARY
from tidewater.session import Scratch


def test_one_id_on_many_rows(spark):
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = rows.union(spark.createDataFrame([(8, "same"), (9, None)], "doc_id long, text string")).union(spark.range(3000).select(F.lit(8).cast("long"), F.lit("same")))
    labels = spark.createDataFrame([(7, 0, "x"), (8, 1, "y"), (9, 1, "z"), (None, 1, "n")], "doc_id long, quality int, text string")
    got = labelled.sample(rows, labels, "quality", F.lit(True), (10, 10)).collect()
    assert sum(r["label"] == 0 for r in got) == 10 and [r["text"] for r in got if r["label"] == 1] == ["same"]
    assert labelled.sample(rows, labels.limit(0), "quality", F.lit(True), (10, 10)).count() == 0


def test_long_texts_are_bounded_by_bytes(spark):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id"), F.repeat(F.lit("é"), 5000)).alias("text"))
    rows = rows.union(spark.createDataFrame([(100, "x" * 90_000), (101, "short")], "doc_id long, text string"))
    labels = rows.select("doc_id", F.lit(0).alias("quality"))
    got = labelled.sample(rows, labels, "quality", F.lit(True), (60, 60), (60_000, 60_000)).collect()
    assert 50_000 <= sum(len(r["text"].encode()) for r in got) <= 60_000 and "short" in {r["text"] for r in got}


def test_text_ids_are_a_clear_error(spark, tmp_path):
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    with pytest.raises(TypeError, match="doc_id must be a whole number"):
        token_files.write(docs, VOCABULARY, str(tmp_path / "out"), Scratch(spark, "t"))
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "vec_id string, embedding array<float>")
    with pytest.raises(TypeError, match="vec_id must be a whole number"):
        vector_search.top_k(vectors, F.lit(True), Scratch(spark, "t"))
