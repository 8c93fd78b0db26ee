"""Bounded samples of labelled documents to fit a classifier on, and the folds that are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text modulo the number of folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


#: Most bytes of text of each class that a sample holds.
MOST_BYTES = (5 << 20, 2 << 20)


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: tuple[int, int], most_bytes: tuple[int, int] = MOST_BYTES) -> DataFrame:
    """(label, text) of `most` different labelled texts of the classes 0 and 1 at most, and of `most_bytes` in all.

    A document is used if its labels agree; `train` says, from doc_id, which may be used. Of
    each class `most` ids are looked at, in order of a hash; their texts are taken in order of
    a hash of id and text, each once however many rows have it, and one that would exceed the
    bytes is passed over. Null texts are not used. The bounds hold for any rows:
    what goes through the driver are the sizes of `most` texts, and the sample's features.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(train)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top").drop("top")
    some = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[c]) for c in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id").where("text is not null")
    keyed = rows.select("label", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), F.xxhash64("doc_id", "text").alias("at"), F.octet_length("text").alias("bytes"))
    texts = keyed.groupBy("label", "k1", "k2").agg(F.min("at").alias("at"), F.max("bytes").alias("bytes"))
    chosen = []
    for c in (0, 1):
        room = most_bytes[c]
        for r in texts.where(F.col("label") == c).orderBy("at", "k1", "k2").limit(most[c]).collect():
            if r["bytes"] <= room:
                room -= r["bytes"]
                chosen.append((c, r["k1"], r["k2"]))
    taken = F.broadcast(spark.createDataFrame(chosen, "label int, k1 long, k2 int"))
    found = rows.select("label", "text", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2")).join(taken, ["label", "k1", "k2"])
    return found.dropDuplicates(["label", "k1", "k2"]).select("label", "text")
