"""How five filters of documents act together, for every order in which they could run.

Words are exploded, counted by (document, word), then by document for totals and distincts.
These meet the flags that need no words by an outer join, every document becomes the set of
filters it fails (a number of five bits), and 32 conditional counts a part answer for all 120
orders: what a filter removes at its step depends on the set of filters before it alone.

A document is a row, known by 96 bits of its id and text; repeated rows share their words and
count each. A null text is empty. A null id is no smaller than any and none is smaller, so such
rows are never copies. Labels: good if a row of labels says quality 1, toxic if one says 1.
A null part is ''. A table without rows has no parts. Other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.session import Scratch

LETTERS = "ABCDE"
FEW_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 100, 80, 10
#: Groups of equal texts with more than this part of all rows are broadcast: there are fewer of them than this number.
HOT = 2000
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["k1", "k2"]


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select("doc_id", text.alias("text"), *more)
    return plain.select(F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"), "*")


def word_totals(docs: DataFrame) -> DataFrame:
    """(k1, k2, words, distinct), one row a key: texts are dealt by key once, and both aggregations stay where they are.

    Each row adds one empty word, which no text holds: its count tells how many equal rows there are.
    """
    dealt = _keyed(docs).select(*KEY, "text").repartition(*KEY)
    words = F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    per_word = dealt.select(*KEY, F.explode(words).alias("word")).groupBy(*KEY, "word").agg(F.count("*").alias("n"))
    is_word = F.col("word") != ""
    found = per_word.groupBy(*KEY).agg(
        F.coalesce(F.sum(F.when(is_word, F.col("n"))), F.lit(0)).alias("all"), F.max(F.when(~is_word, F.col("n"))).alias("rows"), F.count_if(is_word).alias("distinct"),
    )
    return found.select(*KEY, (F.col("all") / F.col("rows")).cast("long").alias("words"), "distinct")


def copies(rows: DataFrame, count: int) -> DataFrame:
    """Adds `copy`: whether a smaller doc_id has the same digest.

    Digests of very many rows are few and broadcast, so no task gets all rows of a large group.
    """
    met = rows.where("doc_id is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    hot = F.broadcast(met.where(F.col("n") * HOT > count).select("digest", F.col("least").alias("hot")))
    cold = met.where(F.col("n") * HOT <= count).select("digest", F.col("least").alias("cold"))
    near = rows.join(hot, "digest", "left")
    # rows of hot digests go nowhere: they look for a key of their own
    near = near.withColumn("look", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.unhex(F.md5(F.concat_ws(":", "k1", "k2").cast("binary")))))
    found = near.join(cold.withColumnRenamed("digest", "look"), "look", "left").drop("look")
    return found.withColumn("copy", F.coalesce(F.col("doc_id") > F.coalesce("hot", "cold"), F.lit(False))).drop("hot", "cold")


def failures(docs: DataFrame, labels: DataFrame, part: Column, scratch: Scratch) -> DataFrame:
    """(part, fails, good, toxic), one row a document; bit i of fails is set where it fails filter i of LETTERS."""
    text = F.col("text")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    flags = _keyed(docs, F.coalesce(part.cast("string"), F.lit("")).alias("part")).select(
        *KEY, "doc_id", "part", F.unhex(F.md5(text.cast("binary"))).alias("digest"), (capitals * 100 > F.length(text) * CAPITAL_SHARE).alias("C"), text.rlike(r"[#$%&*|]").alias("D"),
    )
    flags = scratch.keep(flags, "flags")
    said = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast(flags.schema["doc_id"].dataType).alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    rows = copies(flags, flags.count()).join(known, "doc_id", "left").join(word_totals(docs), KEY, "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct", F.lit(0))
    failing = [words < FEW_WORDS, distinct * 100 < words * DISTINCT_SHARE, F.col("C"), F.col("D"), F.col("copy")]
    fails = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failing)), F.lit(0))
    return rows.select("part", fails.alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _bits(n: int) -> int:
    return bin(n).count("1")


def audit(docs: DataFrame, labels: DataFrame, part: Column, scratch: Scratch) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all 120 orders of five filters, step by step."""
    rows = failures(docs, labels, part, scratch)
    some = rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    sets = range(1 << len(LETTERS))
    counted = some.groupBy("part").agg(*(F.coalesce(F.sum(F.when(F.col("fails") == s, F.col(c))), F.lit(0)).alias(f"{c}_{s}") for c in ("n", "good", "toxic") for s in sets))
    arrays = [F.array(*(F.col(f"{c}_{s}") for s in sets)).alias(c) for c in ("n", "good", "toxic")]
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(LETTERS)))).alias("filter_order")
    steps = counted.select("part", *arrays).select("*", orders).select("*", F.explode(F.array(*map(F.lit, range(1, len(LETTERS) + 1)))).alias("step"))
    place = lambda i: F.instr("filter_order", LETTERS[i])
    earlier = sum((F.when(place(i) < F.col("step"), 1 << i).otherwise(0) for i in range(len(LETTERS))), F.lit(0))
    own = sum((F.when(place(i) == F.col("step"), 1 << i).otherwise(0) for i in range(len(LETTERS))), F.lit(0))
    steps = steps.withColumn("earlier", earlier).withColumn("own", own)

    def total(of: str, when) -> Column:
        """Sum of the counts of the sets for which `when` holds."""
        held = F.filter(F.sequence(F.lit(0), F.lit(len(sets) - 1)), when)
        return F.aggregate(held, F.lit(0).cast("long"), lambda a, s: a + F.get(F.col(of), s))

    before = lambda s: s.bitwiseAND(F.col("earlier")) != 0
    here = lambda s: s.bitwiseAND(F.col("own")) != 0
    removed = lambda s: here(s) & ~before(s)
    # a filter removes a document in the orders that put it before all others that the document fails
    share = F.array(*(F.lit(0 if s == 0 else 120 // _bits(s)) for s in sets))
    shapley = F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(len(sets) - 1)), here), F.lit(0).cast("long"), lambda a, s: a + F.get(F.col("n"), s) * F.get(share, s))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), total("n", lambda s: ~here(s) & ~before(s)).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda s: here(s) & before(s)).alias("redundant"), F.get("n", F.col("own")).alias("unique_fails"), total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"), shapley.alias("shapley"),
    )
