"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Words are the lower-cased runs of letters and digits; shingles are five words in a row and
weigh as often as they occur. A document is contaminated by an item if one of its windows
of the item's size has a weighted Jaccard similarity to the item of `threshold` or more.

* Which windows. A window can only reach the threshold if at least that share of its
  shingles occur in the benchmark, and of the windows that hold the same ones none is more
  similar than the one that begins with the first of them. So windows begin at benchmark
  shingles and hold enough of them; no other window can match, none is dropped by chance.
* SimHash. 64 bits; the 64 counters of a window are packed into 16 longs.
* Multi-index. `plan_radius` gives the distance that a pair at the threshold exceeds with
  a chance of at most `miss`; radius + 1 blocks of bits then guarantee (pigeonhole) that
  every pair within the radius agrees in a whole block. Blocks of two or three bits alone
  would select little, so a key is (length, block, its bits, anchor). Anchors of an item
  are its rarest shingles, so many that a window without any of them falls short of the
  threshold: a pair at the threshold shares an anchor, a pair within the radius a block.
* Every pair within the radius is then decided by its exact similarity.

Rows of documents are told apart by doc_id and text together.

All of it is DataFrame functions.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.rows import MAX_BROADCAST_ROWS, row_key, small
from tidewater.session import Scratch, columns_of

SIZE = 5
BITS = 64
#: Most numbers, in arrays, that are broadcast.
MAX_BROADCAST_NUMBERS = 2_000_000
#: Hits of a document whose windows are made from one row.
STARTS = 64


def plan_radius(threshold: float, miss: float) -> int:
    """The Hamming distance that fingerprints of two equally large shingle sets at the threshold exceed with chance `miss` at most."""
    cosine = 2 * threshold / (1 + threshold)
    p = math.acos(cosine) / math.pi
    tail, r = 1.0, -1
    while tail > miss:
        r += 1
        tail -= math.comb(BITS, r) * p**r * (1 - p) ** (BITS - r)
    return r


def block_masks(radius: int) -> list[int]:
    """radius + 1 masks that share the 64 bits out as evenly as can be."""
    n = radius + 1
    cuts = [round(k * BITS / n) for k in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often a lambda within uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles in order, repeats kept; empty for fewer than five words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def each(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - SIZE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SIZE))))

    return let(words, lambda w: F.when(F.size(w) >= SIZE, each(w)).otherwise(F.array().cast("array<long>")))


def _simhash(values: Column, width: int) -> Column:
    """simhash with the counters packed in lanes of so many bits."""
    lanes = 64 // width
    ones = F.lit(sum(1 << (width * k) for k in range(lanes)))
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda j: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.call_function("shiftrightunsigned", x, j).bitwiseAND(ones)),
    )

    def bits(counts: Column) -> Column:
        def add(acc: Column, b: Column) -> Column:
            count = F.call_function("shiftrightunsigned", F.get(counts, b % width), F.floor(b / width).cast("int") * width).bitwiseAND(F.lit((1 << width) - 1))
            return F.when(count * 2 > F.size(values), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), add)

    return let(sums, bits)


def simhash(values: Column) -> Column:
    """64-bit SimHash of an array of hashes, each as heavy as it is frequent; long arrays are counted in wider lanes."""
    return F.when(F.size(values) < 1 << 15, _simhash(values, 16)).otherwise(_simhash(values, 32))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays: shared occurrences over all occurrences."""
    shared = F.array_intersect(a, b)
    repeats = F.aggregate(
        shared,
        F.lit(0),
        lambda acc, x: acc + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))),
    )
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return let(F.when(plain, F.size(shared)).otherwise(repeats), lambda both: both / (F.size(a) + F.size(b) - both))


def _few(df: DataFrame, numbers: Column) -> DataFrame:
    """Broadcast where all its arrays together hold few enough numbers; else left to a shuffled join."""
    return F.broadcast(df) if (df.agg(F.sum(numbers)).first()[0] or 0) <= MAX_BROADCAST_NUMBERS else df


def _anchored(items: DataFrame, threshold: float) -> DataFrame:
    """items(no, item, len) -> (h, lens, anchors): lengths of the items that hold a shingle, and of those whose anchor it is."""
    each = items.select("no", "len", F.explode("item").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct("n", "h")))  # as many as one item has shingles
    ranked = each.join(often, "h").groupBy("no", "len").agg(order.alias("o"))
    spare = F.col("len") - F.ceil(F.lit(threshold) * F.col("len") - 1e-9) + 1
    anchors = F.array_distinct(F.slice(F.transform("o", lambda x: x["h"]), F.lit(1), spare.cast("int")))
    marks = ranked.select("len", F.explode(F.array_distinct(F.transform("o", lambda x: x["h"]))).alias("h"), anchors.alias("a"))
    marks = marks.select("h", "len", F.array_contains("a", F.col("h")).alias("anchor"))
    return marks.groupBy("h").agg(F.collect_set("len").alias("lens"), F.collect_set(F.when(F.col("anchor"), F.col("len"))).alias("anchors"))


def _windows(found: DataFrame, longest: int, threshold: float) -> DataFrame:
    """found(key, doc_id, hits, hs) -> (key, doc_id, start, len, anchors, window) of windows that can reach the threshold.

    A row goes on as runs of STARTS hits, each with just the hits and shingles that windows of
    `longest` at most reach from there, so what a document takes grows with its length alone.
    """
    n = F.size("hits")

    def run(j: Column) -> Column:
        first, last = F.get("hits", j * STARTS)["pos"], F.get("hits", F.least((j + 1) * STARTS, n) - 1)["pos"]
        return F.struct(first.alias("base"), F.slice("hs", first + 1, last - first + longest).alias("hs"), F.slice("hits", j * STARTS + 1, F.lit(STARTS + longest)).alias("hits"))

    runs = found.select("key", "doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STARTS).cast("int")), run)).alias("run")).select("key", "doc_id", "run.*")

    def begun(hit: Column, i: Column) -> Column:
        def enough(size: Column) -> Column:
            least = F.ceil(F.lit(threshold) * size - 1e-9).cast("int")
            return F.get("hits", i + least - 1)["pos"] <= hit["pos"] + size - 1

        def window(size: Column) -> Column:
            inside = F.filter(F.slice("hits", i + 1, size), lambda x: (x["pos"] < hit["pos"] + size) & F.array_contains(x["anchors"], size))
            anchors = F.array_distinct(F.transform(inside, lambda x: x["h"]))
            return F.struct(hit["pos"].alias("start"), size.alias("len"), anchors.alias("anchors"), F.slice("hs", hit["pos"] - F.col("base") + 1, size).alias("window"))

        return F.transform(F.filter(hit["lens"], enough), window)

    each = F.filter(F.flatten(F.transform(F.slice("hits", 1, STARTS), begun)), lambda w: F.size(w["anchors"]) > 0)
    return runs.select("key", "doc_id", F.explode(each).alias("w")).select("key", "doc_id", "w.*")


def _leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, threshold: float, miss: float) -> DataFrame:
    """(key, doc_id, item_id, start, similarity) of contaminated pairs of a document row and an item."""
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = benchmark.where("item_id is not null").select("item_id", shingles(F.col("text")).alias("item")).where("size(item) > 0")
    items = scratch.keep(items.repartition(spread).withColumn("len", F.size("item")).withColumn("no", F.monotonically_increasing_id()), "items")
    known = scratch.keep(_anchored(items, threshold), "known")
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")
    hits = (
        keyed.select("key", F.posexplode(shingles(F.col("text"))).alias("pos", "h"))
        .join(small(known.select("h"), 4 * MAX_BROADCAST_ROWS), "h", "left_semi")
        .join(_few(known, F.size("lens") + F.size("anchors") + 1), "h").select("key", F.struct("pos", "h", "lens", "anchors").alias("hit"))
    )
    hits = scratch.keep(hits.groupBy("key").agg(F.array_sort(F.collect_set("hit")).alias("hits")), "hits")
    found = (
        keyed.join(small(hits.select("key")), "key", "left_semi").dropDuplicates(["key"])
        .join(_few(hits, F.aggregate("hits", F.lit(0), lambda n, x: n + 10 + F.size(x["lens"]) + F.size(x["anchors"]))), "key")  # a struct of arrays has ten words of its own
        .select("key", "doc_id", "hits", shingles(F.col("text")).alias("hs"))
    )
    windows = _windows(found, items.agg(F.max("len")).first()[0] or 0, threshold)
    windows = scratch.keep(windows.repartition(spread, "key", "start"), "windows")  # few bytes, much work for each
    radius = plan_radius(threshold, miss)
    masks = F.array(*(F.lit(_signed(m)) for m in block_masks(radius)))
    cut = lambda fp: F.posexplode(F.transform(masks, lambda m: fp.bitwiseAND(m))).alias("block", "bits")
    keys = F.xxhash64("len", "block", "bits", "anchor").alias("k")
    anchor_of = known.select(F.col("h").alias("anchor"), F.explode("anchors").alias("len"))
    anchored = items.select("no", "len", F.explode(F.array_distinct("item")).alias("anchor")).join(anchor_of, ["anchor", "len"])
    prints = scratch.keep(items.select("no", "item", "len", simhash(F.col("item")).alias("item_fp")), "prints")
    index = anchored.join(prints.select("no", "item_fp"), "no").select("no", "len", "anchor", "item_fp", cut(F.col("item_fp"))).select("no", "item_fp", keys)
    index = scratch.keep(index, "index")
    windows = windows.withColumn("fp", simhash(F.col("window")))
    probes = windows.select("key", "start", "len", "fp", F.explode("anchors").alias("anchor"))
    probes = probes.repartition(spread).select("key", "start", "len", "fp", "anchor", cut(F.col("fp"))).select("key", "start", "len", "fp", keys)
    close = probes.join(small(index), "k").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    pairs = scratch.keep(close.select("key", "start", "len", "no").distinct(), "pairs")
    alike = (
        pairs.join(windows.drop("fp", "anchors"), ["key", "start", "len"]).join(_few(items.drop("len"), F.size("item")), "no")
        .select("key", "doc_id", "item_id", "start", similarity(F.col("window"), F.col("item")).alias("similarity"))
        .where(F.col("similarity") >= threshold - 1e-9)
    )
    best = alike.groupBy("key", "doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    return best.select("key", "doc_id", "item_id", (-F.col("b.back")).cast("long").alias("start"), F.round("b.similarity", 6).alias("similarity"))


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, threshold: float = 0.8, miss: float = 1e-4) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> (doc_id, item_id, start, similarity).

    One row per contaminated pair: the most similar window and the number of the word it
    begins with (the first, of windows as similar). Clean documents have no row. Null or
    empty texts, documents and items of fewer than five words, and items without an id match
    nothing. Null doc_ids are kept. Repeats of a document row, or of an item's id, give one
    row; documents that share only a doc_id are judged each. Other columns are ignored.
    Empty tables give no rows.
    """
    return _leaks(docs, benchmark, scratch, threshold, miss).drop("key")


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, threshold: float = 0.8, miss: float = 1e-4) -> DataFrame:
    """The rows of docs without a leak; a row that only shares its doc_id with a leaking one stays."""
    name = f"key_{uuid.uuid4().hex}"
    found = scratch.keep(_leaks(docs, benchmark, scratch, threshold, miss).select(F.col("key").alias(name)).distinct(), "leaking")
    return docs.withColumn(name, row_key(F.col("doc_id"), F.col("text"))).join(small(found), name, "left_anti").select(*columns_of(docs))
