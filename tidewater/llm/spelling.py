"""Groups of spelling variants: words that differ by one inserted, deleted or replaced letter.

The parities of a word's letter counts are a mask of 90 bits, split into three bands. One edit
flips two bits at most, so near words agree in one band at least; and as words have six letters
or more, it leaves the first three or the last three alone. Words are joined where a band and one
of these ends agree, within one letter of length and two bits of the mask, and each pair is
verified once, at the first of the six keys that its words share. Keys that very many words
share are dealt out in blocks, so no task gets all pairs of one.

Words are maximal runs of ASCII letters and U+00C0 to U+00FF, A-Z lower-cased. By a fixed rule
every 199th (document, run), told by a crc32, loses one letter, in place of real misspellings.
Null texts have no words; a null id reads as an empty text in that rule; repeated rows count again.
An empty table has no words. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, log, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.rows import small
from tidewater.session import Scratch, bounded_batches

RUN = re.compile("[a-zÀ-ÿ]+")
ALPHABET = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
BANDS = 3
EVERY, MIN_LETTERS, MIN_COUNT, FORM_TIMES = 199, 6, 5, 5
END = 3
#: Words of one key that meet as one block; larger keys are dealt out in blocks of about so many.
BLOCK = 2000
MAX_KNOWN = 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_counts_of(doc_id: str, text: str) -> Iterator[tuple[str, int]]:
    """(word, count) of a text, words of MIN_LETTERS or more; a run may appear twice only as the shortened form of another."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode().translate(_LOWER).decode())).items():
        if len(run) < MIN_LETTERS:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < MIN_LETTERS:
                continue
        yield run, n


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(known.keys(), pa.string()), pa.array(known.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            for word, n in word_counts_of(doc_id.as_py(), text.as_py() or ""):
                known[word] = known.get(word, 0) + n
            if len(known) > MAX_KNOWN:
                yield out()
                known.clear()
    yield out()


def vocabulary(docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words with at least so many occurrences in all texts."""
    plain = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_partial_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def band(word: Column, b: int) -> Column:
    """Parities of the counts of every third letter of the alphabet, from the b-th, as bits."""
    places = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    own = F.transform(F.filter(places, lambda i: i % BANDS == b), lambda i: (i / BANDS).cast("int"))
    return F.aggregate(own, F.lit(0), lambda m, i: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1), i)))


def near_pairs(words: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """words(word, n) -> (a, a_n, b, b_n), each pair of near words once, a before b."""
    told = words.select("word", "n", F.length("word").alias("len"), *(band(F.col("word"), b).alias(f"m{b}") for b in range(BANDS)), F.substring("word", 1, END).alias("e0"), F.expr(f"right(word, {END})").alias("e1"))
    told = scratch.keep(told, "masks")
    slots = F.array(*(F.struct(F.lit(2 * b + e).alias("slot"), F.col(f"m{b}").alias("mask"), F.col(f"e{e}").alias("end")) for b in range(BANDS) for e in (0, 1)))
    keyed = told.select("*", F.explode(slots).alias("k")).select(*told.columns, "k.slot", "k.mask", "k.end")
    key = ["slot", "mask", "end"]
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("size"))
    large = small(scratch.keep(sizes.where(F.col("size") > block).select(*key, F.ceil(F.col("size") / block).cast("int").alias("blocks")), "large"))
    side = keyed.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    left = side.withColumn("part", F.pmod(F.xxhash64("word"), "blocks").cast("int")).drop("blocks")
    right = side.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    a, b = left.alias("a"), right.alias("b")
    same = [F.col(f"a.m{i}") == F.col(f"b.m{i}") for i in range(BANDS)]
    ends = [F.col(f"a.e{i}") == F.col(f"b.e{i}") for i in (0, 1)]
    flipped = sum((F.bit_count(F.col(f"a.m{i}").bitwiseXOR(F.col(f"b.m{i}"))) for i in range(BANDS)), F.lit(0))
    # the first of the keys that both words share
    first = F.coalesce(*(F.when(same[i] & ends[e], F.lit(2 * i + e)) for i in range(BANDS) for e in (0, 1)))
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*key, "part"]]
    met = a.join(b, [*on, F.col("a.word") < F.col("b.word"), F.abs(F.col("a.len") - F.col("b.len")) <= 1, flipped <= 2, first == F.col("a.slot")])
    return met.where(F.levenshtein("a.word", "b.word", 1) == 1).select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))


def roots(forms: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """forms(word, form) -> (word, root): forms followed to the last, twice as far each round; `longest` bounds a chain."""
    links = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots-0")
    for k in range(ceil(log2(max(longest, 1)))):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = scratch.keep(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots-{k + 1}")
    return links


def variants(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of the vocabulary, its most frequent near word where that is FORM_TIMES as frequent, and where the forms lead."""
    with bounded_batches(docs.sparkSession):
        words = scratch.keep(vocabulary(docs), "words")
    pairs = scratch.keep(near_pairs(words, scratch), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other"))).alias("best"))
    known = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.minus") >= F.col("n") * FORM_TIMES, -F.col("best.minus")))
    known = scratch.keep(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.other")).alias("form"), "form_n"), "known")
    top = known.agg(F.max("form_n")).first()[0] or 1
    found = known.join(roots(known.where("form is not null"), 1 + ceil(log(top, FORM_TIMES)), scratch), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
