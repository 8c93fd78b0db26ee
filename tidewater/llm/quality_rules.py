"""Quality rules whose cutoffs are certified on labelled documents, stratum by stratum.

Every text is measured once. A path of steps (rule, cutoff) goes from lenient to strict: at
level j a document is rejected if any of the steps 1 to j fires, so what is rejected only
grows along the path. In each stratum the levels are tested in that order on the labelled
good documents that pass the base rule: level j is certified if as few rejections as were
seen, or fewer, have a chance of `delta` / (number of strata) at most were the true share of
false rejections above `alpha` (the exact binomial bound). The first level that is not
certified ends the test (fixed sequence: no correction is due within a stratum), and strata
are corrected for by Bonferroni: with a chance of 1 - delta no stratum loses more than
`alpha` of its good documents to the method. Of the certified levels the one with the most
bad less good labelled documents rejected is used, of equals the more lenient; none if that
is never above 0, or if a stratum has too few labelled documents to certify anything.

The path is fixed and no label goes into it, so all labelled rows are hold-outs of the test.

Defined results: a null text counts as empty and fails the base rule; a null stratum is the
stratum ''; rows repeat if they repeat in the input; labels of null ids, other values than 0
and 1 and documents whose labels disagree don't count; equal texts of a stratum and label
count once, for copies are no independent trials. Without labels the base rule alone decides.
An empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.rows import small
from tidewater.session import Scratch, bounded_batches

#: From lenient to strict, the most telling rules first. symbols: per 1000 characters in words; lines: repeated lines per 100 lines;
#: words: repeated words per 100 words; long and short: mean characters of a word, in tenths.
PATH: tuple[tuple[str, int], ...] = (
    ("symbols", 400), ("symbols", 200), ("symbols", 100), ("symbols", 50), ("symbols", 30), ("symbols", 20), ("long", 120), ("short", 20),
    ("long", 100), ("short", 30), ("lines", 75), ("lines", 50), ("words", 45), ("words", 35), ("long", 80), ("lines", 35), ("words", 25),
)
ALPHA, DELTA = 0.05, 0.1
MIN_WORDS, MAX_REPEATED = 50, 50

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in windows of three that the text holds more than once."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    m = len(known)
    pairs = ids[:-2] * m + ids[1:-1]
    if m >= 1 << 21:  # three ids no longer fit a long
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, often = np.unique(pairs * m + ids[2:], return_inverse=True, return_counts=True)
    again = often[which] > 1
    inside = np.zeros(n, dtype=bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def measure(raw: bytes) -> tuple[int, ...]:
    """MEASURES of a text in UTF-8: words between ASCII white space, code points in them, symbols, lines with a word, those equal to an earlier one, repeated words."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    chars = len(raw.translate(None, _CONTINUED + _SPACE))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column(2)]
        found = [measure(t) for t in texts]
        columns = [pa.array([row[i] for row in found], pa.int64()) for i in range(len(MEASURES))]
        digests = pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, digests], names=["doc_id", "stratum", *MEASURES, "digest"])


def fires(rule: str, cutoff: int) -> Column:
    """Whether a step of the path rejects a document, from its measures."""
    c = F.col
    return {
        "symbols": c("n_symbols") * 1000 > c("word_chars") * cutoff, "lines": c("n_dup_lines") * 100 > c("n_lines") * cutoff, "words": c("n_repeat_words") * 100 > c("n_words") * cutoff,
        "long": c("word_chars") * 10 > c("n_words") * cutoff, "short": c("word_chars") * 10 < c("n_words") * cutoff,
    }[rule]


def first_level(path: tuple[tuple[str, int], ...]) -> Column:
    """The first level of the path that rejects a document; null if none does."""
    return F.coalesce(F.lit(None).cast("int"), *(F.when(fires(*step), F.lit(j)) for j, step in enumerate(path, 1)))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Bin(n, p), exactly summed from the largest term downwards until terms no longer count."""
    if k >= n:
        return 1.0
    logs = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    mode = min(k, int((n + 1) * p))
    total, top = 0.0, math.exp(logs(mode))
    term, i = top, mode
    while i >= 0 and term > top * 1e-18:
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
        i -= 1
    term, i = top, mode
    while i < k and term > top * 1e-18:
        term *= (n - i) / (i + 1) * p / (1 - p)
        total += term
        i += 1
    return min(total, 1.0)


def certified(levels: pd.DataFrame, steps: int, alpha: float, most: float) -> tuple[int, int, int, int, int]:
    """(cut, last, n_good, good_lost, bad_caught) of one stratum from its counts (label, level, n): the level used and the last certified one, 0 for none."""
    rejected = np.zeros((2, steps + 1), dtype=np.int64)
    sizes = [0, 0]
    for label, level, n in zip(levels["label"], levels["level"], levels["n"]):
        sizes[int(label)] += int(n)
        if not pd.isna(level):
            rejected[int(label), int(level)] += int(n)
    bad, good = rejected.cumsum(axis=1)
    last = 0
    while last < steps and sizes[1] and binomial_tail(int(good[last + 1]), sizes[1], alpha) <= most:
        last += 1
    cut = max(range(last + 1), key=lambda j: (bad[j] - good[j], -j))
    return cut, last, sizes[1], int(good[cut]), int(bad[cut])


def _cuts(counts: DataFrame, steps: int, alpha: float, delta: float) -> DataFrame:
    strata = counts.where("label = 1").select("stratum").distinct().count()

    def of_stratum(levels: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(levels["stratum"].iloc[0], *certified(levels, steps, alpha, delta / max(strata, 1)))], columns=["stratum", "cut", "last", "n_good", "good_lost", "bad_caught"])

    # at most twice as many rows a stratum as the path has steps
    return counts.groupBy("stratum").applyInPandas(of_stratum, "stratum string, cut int, last int, n_good long, good_lost long, bad_caught long")


def judge(
    docs: DataFrame, labels: DataFrame, stratum: Column, scratch: Scratch, path: tuple[tuple[str, int], ...] = PATH, alpha: float = ALPHA, delta: float = DELTA
) -> tuple[DataFrame, DataFrame]:
    """Measures and verdicts of docs(doc_id, text), and the strata's cutoffs.

    Gives (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_lines, stratum, level, cut), one row a document, and (stratum, cut, last, n_good,
    good_lost, bad_caught). labels(doc_id, quality); `stratum` is an expression over docs.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    with bounded_batches(spark):
        wide = plain.mapInArrow(_measured, f"doc_id {kind}, stratum string, {', '.join(f'{m} long' for m in MEASURES)}, digest binary")
        failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
        found = scratch.keep(wide.withColumn("base_failed", failed).withColumn("level", F.when(~failed, first_level(path))), "measured")
    known = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top").drop("top")
    trials = found.where(~F.col("base_failed")).select("doc_id", "stratum", "digest", "level").join(known, "doc_id").groupBy("stratum", "digest", "label").agg(F.min("level").alias("level"))
    cuts = scratch.keep(_cuts(trials.groupBy("stratum", "label", "level").agg(F.count("*").alias("n")), len(path), alpha, delta), "cuts")
    cut = F.coalesce(F.col("cut"), F.lit(0))
    rows = found.join(small(cuts.select("stratum", "cut")), "stratum", "left").withColumn("cut", cut)
    kept = ~F.col("base_failed") & F.coalesce(F.col("level") > F.col("cut"), F.lit(True))
    out = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_lines", "stratum", "level", "cut")
    return out, cuts
