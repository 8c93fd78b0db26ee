"""Quality rules, the filter audit and spelling variants against brute force, and their defined results."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import comb

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.llm import filter_audit, quality_rules, spelling
from tidewater.session import Scratch

SPACE = r"[^\x20\x09-\x0D]+"


def _texts(seed: int, n: int) -> list[str | None]:
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        words = [rng.choice(["a", "bé", "#x", "Zed", "QED", "a|b", " ", "line", "😀"]) for _ in range(rng.randrange(0, 14))]
        made.append("".join(w + rng.choice([" ", "\n", "\t ", "\n\n", "\x0b", " "]) for w in words))
    return [None, "", " \n ", "a", *made]


def _measures(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), dup, len(inside)


def test_measures():
    for text in [*_texts(1, 400), "x y z " * 3000, "one two three one two three"]:
        assert quality_rules.measure((text or "").encode()) == _measures(text)


def test_binomial_tail():
    for k, n, p in [(0, 10, Fraction(1, 20)), (3, 40, Fraction(1, 10)), (17, 300, Fraction(1, 20)), (299, 300, Fraction(1, 20)), (9, 9, Fraction(1, 3))]:
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality_rules.binomial_tail(k, n, float(p)) == pytest.approx(float(exact), rel=1e-9)
    assert quality_rules.binomial_tail(49_000_000, 1_000_000_000, 0.05) < 1e-100


def test_certified_levels():
    rows = [(1, None, 400), (1, 3, 40), (0, 1, 5), (0, 2, 7), (0, 3, 9)]
    table = pd.DataFrame(rows, columns=["label", "level", "n"])
    # level 3 would lose 40 of 440 good documents, above 0.05; level 2 catches 12 bad ones for nothing
    assert quality_rules.certified(table, 3, 0.05, 0.025) == (2, 2, 440, 0, 12)
    assert quality_rules.certified(table, 3, 0.2, 0.025) == (2, 3, 440, 0, 12)
    assert quality_rules.certified(table[table["label"] == 0], 3, 0.05, 0.025) == (0, 0, 0, 0, 0)
    assert quality_rules.certified(pd.DataFrame([(1, None, 50), (0, 1, 50)], columns=["label", "level", "n"]), 3, 0.05, 0.025)[:2] == (0, 0)


def test_false_rejections_stay_within_the_bound():
    """Random strata whose true share of false rejections is just above alpha: it may be used with a chance of delta at most."""
    rng = random.Random(5)
    used = 0
    for _ in range(300):
        lost = sum(rng.random() < 0.055 for _ in range(400))
        table = pd.DataFrame([(1, None, 400 - lost), (1, 1, lost), (0, 1, 400)], columns=["label", "level", "n"])
        used += quality_rules.certified(table, 1, 0.05, 0.1)[1]
    assert used <= 300 * 0.1


def test_quality_rules(spark, tmp_path):
    words = [f"word{i}" for i in range(60)]
    good, bad = " ".join(words), " ".join(w + "##" for w in words)
    rows = [(i, good + f" {i}", "en") for i in range(200)] + [(1000 + i, bad + f" {i}", "en") for i in range(20)]
    rows += [(1, good + " 1", "en"), (None, None, None), (None, bad, "en"), (2000, bad, None), (2001, "few words", "en"), (2002, "\n".join(["a b c d e"] * 30), "en")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, stratum string, kept int")
    labels = [(i, 1) for i in range(200)] + [(1000 + i, 0) for i in range(20)] + [(5, 0), (None, 1), (6, 7)]
    labels = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, stratum string")
    out, cuts = quality_rules.judge(docs, labels, F.col("lang"), Scratch(spark, "t"))
    got = out.collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], *(r[c] for c in quality_rules.MEASURES)) for r in got) == Counter((i, *_measures(t)) for i, t, _ in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        # '##' at words of six or seven letters is 20 to 40 symbols a hundred: rejected where the stratum's labels certify it
        assert r["kept"] == (not r["base_failed"] and not (r["n_symbols"] and r["stratum"] == "en"))
    (cut,) = cuts.where("stratum = 'en'").collect()
    assert cut["n_good"] == 199 and cut["good_lost"] == 0 and cut["bad_caught"] == 20
    none, no_cuts = quality_rules.judge(docs, labels.limit(0), F.col("lang"), Scratch(spark, "t"))
    assert no_cuts.count() == 0 and none.where("kept = base_failed").count() == 0
    assert quality_rules.judge(docs.limit(0), labels, F.col("lang"), Scratch(spark, "t"))[0].count() == 0
    named = quality_rules.judge(docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))), labels, F.lit(None), Scratch(spark, "t"))[0]
    assert named.schema["doc_id"].dataType.simpleString() == "string" and named.count() == len(rows)


def _audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    texts = [t or "" for _, t, _ in rows]
    docs = []
    for (i, _, lang), t in zip(rows, texts):
        words = re.findall(SPACE, t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and u == t for (j, _, _), u in zip(rows, texts))
        docs.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, removed_all = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                own = [d for d in docs if d[0] == part]
                gone = [d for d in own if f in d[1] and not d[1] & before]
                removed_all[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    sum(not d[1] & (before | {f}) for d in own), len(gone), sum(f in d[1] and bool(d[1] & before) for d in own), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {(*k, *v, removed_all[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("hot", [2000, 3])
def test_filter_audit(spark, monkeypatch, hot):
    monkeypatch.setattr(filter_audit, "HOT", hot)  # with 3, groups of a third of the rows are hot
    rng = random.Random(3)
    long = [" ".join(f"w{rng.randrange(k)}" for _ in range(120)) for k in (1000, 1000, 50, 20)]
    texts = [*_texts(2, 30), *long, long[0] + " #", long[0].upper(), " ".join(long), "  " + long[1] + "\n"]
    rows = [(rng.randrange(60), rng.choice(texts), rng.choice(["en", "fr", None, ""])) for _ in range(120)] + [(9, long[0], "en"), (9, long[0], "en"), (None, long[0], "fr"), (None, None, None)]
    rows += [(200 + i, long[1], "en") for i in range(80)]
    labels = [(rng.randrange(80), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(60)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, lang string, good int, part string")
    marks = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, lang string")
    got = filter_audit.audit(docs, marks, F.col("lang"), Scratch(spark, "t"))
    assert {tuple(r) for r in got.collect()} == _audit(rows, labels)
    assert got.count() == 3 * 600


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels, F.col("lang"), Scratch(spark, "t")).count() == 0
    one = spark.createDataFrame([("a", None, None)], "doc_id string, text string, lang string")
    (row,) = filter_audit.audit(one, labels.withColumn("doc_id", F.lit("a")), F.col("lang"), Scratch(spark, "t")).where("filter_order = 'BADCE' and step = 2").collect()
    assert tuple(row) == ("", "BADCE", 2, 0, 1, 0, 1, 0, 0, 120)


def _near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if _near(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


@pytest.mark.parametrize("block", [2000, 2])
def test_spelling_variants(spark, monkeypatch, block):
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (block,))
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeé÷ß") for _ in range(rng.randrange(6, 10))) for _ in range(25)]
    pool = Counter()
    for w in base:
        pool[w] += rng.choice([5, 30, 200])
        for _ in range(4):
            k = rng.randrange(len(w))
            edited = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k:], w[:k] + rng.choice("xÀ") + w[k + 1 :]])
            pool[edited] += rng.choice([1, 5, 6, 30])
    pool |= {"aaaaaa": 7, "aaaaaaa": 45, "aaaaaaaa": 280, "aaaaaaaaa": 1600, "short": 50, "ABCdef": 7}
    tokens = [w for w, n in pool.items() for _ in range(n)]
    rng.shuffle(tokens)
    rows = [(k, rng.choice([" ", ", ", "1"]).join(tokens[k::40])) for k in range(40)] + [(3, tokens[0] + " x"), (3, tokens[0] + " x"), (None, " ".join(base)), (50, None), (51, "")]
    rows += [(100 + k, "aaaaaaaaa") for k in range(400)]
    docs = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = [tuple(r) for r in spelling.variants(docs, Scratch(spark, "t")).collect()]
    want = _variants(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] is not None and r[2] != r[1] for r in want) and any(r[4] > 1 for r in want)


def test_spelling_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "tiny")], "doc_id long, text string")
    assert spelling.variants(docs, Scratch(spark, "t")).count() == 0
    assert spelling.variants(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_shortened_runs():
    doc, run = next((i, w) for i in range(10_000) for w in ("vingerhoed",) if zlib.crc32(f"{i}:{w}".encode()) % 199 == 0)
    at = zlib.crc32(f"{doc}:{run}".encode()) % len(run)
    assert list(spelling.word_counts_of(str(doc), f"{run.upper()} {run} {run}s")) [0] == (run[:at] + run[at + 1 :], 2)
