"""Operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns, held to brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewater.llm import bpe, components, decontaminate, license_scan, near_duplicates, quality, sharding, token_files, toxicity, url_filters, vector_search
from tidewater.llm.vocabulary import VOCABULARY
from tidewater.session import Scratch

random.seed(7)
VOCAB = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, score double, part int, path string, `a.b` string"


def sentence(n, vocab=VOCAB):
    return " ".join(random.choice(vocab) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, "x", "y") for i, t in rows], DOCS)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (60, 100), (7, 7)]
    found = components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c")
    got = {r["node"]: r["comp"] for r in found.collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 60: 50, 100: 50}
    assert components.components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t"), "c").count() == 0


def test_jaccard_classes(spark):
    base = [sentence(60) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t) for i, t in enumerate(base[:3])]
    for k in range(12):  # near copies of one text, of each other too, or just not
        words = base[0].split()
        for at in random.sample(range(len(words)), 1 + k % 3):
            words[at] = f"new{k}"
        rows.append((30 + k, " ".join(words)))
    rows += [(60, None), (61, ""), (62, " \n "), (63, "two words"), (64, "TWO  words"), (65, base[5].upper()), (None, base[0]), (66, sentence(20_000)), (67, "a b " * 3000)]
    rows += [(3, base[4]), (3, "quite another text"), (11, base[1]), (None, sentence(30)), (None, None)]  # ids that repeat, with one text and with several

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    at = range(len(rows))
    links = [{j for j in at if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9} for i in at]
    least = lambda js: min((rows[j][0] for j in js if rows[j][0] is not None), default=None)
    groups = [{i} for i in at]
    for _ in at:
        groups = [g.union(*(links[j] for j in g)) for g in groups]
    want = [(rows[i][0], least(groups[i]), least([i, *(j for j in links[i] if sets[i] == sets[j])]), 1 + sum(sets[i] == sets[j] for j in links[i]), len(links[i])) for i in at]
    for bucket_part in (4096, 3):
        found = near_duplicates.jaccard_classes(docs(spark, rows), Scratch(spark, "t"), block=4, bucket_part=bucket_part)
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["class_id"], r["copy_of"], r["n_copies"], r["n_links"])) for r in found.collect())
    named = docs(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))  # ids of another type
    assert {r["class_id"] for r in near_duplicates.jaccard_classes(named, Scratch(spark, "t")).where("doc_id = 'd10'").collect()} == {"d0"}
    assert near_duplicates.jaccard_classes(docs(spark, []), Scratch(spark, "t")).count() == 0

    kept = near_duplicates.keep_one(docs(spark, rows), Scratch(spark, "t"))
    assert kept.columns == docs(spark, []).columns
    lead = lambda g: min(g, key=lambda j: (rows[j][0] is None, rows[j][0] or 0, hashlib.md5((f"{len(str(rows[j][0]))}:{rows[j][0]}" + f"{len(rows[j][1])}:{rows[j][1]}").encode()).digest()))
    stay = [rows[i] for i in at if len(groups[i]) == 1] + [rows[j] for j in {lead(g) for g in groups if len(g) > 1}]
    assert sorted(map(str, stay)) == sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    few = [(8, "a"), (8, "a"), (1, "b"), (9, "b"), (9, "other text")]
    assert sorted((r["doc_id"], r["text"]) for r in near_duplicates.keep_one(docs(spark, few), Scratch(spark, "t")).collect()) == [(1, "b"), (8, "a"), (9, "other text")]
    assert near_duplicates.keep_one(docs(spark, []), Scratch(spark, "t")).count() == 0


def test_plan_sketch():
    far = near_duplicates.plan_sketch(0.8, 205, 1e-7)
    bits = np.random.default_rng(1).random((200_000, 205)) < 0.1
    assert (bits.sum(axis=1) <= far).all() and 30 < far < 60


def test_leaks(spark):
    items = [(i, sentence(n)) for i, n in enumerate((12, 15, 15, 30, 41))] + [(9, None), (10, ""), (11, "too short"), (None, sentence(9)), (0, sentence(12))]
    texts = dict(items)
    item0 = items[0][1]
    broken = texts[4].split()
    broken[2] = "changed"
    rows = [
        (1, sentence(50) + " " + item0 + " " + sentence(30)), (2, "Hm: " + texts[3].upper().replace(" ", ", ") + "."), (3, sentence(80)), (4, None), (5, ""), (6, "few words"),
        (7, sentence(9000) + " " + " ".join(broken)), (8, texts[1] + " " + texts[2]), (8, sentence(40)), (12, " ".join(texts[3].split()[:14])), (None, texts[1]), (13, texts[1]),
    ]
    rows += [(8, texts[1] + " " + texts[2]), (1, sentence(30)), (14, (texts[1] + " ") * 2 + item0)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3)).withColumn("start", F.lit("?"))
    found = sorted(str((r["doc_id"], r["item_id"], r["start"], r["similarity"])) for r in decontaminate.leaks(docs(spark, rows), bench, Scratch(spark, "t")).collect())

    def shingles(text):
        w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    known = {x for i, t in items for x in shingles(t) if i is not None}

    def best(text, item):
        s, want = shingles(text), shingles(item)
        sims = []
        for at in [at for at in range(len(s)) if s[at] in known and want]:
            win = s[at : at + len(want)]
            both = sum(min(win.count(x), want.count(x)) for x in set(win))
            sims.append((-round(both / (len(win) + len(want) - both), 6), at))
        return min(sims, default=(0, 0))

    expected = {}
    for row in set(rows):
        for i, item in items:
            sim, at = best(row[1], item)
            if i is not None and -sim >= 0.8:
                expected[row, i] = min(expected.get((row, i), (0, 0)), (sim, at))
    assert found == sorted(str((row[0], i, at, -sim)) for (row, i), (sim, at) in expected.items())
    assert {row[0] for row, _ in expected} == {1, 2, 7, 8, 13, 14, None}
    leaking = {row for row, _ in expected}
    kept = decontaminate.clean(docs(spark, rows), bench, Scratch(spark, "t"))
    assert sorted(map(str, [r for r in rows if r not in leaking])) == sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    assert kept.columns == docs(spark, []).columns
    assert decontaminate.leaks(docs(spark, []), bench, Scratch(spark, "t")).count() == 0
    assert decontaminate.leaks(docs(spark, rows), bench.where("false"), Scratch(spark, "t")).count() == 0


def test_leaks_of_a_long_document(spark):
    """Of 12,000 words that are all benchmark: what a row takes grows with its length, not with its square."""
    rng = random.Random(12)
    items = [(i, " ".join(rng.choice(VOCAB) for _ in range(40))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, " ".join(items[i % 30][1] for i in range(300))), (2, items[3][1] + " end"), (3, "no passage of it at all here")]
    found = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in decontaminate.leaks(docs(spark, rows), bench, Scratch(spark, "t")).collect()}
    assert found == {(1, i): (40 * i, 1.0) for i in range(30)} | {(2, 3): (0, 1.0)}


def test_stage_drops_a_long_leaking_document(spark, tmp_path):
    rng = random.Random(13)
    items = [(i, " ".join(rng.choice(VOCAB) for _ in range(40))) for i in range(20)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, " ".join(items[i % 20][1] for i in range(300))), (2, "no passage of it at all here")]
    assert [r["doc_id"] for r in corpus_pipeline.no_leaks(spark, docs(spark, rows), str(tmp_path)).collect()] == [2]


def test_simhash_of_long_items(spark):
    one, other = (1 << 40) + 5, (1 << 41) + (1 << 33)
    frame = spark.sql(f"select concat(array_repeat({one}L, 40000), array_repeat({other}L, 30000)) long, concat(array_repeat({one}L, 4), array_repeat({other}L, 3)) short")
    assert frame.select(decontaminate.simhash(F.col("long")).alias("a"), decontaminate.simhash(F.col("short")).alias("b")).first() == (one, one)


def test_index_selects(spark):
    """Far fewer pairs are tested than windows times items of their length."""
    rng = random.Random(11)
    items = [" ".join(rng.choice(VOCAB) for _ in range(24)) for _ in range(300)]
    rows = [(i, " ".join([rng.choice(VOCAB) for _ in range(20)] + [items[i], items[i + 100]])) for i in range(40)]
    scratch = Scratch(spark, "t")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.leaks(docs(spark, rows), bench, scratch)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, j) for i in range(40) for j in (i, i + 100)}
    windows, pairs = (spark.read.parquet(f"{scratch.base}/{t}").count() for t in ("windows", "pairs"))
    assert pairs < 1.5 * windows


def test_licences(spark):
    mit, apache = "Released under the MIT License.", "// Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "r/LICENSE", mit), (2, "r/a/x.txt", "nothing here"), (3, "r/a/b/LICENSE.md", sentence(30) + "\n" + apache + "\r\n" + sentence(9)), (4, "r/a/b/c/y.txt", None), (5, "r/a/b/z.txt", mit + "\nend"),
        (6, "q/x.txt", ""), (7, None, apache), (8, None, "plain"), (9, "top.txt", "the license of the version"), (9, "top.txt", "the license of the version"), (10, "s/COPYING", "see the end"), (11, "s/w.txt", sentence(20000)),
    ]
    files = spark.createDataFrame([(i, p, t, 1, "u") for i, p, t in rows], "doc_id long, path string, text string, w int, own string")
    got = sorted(((r["doc_id"], r["own"], r["license"], r["how"], r["from_dir"]) for r in license_scan.scan(files, Scratch(spark, "t")).collect()), key=str)
    want = [
        (1, "MIT", "MIT", "header", None), (2, None, "MIT", "inherited", "r"), (3, "Apache-2.0", "Apache-2.0", "header", None), (4, None, "Apache-2.0", "inherited", "r/a/b"), (5, "MIT", "MIT", "header", None),
        (6, None, None, "none", None), (7, "Apache-2.0", "Apache-2.0", "header", None), (8, None, None, "none", None), (9, None, None, "none", None), (9, None, None, "none", None), (10, None, None, "none", None), (11, None, None, "none", None),
    ]
    assert got == sorted(want, key=str)
    assert license_scan.scan(files.where("false"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("size", [40, 4000])
def test_licence_line_among_ordinary_words(spark, size):
    header = "It was to be licensed under the Apache License, Version 2.0"
    rows = [(1, "r/a.txt", header), (2, "r/b.txt", "It was to be released under the MIT License.")] + [(i, f"q/{i}.txt", "It was to be under the version 2.0") for i in range(3, size)]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), Scratch(spark, "t"))
    assert {r["doc_id"]: r["own"] for r in found.where("doc_id < 4").collect()} == {1: "Apache-2.0", 2: "MIT", 3: None}


def test_wrapped_header_and_whole_licence_files(spark):
    gpl = "# This work is licensed\n#\n# under the GNU General\n# Public License, version 3."
    whole = {n: t for n, t, _ in license_scan.full_texts()}
    mit = "MIT License\n\nCopyright (c) 2020 A. Writer\n\n" + whole["MIT"]
    rows = [(1, "r/x.py", sentence(30) + "\n" + gpl + "\n" + sentence(12)), (2, "m/LICENSE", mit), (3, "m/a/y.py", sentence(40)), (4, "n/x.py", sentence(25) + "\n# under the GNU General\n" + sentence(8))]
    rows += [(10 + i, f"w{i}/COPYING", whole[n]) for i, n in enumerate(sorted(whole))] + [(i, f"q/{i}.txt", "It was to be under the version") for i in range(30, 90)]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), Scratch(spark, "t"))
    got = {r["doc_id"]: (r["own"], r["license"]) for r in found.where("doc_id < 30").collect()}
    want = {1: ("GPL-3.0",) * 2, 2: ("MIT",) * 2, 3: (None, "MIT"), 4: (None, None)} | {10 + i: (n, n) for i, n in enumerate(sorted(whole))}
    assert got == want


def test_usual_headers_and_tags(spark):
    """Recall on wordings as they stand in real files, and false alarms on texts that only speak of licences."""
    usual = {
        "Apache-2.0": ["# SPDX-License-Identifier: Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at', "// Licensed under the Apache License, Version 2.0"],
        "MIT": ["/* SPDX-License-Identifier: MIT */", "Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software and associated documentation files (the \"Software\"), to deal\n in the Software without restriction", "It is released under the MIT license."],
        "GPL-3.0": ["// SPDX-License-Identifier: GPL-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."],
        "BSD-3-Clause": ["# SPDX-License-Identifier: BSD-3-Clause", "# Use of this source code is governed by a BSD-style license that can be\n# found in the LICENSE file."],
        "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0.", "; SPDX-License-Identifier: MPL-2.0"],
    }
    planted = [(n, t) for n, ts in usual.items() for t in ts]
    none = ["SPDX-License-Identifier: WTFPL", "the licence of the driver is in the office", "a license to drive a work of public art", "version 2.0 of the file is found in the form", "no person may use the software free of charge", ""]
    rows = [(i, f"p{i}/x.c", f"{sentence(9)}\n\n{t}\n{sentence(12)}") for i, (_, t) in enumerate(planted)]
    rows += [(100 + i, f"n{i}/y.c", f"{sentence(9)}\n{t}\n{sentence(12)}") for i, t in enumerate(none)]
    rows += [(i, f"q/{i}.txt", "It was to be under the version and the of this in a to is for") for i in range(200, 900)]
    found = {r["doc_id"]: r["own"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), Scratch(spark, "t")).collect()}
    right = sum(found[i] == n for i, (n, _) in enumerate(planted))
    assert right >= 0.9 * len(planted)
    assert not [none[i] for i in range(len(none)) if found[100 + i]]


def test_ties_of_licences(spark):
    rows = [(1, "r/LICENSE", "alpha beta gamma"), (2, "r/COPYING", "alpha beta delta"), (3, "r/x", "nothing"), (4, "s/NOTICE", "alpha beta gamma"), (5, "s/LICENSE", "alpha beta gamma"), (6, "s/y", None)]
    templates = [("B", "alpha beta delta", ()), ("A", "alpha beta gamma", ()), ("C", "alpha beta gamma", ())]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), Scratch(spark, "t"), templates, texts=[])
    assert {r["doc_id"]: r["license"] for r in found.collect()} == {1: "A", 2: "B", 3: "A", 4: "A", 5: "A", 6: "A"}


def test_sharding(spark):
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (None, "c", 1), (2, "d", 2)], "`doc``id` long, slot string, `a.b` int")
    shards = ["x", "y", "z"]
    placed = sharding.place(rows, "doc`id", shards, 101)
    assert placed.columns == ["doc`id", "a.b", "slot", "shard"]
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    owner, turn = {}, 0  # the filling rule once more, by walking each shard's whole order
    orders = {s: [(number(f"offset:{s}") + k * (number(f"step:{s}") % 100 + 1)) % 101 for k in range(101)] for s in shards}
    while len(owner) < 101:
        shard = shards[turn % 3]
        owner[next(x for x in orders[shard] if x not in owner)] = shard
        turn += 1
    assert sharding.build_table(shards, 101) == [owner[k] for k in range(101)]
    got = sorted((r["slot"], r["shard"]) for r in placed.collect())
    assert got == sorted((number(k) % 101, owner[number(k) % 101]) for k in ("1", "1", "", "2"))
    assert sharding.place(rows.where("false"), "doc`id", shards, 101).count() == 0
    for bad in ([], ["x", "x"]):
        with pytest.raises(ValueError):
            sharding.build_table(bad, 101)
    with pytest.raises(ValueError):
        sharding.build_table(shards, 100)
    out = f"{Scratch(spark, 't').base}/shards"
    sharding.write_shards(placed, out)
    assert sorted((r["slot"], r["shard"]) for r in spark.read.parquet(out).collect()) == got


def test_url_filters(spark, monkeypatch):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "a.example.net/en/x"), ("allow", "example.net/en/"), (None, "x/"), ("block", None)]
    rules += [("block", "/nowhere"), ("block", "xn/"), ("block", "xn/a"), ("allow", "xn/ab"), ("block", "q\x01.xn/ab"), ("allow", "evil/"), ("block", "evil")]
    hosts = ["example.net", "a.example.net", "b.example.net", "EXAMPLE.com", "badexample.com", "x.org", "net", "a.net", "n", "", "net\x01evil", "evil\x01net", "q\x01.xn", "\x02b.net", "é.xn", "net\x00.evil"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/x?y=/fr/", "/de/#a", "/fr", "?q=1", "#/en/", "/abc", "/\x01")] + [None, "no scheme", "://", "http://", "ftp://x.org/fr/1"]
    rows = [(i, u, "h", "k") for i, u in enumerate(urls)] + [(None, urls[0], "h", "k")] + [(7, urls[7], "h", "k")] * 2 + [(5000 + i, "http://a.net/hot", "h", "k") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    frame = spark.createDataFrame(rules, "verdict string, rule string")

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(-len(r), r, v) for v, r in rules if v and r for h, p in [url_filters.split_rule(r)] if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = min(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    want = sorted(str((i, *judged(u))) for i, u, *_ in rows)
    for sampled in (url_filters.SAMPLED, 400):  # few bounds, and one for every url
        monkeypatch.setattr(url_filters, "SAMPLED", sampled)
        got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, frame).collect()]
        assert sorted(map(str, got)) == want
    assert {r["verdict"] for r in url_filters.judge(pages, frame.where("false")).collect()} == {"allow"}
    assert url_filters.judge(pages.where("false"), frame).count() == 0


def test_ranges_of_places(spark):
    bounds = ["b", "c", "ca", "d", "e", "f", "g"]
    places = ["", "a", "b", "bz", "c", "ca", "cz", "d", "f", "fz", "g", "z"]
    for n in range(len(bounds) + 1):
        frame = spark.createDataFrame([(p,) for p in places], "p string").select("p", url_filters._range_of(F.col("p"), bounds[:n]).alias("r"))
        assert {r["p"]: r["r"] for r in frame.collect()} == {p: sum(b <= p for b in bounds[:n]) for p in places}


TEXTS = [(5, sentence(40)), (3, None), (1, ""), (2, "It's <|endoftext|> HERE, 12½"), (2, "again"), (None, "no id"), (9, "x" * 3000), (8, sentence(30_000)), (7, " \n\t")]


def test_bpe(spark):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs(spark, TEXTS), VOCABULARY).collect())
    want = []
    for i, t in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        said = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want)


def test_token_files(spark):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    scratch = Scratch(spark, "t")
    many = [x for x in TEXTS if x[0] != 2] + [(1000 + i, sentence(i % 50)) for i in range(200)]
    token_files.write(docs(spark, many).repartition(5), VOCABULARY, f"{scratch.base}/out", scratch)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read(spark, f"{scratch.base}/out").collect()}
    start, want = 0, {}
    for i, t in sorted(many, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    token_files.write(docs(spark, []), VOCABULARY, f"{scratch.base}/none", scratch)
    assert token_files.read(spark, f"{scratch.base}/none").count() == 0


def best_of(rows, k=10):
    """Brute force over rows (vec_id, vector) in whole numbers."""
    import math

    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))]
    want = []
    for a, (q, x) in enumerate(good):
        if q % 100 == 0:
            best = sorted((-sum(map(int.__mul__, x, v)), i) for b, (i, v) in enumerate(good) if b != a and len(v) == len(x))[:k]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(want)


def found_by(spark, rows, **how):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, q int")
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_search.top_k(frame, F.col("vec_id") % 100 == 0, Scratch(spark, "t"), **how).collect())


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(size=9).tolist() for i in range(300)}
    for i in range(20, 60):
        vectors[i] = vectors[20]
    vectors |= {400: None, 401: [1.0] * 8, 500: [0.5] * 8, 402: [float("nan")] * 9, 403: [None] * 9, 404: [float("inf")] * 9, 405: [], 600: [2.0]}
    rows = [*vectors.items(), (3, vectors[3]), (3, vectors[200]), (None, vectors[3]), (100, vectors[100]), (100, vectors[7]), (200, vectors[20])]
    want = best_of(rows)
    assert found_by(spark, rows) == want
    monkeypatch.setattr(vector_search, "CHUNK", 7)
    monkeypatch.setattr(vector_search, "QUERIES", 2)
    monkeypatch.setattr(vector_search, "PASS_BYTES", 300)
    assert found_by(spark, rows, slices=3) == want  # many nodes, chunks and passes
    monkeypatch.setattr(vector_search, "DENSE", 2)
    assert found_by(spark, rows) == want  # many chunks resolved in place
    assert found_by(spark, [(0, [1.0]), (2, [2.0]), (2, [3.0])]) == [(0, 1, 2, 3 << 20), (0, 2, 2, 2 << 20)]
    assert found_by(spark, [(1, [1.0])]) == [] and found_by(spark, [(100, [1.0])]) == [] and found_by(spark, []) == []


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 8, 3)).tolist()) for i in range(1, 40)]
    rows += [(51, [1e300, 0.0, 0.0]), (52, [0.0, 1.0, 2.0]), (53, [0.0, 1e12, 1.0]), (54, [-1e304, 0.5, 0.5]), (100, [0.0, 0.25, -1.0]), (200, [0.0, 0.0, 3.0]), (300, [0.0, -30.0, 2e3])]
    rows += [(400, [0.0, 3e8]), (401, [5.0, 1.0]), (402, [1e300, 2.0]), (403, [-1e300, 2.0]), (500, [0.0, 7.0])]
    assert found_by(spark, rows, k=5) == best_of(rows, 5)
    with pytest.raises(Exception, match="a score is no long"):
        found_by(spark, [*rows, (600, [1.0, 0.0, 0.0])], k=5)


def test_phases_send_few_entries(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(3000, 16)).tolist())]
    scratch = Scratch(spark, "t")
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vector_search.top_k(frame, F.col("vec_id") % 100 == 0, scratch).collect())) == best_of(rows)
    entries, left = (spark.read.parquet(f"{scratch.base}/pass0-{t}").count() for t in ("entries", "left"))
    assert left <= entries < 0.15 * 30 * 3000 * 2


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    plain = [f"{a}{b}{c}" for a in ("ra", "to", "mi", "lu") for b in ("ne", "ka", "so") for c in ("", "ly", "ing", "er")]
    bad = [f"zork{c}" for c in ("", "ing", "er", "ly")] + ["grubble"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        text = ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, good, toxic, "x"))
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, " ".join(plain) * 500), (None, "ra"), (5, "ra again")]
    return docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 1, "y"), (1000, None, None, "z"), (5, 1, 0, "again")], "doc_id long, quality int, toxic int, text string")


def test_toxicity(spark, labelled):
    rows, labels = labelled
    model = toxicity.train(rows, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = toxicity.score(rows, model).collect()
    assert len(got) == 406 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 400]) > 0.97
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    words = {text[r["doc_id"]][s["begin"] : s["end"]].lower() for r in got if r["doc_id"] and r["doc_id"] < 400 and r["doc_id"] != 5 for s in r["spans"]}
    assert words and sum("zork" in w or "grubble" in w for w in words) >= 0.9 * len(words)
    assert toxicity.score(rows.where("false"), toxicity.train(rows.where("false"), labels, F.lit(True))).count() == 0


def test_quality(spark, labelled):
    rows, labels = labelled
    model = quality.train(rows, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    got = quality.score(rows, model).collect()
    assert len(got) == 406 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 400]) > 0.97
    assert quality.score(rows.where("false"), quality.train(rows.where("false"), labels, F.lit(True))).count() == 0
    assert quality.score(rows, quality.train(rows, labels.limit(0), F.lit(True))).where("score = 0.5").count() == 406


def test_pipeline_stages_act(spark, labelled, tmp_path):
    rows, labels = labelled
    leak = sentence(30)
    extra = docs(spark, [(2001, "ra ne to ka " * 4 + leak), (2002, sentence(60)), (2003, sentence(60))])
    all_docs = rows.where("doc_id < 400 and text not like 'ra again'").union(extra).union(extra.where("doc_id = 2002").withColumn("doc_id", F.lit(2009).cast("long")))
    all_docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "tokens":
            assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r["doc_id"] for r in at.select("doc_id").collect()})
    assert {i for i in ids[0] if i < 400} == {i for i in range(400) if i % 3} and {2001, 2002} <= ids[0]
    assert len([i for i in ids[1] if i < 400 and i % 4 == 0]) <= 5 and len([i for i in ids[1] if i < 400 and i % 4]) >= 190
    assert 2009 in ids[1] and 2009 not in ids[2] and 2002 in ids[2]
    assert ids[2] - ids[3] == {2001} and ids[4] == ids[3]
