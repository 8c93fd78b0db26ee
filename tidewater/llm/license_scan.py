"""License scans: TF-IDF cosine of lines to licence templates, then inheritance from the nearest directory above.

* Words are the lower-cased runs of letters and digits. A template is a sentence or a tag, and
  a licence may have several; every line of every file is a candidate header, wherever it
  stands, and so is every run of consecutive lines, up to as many lines with words as the
  longest template has words. A template may name words that a candidate must hold: tags
  differ in nothing but those.
* A licence file is a candidate as a whole too, against the full texts in `licences`
  (there are none of the two CC licences).
* idf(t) = ln((1 + N) / (1 + df)) + 1 over all N files, for words of templates and of lines
  alike. Document frequencies are counted over all files.
* `anchors` names, from those weights, words without which no line can reach the
  threshold; runs without one are skipped, which loses nothing.
  Neither do the bounds that keep most runs and files from being counted out in full: the
  squared norm of a run is at least the sum of its lines', and no word weighs less than 1.
* A file without a licence line of its own takes that of the nearest directory at or above
  its own that has a licence file (LICENSE, LICENCE, COPYING, NOTICE, with any suffix) with
  a licence. Directories, not files, are joined to the directories above them.

All of it is DataFrame functions.
"""

from __future__ import annotations

import math
import pkgutil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.rows import row_key
from tidewater.session import Scratch

#: (licence, wording, words that a candidate must hold)
Template = tuple[str, str, tuple[str, ...]]
TEMPLATES: list[Template] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ()),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', ()),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", ()),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", ()),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ()),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ()),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ()),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        ("general", "3"),
    ),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1.", ()),
    ("MIT", "Released under the MIT License.", ()),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", ()),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ()),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ()),
]
FULL_TEXTS = ["Apache-2.0", "BSD-3-Clause", "GPL-3.0", "LGPL-2.1", "MIT", "MPL-2.0", "Unlicense"]
NAMES = sorted({n for n, _, _ in TEMPLATES})


def tags(names: list[str]) -> list[Template]:
    """A template for the identifier tag of each licence, whose words a candidate must all hold."""
    return [(n, f"SPDX-License-Identifier: {n}", tuple(_template_words(n))) for n in names]


LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def _template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def full_texts() -> list[Template]:
    return [(n, pkgutil.get_data("tidewater.llm", f"licences/{n}.txt").decode(), ()) for n in FULL_TEXTS]


SIDES = "t int, name string, w string, y double, must boolean, need int"


def _sides(templates: list[Template], idf: dict[str, float]) -> list[tuple[int, str, str, float, bool, int]]:
    """(number, name, word, weight, whether the word must occur, how many must) of the templates, each of norm 1."""
    rows = []
    for t, (name, text, must) in enumerate(templates):
        each: dict[str, float] = {}
        for w in _template_words(text):
            each[w] = each.get(w, 0) + idf[w]
        norm = math.sqrt(sum(x * x for x in each.values()))
        rows += [(t, name, w, x / norm, w in must, len(set(must))) for w, x in sorted(each.items())]
    return rows


def _cosines(weighted: DataFrame, sides: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """weighted(*keys, t, w, x): a candidate's words, for the template it is compared to -> (file_id, name, score)."""
    score = F.round(F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x"))), 4)
    both = weighted.join(sides, ["t", "w"], "left").groupBy(*keys, "t")
    good = both.agg(score.alias("score"), F.max("name").alias("name"), F.count_if("must").alias("held"), F.max("need").alias("need"))
    return good.where((F.col("score") >= threshold) & (F.col("held") == F.col("need"))).select("file_id", "name", "score")


def anchors(templates: list[Template], idf: dict[str, float], threshold: float) -> set[str]:
    """Words such that a line without any of them has a cosine below the threshold to every template.

    Such a line shares with a template only the template's other words; by Cauchy-Schwarz its
    cosine is at most their share of the template's norm.
    """
    found: set[str] = set()
    for _, text, _ in templates:
        weight: dict[str, float] = {}
        for w in _template_words(text):
            weight[w] = weight.get(w, 0) + idf[w]
        total = sum(x * x for x in weight.values())
        left = total
        for w in sorted(weight, key=lambda w: (-idf[w], w)):
            if left < (threshold * threshold - 1e-9) * total:
                break
            found.add(w)
            left -= weight[w] ** 2
    return found


def _whole(files: DataFrame, scratch: Scratch, counts: DataFrame, weight: Column, texts: list[Template], idf: dict[str, float], threshold: float) -> DataFrame:
    """(file_id, name, score) of licence files, as wholes, to full texts."""
    spark = files.sparkSession
    named = files.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE)).select("file_id", F.explode(_words(F.col("text"))).alias("w"))
    tf = scratch.keep(named.groupBy("file_id", "w").agg(F.count("*").alias("tf")), "whole")
    sides = F.broadcast(spark.createDataFrame(_sides(texts, idf), SIDES))  # as many rows as the texts have words
    weights = F.broadcast(spark.createDataFrame(sorted(idf.items()), "w string, i double"))
    x = F.col("tf") * F.coalesce("i", F.lit(1.0))
    least = tf.join(weights, "w", "left").select("file_id", "w", x.alias("x"))
    norms = least.groupBy("file_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    dots = least.join(sides, "w").groupBy("file_id", "t").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    close = scratch.keep(dots.join(norms, "file_id").where(F.col("d") >= (threshold - 1e-4) * F.col("n")).select("file_id", "t"), "close")
    words = scratch.keep(tf.join(close.select("file_id").distinct(), "file_id", "left_semi"), "close_words")
    known = scratch.keep(counts.join(words.select("w").distinct(), "w", "left_semi"), "close_known")
    weighted = words.join(known, "w").select("file_id", "w", (F.col("tf") * weight).alias("x"))
    return _cosines(close.join(weighted, "file_id"), sides, ["file_id"], threshold)


def scan(files: DataFrame, scratch: Scratch, templates: list[Template] | None = None, threshold: float = 0.7, texts: list[Template] | None = None) -> DataFrame:
    """files(doc_id, path, text, ...) -> (doc_id, path, own, score, license, how, from_dir), one row per file.

    own, score: the file's best licence line, run of lines or, of a licence file, whole text, and
    its cosine (null below the threshold; ties go to the first name). license: own, else inherited, else null; how: 'header',
    'inherited' or 'none'; from_dir: the directory it is inherited from.

    Null or empty texts have no licence of their own; a null path inherits nothing; null
    doc_ids are kept. Repeated files are judged each; two licence files in a directory: the
    higher score, then the first name, counts. Other columns are ignored. No files: no rows.
    """
    spark = files.sparkSession
    texts = (full_texts() if templates is None else []) if texts is None else texts
    templates = TEMPLATES + tags(NAMES) if templates is None else templates
    vocab = sorted({w for _, t, _ in templates + texts for w in _template_words(t)})
    files = files.select("doc_id", "path", "text").withColumn("file_id", row_key(row_key(F.col("doc_id"), F.col("path")), F.col("text")))
    seen = files.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("w"))
    counts = scratch.keep(seen.groupBy("w").agg(F.count("*").alias("df")), "counts")
    total = files.select("doc_id").count()
    counted = {r["w"]: r["df"] for r in counts.where(F.col("w").isin(vocab)).collect()}  # a row for each word of the templates at most
    idf = {w: math.log((1 + total) / (1 + counted.get(w, 0))) + 1 for w in vocab}
    picked = anchors(templates, idf, threshold)
    weight = F.log(F.lit(1 + total) / (1 + F.col("df"))) + 1
    split = F.filter(F.transform(F.split("text", r"\R"), _words), lambda ws: F.size(ws) > 0)
    held = F.arrays_overlap(_words(F.col("text")), F.array(*(F.lit(w) for w in sorted(picked))))
    lines = files.where(held).select("file_id", F.posexplode(split).alias("line", "ws"))
    tf = scratch.keep(lines.select("file_id", "line", F.explode("ws").alias("w")).groupBy("file_id", "line", "w").agg(F.count("*").alias("tf")), "tf")
    known = scratch.keep(counts.join(tf.select("w").distinct(), "w", "left_semi"), "known")
    weighted = scratch.keep(tf.join(known, "w").select("file_id", "line", "w", (F.col("tf") * weight).alias("x")), "weighted")
    sides = F.broadcast(spark.createDataFrame(_sides(templates, idf), SIDES))  # as many rows as the templates have words
    numbers = F.explode(F.sequence(F.lit(0), F.lit(len(templates) - 1)))
    norms = weighted.groupBy("file_id", "line").agg(F.sum(F.col("x") * F.col("x")).alias("n"), F.max(F.col("w").isin(sorted(picked))).alias("anchor"))
    dots = weighted.join(sides, "w").groupBy("file_id", "line", "t").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    rows = norms.select("*", numbers.alias("t")).join(dots, ["file_id", "line", "t"], "left").fillna(0.0, ["d"])
    most = max(len(_template_words(t)) for _, t, _ in templates)
    ahead = Window.partitionBy("file_id", "t").orderBy("line").rangeBetween(0, most - 1)
    start = rows.select("file_id", "t", "line", "d", F.collect_list(F.struct("line", "d", "n", "anchor")).over(ahead).alias("run")).where("d > 0")  # most lines at most
    start = start.where(F.exists("run", lambda l: l["anchor"]))
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n"), F.lit(False).alias("anchor"), F.array().cast("array<int>").alias("ends"))

    def longer(so_far: Column, l: Column) -> Column:
        d, n, anchor = so_far["d"] + l["d"], so_far["n"] + l["n"], so_far["anchor"] | l["anchor"]
        could = anchor & (l["d"] > 0) & (d >= (threshold - 1e-4) * F.sqrt(n))
        ends = F.when(could, F.concat(so_far["ends"], F.array(l["line"]))).otherwise(so_far["ends"])
        return F.struct(d.alias("d"), n.alias("n"), anchor.alias("anchor"), ends.alias("ends"))

    runs = start.select("file_id", "t", "line", F.explode(F.aggregate("run", zero, longer)["ends"]).alias("end"))
    runs = scratch.keep(runs.withColumnRenamed("line", "begin"), "runs")
    each = runs.withColumn("line", F.explode(F.sequence("begin", "end"))).join(weighted, ["file_id", "line"])
    cosine = _cosines(each.groupBy("file_id", "t", "begin", "end", "w").agg(F.sum("x").alias("x")), sides, ["file_id", "begin", "end"], threshold)
    if texts:
        cosine = cosine.unionByName(_whole(files, scratch, counts, weight, texts, idf, threshold))
    best = cosine.groupBy("file_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b"))
    best = scratch.keep(best.select("file_id", F.col("b.name").alias("own"), (-F.col("b.s")).alias("score")), "best")
    judged = files.drop("text").join(best, "file_id", "left")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    named = F.regexp_extract("path", r"([^/]*)$", 1)
    placed = judged.withColumn("dir", F.when(F.col("path").isNotNull(), folder))
    givers = (
        placed.where(F.col("own").isNotNull() & named.rlike(LICENCE_FILE)).groupBy("dir")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "own")).alias("b")).select(F.col("dir").alias("from_dir"), F.col("b.own").alias("given"))
    )
    givers = scratch.keep(givers, "givers")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = placed.where("dir is not null").select("dir").distinct().withColumn("from_dir", F.explode(above))
    nearest = dirs.join(givers, "from_dir").groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("n"), "from_dir", "given")).alias("b")).select("dir", "b.from_dir", "b.given")
    nearest = scratch.keep(nearest, "nearest")
    inherits = F.col("own").isNull() & F.col("given").isNotNull()
    return placed.join(nearest, "dir", "left").select(
        "doc_id", "path", "own", "score", F.coalesce("own", "given").alias("license"),
        F.when(F.col("own").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(inherits, F.col("from_dir")).alias("from_dir"),
    )
