"""Licence scan by a trained paragraph classifier (operator 6, native).

Paragraphs are lines. A multinomial logistic regression over sparse word n-grams (one
and two words), trained here on labelled templates and on a bounded sample of lines of
the corpus that name no licence, gives each paragraph a family. The class `none` is
trained as a class of its own. Lines of the same texts that a fit takes for a family
though no template confirms it join the sample, and the fit is repeated. A quarter of those lines and wordings that are no
templates are held out: they set the temperature of the probabilities and the threshold
below which a finding is `unknown`. A template comparison confirms a prediction: the
share of the n-grams of the family's nearest template that the paragraph holds together
with the two lines before and after it, over which a notice may be wrapped.

The L1 penalty leaves few features with a weight, and most weigh too little to outweigh
`none` together. Only paragraphs with one of the others (see `telling`) are cut into
n-grams; the bound is exact, so no finding is lost. Weights are literals of the plan, bounded by the templates' n-grams.

Defined results for odd input: null and empty texts have no paragraphs; texts of any length are
scanned whole; repeated rows
give their findings each; ties go to the family first by name; an empty table gives an
empty result; other columns are ignored. Ids may be null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumapair.session import materialize

NONE, UNKNOWN = "none", "unknown"
#: Lines of the corpus that the class `none` is learned from, at most.
NEGATIVES = 4000
#: Fits after the first one, each with the lines that the one before takes for a family.
HARD_ROUNDS = 2
L1 = 0.0005
#: Share of a template's n-grams that confirms a prediction.
CONFIRMED = 0.5
#: Lines before and after a paragraph that a notice may be wrapped over.
AROUND = 2

# Common wordings of licence notices by family.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc": [
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "Copyright. All rights reserved.",
        "This document is confidential and proprietary; no part may be reproduced without written permission.",
        "Use is subject to licence terms. All rights reserved.",
    ],
}


# Wordings that are held out of training, by family.
HELD_OUT: dict[str, list[str]] = {
    "apache": ["This file is distributed under the Apache License 2.0.", "Apache License, Version 2.0, January 2004"],
    "bsd": ["This software is licensed under the 2-Clause BSD License.", "Use of this source code is governed by a BSD license."],
    "cc": ["Text is available under the Creative Commons Attribution-ShareAlike 3.0 License.", "Shared under CC BY-NC-SA 4.0."],
    "gpl": ["This file is released under the GNU GPL version 3.", "You should have received a copy of the GNU General Public License along with this program."],
    "lgpl": ["This file is part of a library under the GNU Lesser General Public License.", "Licensed under the LGPL, version 2.1."],
    "mit": ["This project is licensed under the MIT License.", "The MIT License (MIT)"],
    "mpl": ["This file is under the Mozilla Public License 2.0.", "Released under the MPL, version 2.0."],
    "proprietary": ["Copyright 2020 by the authors. All rights reserved.", "Confidential: no part of this document may be reproduced."],
}


def ngrams(text: Column) -> Column:
    """Distinct words and word pairs of a text, in lower case."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9.\-]+"), lambda w: F.length(F.rtrim(w, F.lit("."))) > 0)
    words = F.transform(words, lambda w: F.rtrim(w, F.lit(".")))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.contains(" "))))


@dataclass
class Classifier:
    families: list[str]
    bias: list[float]
    #: feature -> weight per family
    weights: dict[str, list[float]]
    threshold: float
    #: Of the held-out wordings the share with the right family, of the held-out lines of `none` the share with any.
    held_out: dict[str, float] = field(default_factory=dict)


def paragraphs(docs: DataFrame, id_col: str, text_col: str, pattern: str | None = None) -> DataFrame:
    """id, paragraph, line and context (the line with those around it) of every line that is not blank and, in lower case, holds the pattern."""
    lines = docs.select(F.col(id_col).alias("id"), F.split(F.col(text_col), r"\r\n|\n|\r").alias("lines"))

    def wanted(line: Column) -> Column:
        return F.trim(line) != "" if pattern is None else (F.trim(line) != "") & F.lower(line).rlike(pattern)

    def one(line: Column, i: Column) -> Column:
        context = F.concat_ws("\n", F.slice("lines", F.greatest(i + 1 - AROUND, F.lit(1)), F.least(i + 1, F.lit(1 + AROUND)) + AROUND))
        return F.when(wanted(line), F.struct(i.alias("paragraph"), line.alias("line"), context.alias("context")))

    # The array is filtered before it is unfolded, so that lines without the pattern become no rows.
    found = lines.select("id", F.explode(F.filter(F.transform("lines", one), lambda p: p.isNotNull())).alias("found"))
    return found.select("id", "found.*")


# What a line that names a licence holds; `mit` in small letters is a German word.
NAMED = r"(?i:licen[sc]e|copyright|copyleft|spdx|all rights reserved|redistribut|\bgpl\b)|\bMIT\b"


def train(spark: SparkSession, docs: DataFrame, text_col: str = "text", negatives: int = NEGATIVES) -> Classifier:
    """A classifier of the templates against a bounded sample of lines that name no licence, and as many again, at most, that a fit mistakes."""
    rows = [(family, t) for family, ts in TEMPLATES.items() for t in ts]
    unseen = [(family, t) for family, ts in HELD_OUT.items() for t in ts]
    known = spark.createDataFrame([(*r, False) for r in rows] + [(*r, True) for r in unseen], "family string, line string, held boolean")
    # Whole lines of the distinct texts with the least hashes: the hashes alone find the bound, then only those texts move.
    hashed = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("n"), F.col(text_col).alias("text"))
    least = hashed.select("n").distinct().orderBy("n").limit(negatives // 8).agg(F.max("n")).first()[0]
    texts = hashed.where(F.col("n") <= F.lit(least)).groupBy("n").agg(F.min("text").alias("text"))
    lines = materialize(paragraphs(texts, "n", "text").where(~F.col("line").rlike(NAMED)), "plain-lines")
    columns = F.lit(NONE).alias("family"), "line", (F.pmod(F.xxhash64("line", F.lit(1)), F.lit(4)) == 0).alias("held")
    none = lines.orderBy(F.xxhash64("line"), "line").limit(negatives).select(*columns)
    plain = spark.createDataFrame([(NONE, "A line of plain text that is under no terms.", False), (NONE, "", False)], known.schema)
    # A bounded table, held in one partition: each step of the fit is then one short task.
    labelled = materialize(known.union(none).union(plain).withColumn("grams", ngrams(F.col("line"))).coalesce(1), "licence-lines")
    model = _fitted(labelled)
    for _ in range(HARD_ROUNDS):
        mistaken = _compared(lines, model).where(F.col("similarity") < CONFIRMED).select("line").distinct()
        new = mistaken.join(labelled.select("line"), "line", "left_anti").orderBy(F.xxhash64("line"), "line").limit(negatives // HARD_ROUNDS)
        hard = materialize(new.select(*columns).withColumn("grams", ngrams(F.col("line"))).coalesce(1), "hard-lines")
        if hard.isEmpty():
            break
        labelled = materialize(labelled.union(hard).coalesce(1), "licence-lines")
        model = _fitted(labelled)
    # At most twice `negatives` lines and the wordings.
    held = _probabilities(labelled.where("held"), model).select("family", "p").collect()
    return calibrated(model, [r["family"] for r in held], np.array([r["p"] for r in held]))


def _fitted(labelled: DataFrame) -> Classifier:
    """A classifier of rows (family, grams, held) that are not held out."""
    fitted = labelled.where(~F.col("held")).coalesce(1)
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=1 << 16).fit(fitted.where(F.col("family") != NONE))
    names = [NONE, *sorted(TEMPLATES)]
    label = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("family")) - 1
    # Each family weighs as much as any other, and all of them as much as `none`.
    count = fitted.groupBy("family").agg(F.count("*").alias("n"))
    weighed = fitted.join(F.broadcast(count), "family").withColumn("w", F.when(F.col("family") == NONE, F.lit(len(TEMPLATES))).otherwise(F.lit(1.0)) / F.col("n"))
    ready = vocabulary.transform(weighed).select("features", "w", label.cast("double").alias("label")).coalesce(1).cache()
    try:
        model = LogisticRegression(family="multinomial", regParam=L1, elasticNetParam=1.0, weightCol="w", maxIter=60).fit(ready)
    finally:
        ready.unpersist()
    w = model.coefficientMatrix.toArray()
    weights = {f: w[:, i].tolist() for i, f in enumerate(vocabulary.vocabulary) if abs(w[:, i]).max() > 1e-9}
    return Classifier(names, model.interceptVector.toArray().tolist(), weights, 0.5)


def calibrated(model: Classifier, families: list[str], p: np.ndarray) -> Classifier:
    """The model with the temperature that makes held-out rows likeliest (each family of the same weight, and `none` of that of all others), and the least threshold, from 0.5 to 0.9, that no wrong finding among them reaches."""
    y = np.array([model.families.index(f) for f in families])
    names, sizes = np.unique(y, return_counts=True)
    size = dict(zip(names.tolist(), sizes.tolist()))
    w = np.array([(len(TEMPLATES) if i == 0 else 1) / size[i] for i in y.tolist()])
    logs = np.log(np.clip(p, 1e-300, 1))

    def shares(t: float) -> np.ndarray:
        e = np.exp((logs - logs.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    def loss(t: float) -> float:
        return -float(w @ np.log(np.clip(shares(t)[np.arange(len(y)), y], 1e-300, 1)))

    t = min((2.0 ** (k / 4) for k in range(-8, 9)), key=loss)
    q = shares(t)
    best = q[:, 1:].max(axis=1)
    right, finding = q[:, 1:].argmax(axis=1) + 1 == y, q[:, 0] < 0.5
    wrong = best[finding & ~right]
    threshold = min(0.9, max([0.5, *np.nextafter(wrong, 1.0).tolist()]))
    told, plain = finding & (best >= threshold), y == 0
    figures = {"right": float((told & right)[~plain].mean()), "false": float(told[plain].mean()) if plain.any() else 0.0, "temperature": t}
    return Classifier(model.families, [b / t for b in model.bias], {f: [v / t for v in ws] for f, ws in model.weights.items()}, threshold, figures)


def _probabilities(lines: DataFrame, model: Classifier, likely: bool = False) -> DataFrame:
    """lines (with grams) and p: the probability of each class, in the order of model.families.

    If `likely`, lines with clearly 0.5 or more for `none` are left out before the probabilities.

    The scores and the probabilities are written in between: few lines come so far, and
    Catalyst would else copy the large literal into each use.
    """
    bias = F.array(*[F.lit(b) for b in model.bias])
    total = bias
    if model.weights:
        per = F.create_map(*[x for f, ws in model.weights.items() for x in (F.lit(f), F.array(*[F.lit(v) for v in ws]))])
        hits = F.filter(F.transform("grams", lambda g: F.try_element_at(per, g)), lambda v: v.isNotNull())
        total = F.aggregate(hits, bias, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    scored = materialize(lines.withColumn("z", total), "licence-scores")
    if likely:
        others = F.slice("z", 2, len(model.families) - 1)
        scored = scored.where(F.aggregate(others, F.lit(0.0), lambda a, x: a + F.exp(x - F.col("z")[0])) > 1 - 1e-6)
    shifted = materialize(scored.withColumn("e", F.transform("z", lambda s: F.exp(s - F.array_max("z")))), "licence-odds")
    shares = F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y))
    return materialize(shifted.withColumn("p", shares).drop("z", "e"), "licence-shares")


def telling(model: Classifier) -> list[str] | None:
    """Features of which every paragraph with less than 0.5 for `none` has at least one; None if any paragraph may be such.

    Some family must then come within log(families) of the score of `none`. The features
    left out are for each family the weakest ones, which even all together fall short of that.
    """
    needed: set[str] = set()
    for f in range(1, len(model.families)):
        room = model.bias[0] - model.bias[f] - math.log(len(model.families) - 1) - 1e-6
        if room < 0:
            return None
        for gain, gram in sorted((w[f] - w[0], gram) for gram, w in model.weights.items() if w[f] > w[0]):
            room -= gain
            if room < 0:
                needed.add(gram)
    return sorted(needed)


def _any_of(grams: list[str]) -> str:
    """A pattern found in every lower-case line that has one of the n-grams (and in few others); one branch per first character."""
    if not grams:
        return r"(?!)"
    by: dict[str, list[str]] = {}
    for g in grams:
        by.setdefault(g[0], []).append(r"[^a-z0-9\-]+".join(w.replace(".", r"\.").replace("-", r"\-") for w in g.split(" "))[1 if g[0] not in ".-" else 2 :])
    branches = [(c if c not in ".-" else "\\" + c) + "(?:" + "|".join(rest) + ")" for c, rest in sorted(by.items())]
    return rf"(?:^|[^a-z0-9.\-])(?:{'|'.join(branches)})(?=$|[^a-z0-9\-])"


def _compared(lines: DataFrame, model: Classifier) -> DataFrame:
    """Of lines (with line and context) those with less than 0.5 for `none`, with the family that is likeliest (best, top) and the similarity of its nearest template."""
    scored = _probabilities(lines.withColumn("grams", ngrams(F.col("line"))), model, likely=True)
    names = F.array(*[F.lit(n) for n in model.families])
    top = F.array_max(F.slice("p", 2, len(model.families) - 1))
    likely = scored.where(F.col("p")[0] < 0.5).withColumn("top", top).withColumn("best", F.element_at(names, F.array_position("p", F.col("top")).cast("int")))
    templates = F.create_map(*[x for f, ts in sorted(TEMPLATES.items()) for x in (F.lit(f), F.array(*[ngrams(F.lit(t)) for t in ts]))])
    share = F.array_max(F.transform(F.element_at(templates, F.col("best")), lambda t: F.size(F.array_intersect("near", t)) / F.size(t)))
    return likely.withColumn("near", F.array_union("grams", ngrams(F.col("context")))).withColumn("similarity", share)


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph that names a licence: id_col, paragraph (from 0), family, probability, similarity, confirmed, line."""
    needed = telling(model)
    lines = paragraphs(docs.where(F.col(text_col).isNotNull()), id_col, text_col, None if needed is None else _any_of(needed))
    known = F.col("top") >= model.threshold
    return _compared(lines, model).select(
        F.col("id").alias(id_col), "paragraph", F.when(known, F.col("best")).otherwise(UNKNOWN).alias("family"), F.col("top").alias("probability"),
        "similarity", (known & (F.col("similarity") >= CONFIRMED)).alias("confirmed"), "line",
    )
