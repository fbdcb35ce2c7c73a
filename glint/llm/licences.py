"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates, in DataFrame operations only.

A paragraph is the run of lines between blank lines, so a notice may be wrapped; it is scanned whole and line by line, so
that a notice of one line among others stands alone too. Of more than ``WINDOW`` words, each run of so many, a new one
every ``STEP`` words, is scanned. Features are hashed words and word pairs. A multinomial logistic regression over the licence families and ``unknown`` is fitted with
``pyspark.ml`` on the templates' own sentences (whole, and with random words lost) against paragraphs of the corpus that share no
rare template words (at most ``NEGATIVES`` of them, a documented bound, chosen by hash). A calibrated threshold, set on held-out
training paragraphs, decides between unknown and the best family; the share of a template's word pairs that the paragraph
has confirms it.

Scoring is in two steps. For any family, its log odds over unknown are at most the sum of each feature's largest
advantage over unknown in any family; one array lookup by feature gives that bound, and only paragraphs whose bound
reaches the threshold (a few) are scored for every family. No paragraph that could be accepted is lost.

Defined cases: null or empty text has no paragraphs, so family ``unknown`` and score 0; ties go to the family first in order;
repeated rows are scanned alike; an empty table is scanned to an empty result (the model then knows only the
templates); further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.llm import scratch

UNKNOWN = "unknown"
DIMS = 2048
WINDOW = 96
STEP = 72
NEGATIVES = 4000
LOST = 6
COVER = 0.5
PAIR_SEED = 17

#: What the families' notices commonly say.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc": (
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "All rights reserved. No part of this work may be reproduced without prior written permission.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ),
}


_WORD = r"[\p{L}\p{N}]+(?:[.\-]+[\p{L}\p{N}]+)*"


def words(text: Column) -> Column:
    """Words in lower case; stops and hyphens only inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def features(w: str) -> Column:
    """Indexes of the different hashed words and word pairs of the array ``w``."""
    one = f"transform({w}, x -> cast(pmod(xxhash64(x), {DIMS}) as int))"
    two = f"transform({w}, (x, i) -> cast(pmod(xxhash64(x, coalesce(get({w}, i + 1), ''), {PAIR_SEED}), {DIMS}) as int))"
    return F.expr(f"array_distinct(concat({one}, {two}))")


@dataclass
class Model:
    families: list[str]
    weights: list[list[float]]  # of each family, less those of unknown
    biases: list[float]
    threshold: float  # on the log odds of the best family against unknown

    def numbers(self, values: list[float]) -> Column:
        """A constant array, as one literal."""
        return F.expr("cast(split('" + ",".join(f"{v:.6g}" for v in values) + "', ',') as array<double>)")

    def bound(self, index: str) -> Column:
        most = self.numbers([max(w[i] for w in self.weights) for i in range(DIMS)])
        return F.aggregate(index, F.lit(max(self.biases)), lambda a, i: a + F.get(most, i))

    def odds(self, index: str) -> Column:
        """(log odds, family) of the best family."""
        def total(values: list[float], bias: float) -> Column:
            own = self.numbers(values)
            return F.aggregate(index, F.lit(bias), lambda a, i: a + F.get(own, i))

        each = [F.struct(total(w, b).alias("odds"), F.lit(-k).alias("first"), F.lit(f).alias("family")) for k, (f, w, b) in enumerate(zip(self.families, self.weights, self.biases, strict=True))]
        return F.array_max(F.array(*each))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), p (number of the paragraph), w (words) for each paragraph and each of its lines, in windows."""
    # all before the explode, so that what follows refers to its output and no filter repeats the work
    runs = F.transform(F.split(F.col("text").cast("string"), r"\n\s*\n"), lambda r: F.filter(F.transform(F.split(r, "\n"), words), lambda w: F.size(w) > 0))
    cut = f"transform(if(size(r) > 1, concat(r, array(flatten(r))), r), w -> if(size(w) <= {WINDOW}, array(w), transform(sequence(0, size(w) - {WINDOW - STEP} - 1, {STEP}), i -> slice(w, i + 1, {WINDOW}))))"
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), runs.alias("runs"))
    found = each.select("doc_id", "h", F.explode(F.expr(f"flatten(transform(runs, (r, p) -> transform(flatten({cut}), w -> struct(p as p, w as w))))")).alias("f"))
    return found.select("doc_id", "h", "f.p", "f.w")


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    return spark.createDataFrame(rows, "family string, text string").select("family", "text", words(F.col("text")).alias("w"))


def fit(docs: DataFrame) -> Model:
    """Train on the templates against a bounded sample of the corpus."""
    spark = docs.sparkSession
    templates = _templates(spark)
    # each template whole, and with one word in LOST lost in as many ways
    varied = templates.select("family", F.explode(F.sequence(F.lit(0), F.lit(LOST))).alias("v"), "w").select(
        "family", "v", F.expr(f"if(v = 0, w, filter(w, (x, i) -> pmod(xxhash64(x, i, v), {LOST}) <> 0))").alias("w")
    )
    cues = F.array_distinct(F.flatten(F.collect_list(F.filter("w", lambda x: F.length(x) >= 6))))
    cues = templates.agg(cues.alias("cues")).first().cues
    share = min(1.0, 3.0 * NEGATIVES / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    plain = paragraphs(some).where(~F.arrays_overlap("w", F.array(*[F.lit(c) for c in cues])))
    # those of small hashes only, about twice as many as are needed, so that what is sorted is no more in a large corpus
    least = F.lit(-(1 << 63) + int((1 << 64) * min(1.0, 2.0 * NEGATIVES / max(1, plain.count()))) - 1)
    plain = plain.where(F.xxhash64("w") <= least).orderBy(F.xxhash64("w"), "w").limit(NEGATIVES).select(F.lit(UNKNOWN).alias("family"), F.pmod(F.xxhash64("w"), F.lit(LOST + 1)).cast("int").alias("v"), "w")
    names = [UNKNOWN, *sorted(TEMPLATES)]
    label = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("family")).cast("double") - 1
    sparse = CountVectorizerModel.from_vocabulary([str(i) for i in range(DIMS)], "x", "features")
    rows = varied.unionByName(plain).withColumn("x", features("w")).select(label.alias("label"), "v", "x")
    rows = sparse.transform(rows.withColumn("x", F.col("x").cast("array<string>"))).where("label >= 0").select("label", "v", "features").coalesce(2).cache()
    model = LogisticRegression(maxIter=40, regParam=0.003, elasticNetParam=1.0, family="multinomial").fit(rows.where(F.col("v") != 1))
    m, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    fitted = Model(names[1:], (m[1:] - m[0]).tolist(), (b[1:] - b[0]).tolist(), 0.0)
    # calibration on the rows that weren't fitted (v = 1): half way between the two kinds, at even odds at least
    held = model.transform(rows.where("v = 1")).select("label", F.expr("rawPrediction").alias("raw")).collect()  # a part of the bounded sample
    rows.unpersist()
    odds = [(r.label > 0, max(r.raw[1:]) - r.raw[0]) for r in held]
    known, unknown = sorted(o for k, o in odds if k), sorted(o for k, o in odds if not k)
    if known and unknown:
        low, high = unknown[-1], known[len(known) // 20]
        fitted.threshold = max(0.0, (low + high) / 2)
    return fitted


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, licence, predicted, score, confirmed, n_paragraphs (that a family was found in) for each row of docs; a prediction that no template confirms leaves the licence unknown."""
    spark = docs.sparkSession
    found = paragraphs(docs).withColumn("x", features("w"))
    near = scratch.cut(found.where(model.bound("x") >= model.threshold), "licence-paragraphs")  # few
    found = near.withColumn("best", model.odds("x")).where(F.col("best.odds") >= model.threshold)
    pairs = lambda w: F.expr(f"array_distinct(transform(slice({w}, 1, greatest(size({w}) - 1, 0)), (a, i) -> concat(a, ' ', {w}[i + 1])))")
    templates = _templates(spark).select(F.col("family").alias("f"), pairs("w").alias("tp"))
    templates = templates.groupBy("f").agg(F.collect_list("tp").alias("tps"))
    found = found.select("doc_id", "h", "p", "best", pairs("w").alias("pp")).join(F.broadcast(templates), F.col("best.family") == F.col("f"))  # one row for each family
    cover = F.array_max(F.transform("tps", lambda t: F.size(F.array_intersect(t, F.col("pp"))) / F.greatest(F.size(t), F.lit(1))))
    found = found.select("doc_id", "h", "p", F.struct((cover >= COVER).alias("confirmed"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("best.odds")))).alias("score"), F.col("best.first").alias("first"), F.col("best.family").alias("family")).alias("hit"))
    by_doc = found.groupBy(F.col("doc_id").alias("of"), F.col("h").alias("oh")).agg(F.max("hit").alias("hit"), F.size(F.collect_set("p")).alias("n"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    rows = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("oh")), "left")
    family, confirmed = F.coalesce("hit.family", F.lit(UNKNOWN)), F.coalesce("hit.confirmed", F.lit(False))
    return rows.select("doc_id", F.when(confirmed, family).otherwise(UNKNOWN).alias("licence"), family.alias("predicted"), F.coalesce("hit.score", F.lit(0.0)).alias("score"), confirmed.alias("confirmed"), F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"))
