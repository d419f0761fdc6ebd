"""Licence scan: a paragraph classifier over word n-grams with a calibrated unknown class and template comparison.

Only DataFrame expressions and the JVM estimators of ``pyspark.ml`` are used.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.functions import text
from lintlake.llm import common

#: Words and word pairs that are features, at most: the most frequent ones of the examples, from so many examples on.
FEATURES = 8192
MIN_EXAMPLES = 3
#: Documents whose paragraphs are examples without a licence, about (those with the smallest hash of doc_id), and
#: paragraphs taken from them, at most.
NEGATIVE_DOCUMENTS = 800
MAX_NEGATIVES = 3_000
#: Variants made of each template for the fit.
VARIANTS = 24
#: Confidence from which a family is named, and the share of a template's word pairs that has to be there.
CONFIDENT = 0.5
CONFIRMED = 0.6
#: Words that a window over several lines has besides those of the longest template.
SLACK = 20
#: Candidate lines for one file of the names of documents that are read again, about.
LINES_A_FILE = 1_000_000
NONE = "none"

# Usual wordings of licence statements, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.",
    ],
}


def words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^a-z0-9.]+|\.(?![0-9])", -1), lambda w: w != "")


def paragraphs(documents: DataFrame) -> DataFrame:
    """A row per non-blank line: two hashes that name the document's row, position, text, words."""
    body = F.coalesce("text", F.lit(""))
    rows = documents.select(F.xxhash64("doc_id", body).alias("a"), F.xxhash64(body, "doc_id").alias("b"), body.alias("body"))
    lines = rows.select("a", "b", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    return lines.filter(F.trim("line") != "").withColumn("words", words(F.col("line")))


def _grams(rows: DataFrame) -> DataFrame:
    """Words and word pairs of ``words``."""
    pairs = NGram(n=2, inputCol="words", outputCol="pairs").transform(rows)
    return pairs.withColumn("grams", F.concat("words", "pairs")).drop("pairs")


def _pairs(column: Column) -> Column:
    """Distinct word pairs; a single word counts as its own pair."""
    n = F.size(column)
    both = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", column[i - 1], column[i]))
    return F.when(n >= 2, F.array_distinct(both)).otherwise(column)


def _triples(column: Column) -> Column:
    """Word triples; fewer words count as one."""
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(column) - 1, F.lit(2))), lambda i: F.concat_ws(" ", F.slice(column, i - 1, 3)))


def templates(spark: SparkSession) -> DataFrame:
    rows = [(f, t) for f, texts in TEMPLATES.items() for t in texts]
    found = spark.createDataFrame(rows, "family string, line string").withColumn("words", words(F.col("line")))
    return found.withColumn("template_pairs", _pairs(F.col("words")))


def examples(documents: DataFrame) -> DataFrame:
    """Labelled paragraphs: templates with words left out or put before, and corpus lines without licence wording.

    The corpus lines are those of a bounded sample of documents that share no word triple with a template; equal
    lines count once.
    """
    known = templates(documents.sparkSession)
    share = int(1_000_000 * NEGATIVE_DOCUMENTS / max(1, documents.count()))
    lines = paragraphs(documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share))
    drawn = known.select("family", "words", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("v"))
    drop = lambda w, i: (F.col("v") == 0) | (F.pmod(F.xxhash64("v", i, w), F.lit(100)) >= F.col("v"))
    positive = drawn.select("family", F.filter("words", drop).alias("words"), "v")
    before = F.split(F.lit("copyright 2024 the project authors see the file for details"), " ")
    positive = positive.withColumn("words", F.when(F.col("v") % 3 == 2, F.concat(before, "words")).otherwise(F.col("words")))
    triples = known.select(F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("words") - 1, F.lit(2))), lambda i: F.concat_ws(" ", F.slice("words", i - 1, 3)))).alias("t"))
    wording = F.lit([r.t for r in triples.distinct().collect()])
    own = F.transform(F.sequence(F.lit(2), F.greatest(F.size("words") - 1, F.lit(2))), lambda i: F.concat_ws(" ", F.slice("words", i - 1, 3)))
    sampled = lines.select("words", F.xxhash64("line").alias("h")).filter(F.size("words") > 0)
    sampled = sampled.dropDuplicates(["h"]).filter(~F.arrays_overlap(own, wording))
    negative = sampled.orderBy("h").limit(MAX_NEGATIVES).select(F.lit(NONE).alias("family"), "words", F.lit(0).alias("v"))
    return positive.unionByName(negative)


def anchor_words() -> set[str]:
    """Words of which every word triple of a template has at least one; the triples' rarest words are taken first."""
    import re

    texts = [[w for w in re.split(r"[^a-z0-9.]+|\.(?![0-9])", t.lower()) if w] for ts in TEMPLATES.values() for t in ts]
    triples = {tuple(w[i : i + 3]) for w in texts for i in range(max(1, len(w) - 2))}
    chosen: set[str] = set()
    while open_ := [t for t in triples if not chosen & set(t)]:
        often = Counter(w for t in open_ for w in set(t))
        chosen.add(max(often, key=lambda w: (len(w) > 4, often[w], w)))
    return chosen


def candidate_lines(documents: DataFrame, wanted: set[str] | None) -> DataFrame:
    """Stored table of the lines with one of the ``wanted`` words (None: of all lines): a, b, pos, line, words."""
    lines = paragraphs(documents).withColumn("words", F.explode_outer(F.array("words")))  # evaluated once
    if wanted is not None:
        lines = lines.filter(F.arrays_overlap("words", F.lit(sorted(wanted))))
    return common.stored(lines)


def _named(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """The documents with one of the names (a, b), once each; these are few of them as a rule."""
    body = F.coalesce("text", F.lit(""))
    again = documents.withColumn("a", F.xxhash64("doc_id", body)).withColumn("b", F.xxhash64(body, "doc_id"))
    return again.join(asked, ["a", "b"], "left_semi").dropDuplicates(["a", "b"])


def wrapped(documents: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Notices that run over several lines: (a, b, pos, stop, line, words); pos and stop are the first and last line.

    A paragraph is a run of neighbouring lines with words; comment marks are none, so a line of marks ends it, and so
    does a line that is a whole template by itself. A window starts at each of its lines. Windows with
    ``CONFIRMED`` of the word pairs of a template are notices, one for each run of such starts, cut to the words from
    the first to the last pair found. Only documents with a line that has a part of a template are looked at; such lines
    are among ``candidates``.
    """
    if candidates is None:
        candidates = candidate_lines(documents, anchor_words())
    known = templates(documents.sparkSession).select("family", "words", "template_pairs", _triples(F.col("words")).alias("t")).collect()
    wording = F.lit(sorted({t for r in known for t in r.t}))
    width = max(len(r.words) for r in known) + SLACK
    wanted = F.array(*[F.struct(F.lit(r.family).alias("family"), F.lit(r.template_pairs).alias("pairs")) for r in known])
    share = lambda own: F.array_max(F.transform("wanted", lambda t: F.struct((F.size(F.array_intersect(t["pairs"], own)) / F.size(t["pairs"])).alias("share"), t["family"].alias("family"), t["pairs"].alias("pairs"))))
    alone = lambda rows: rows.withColumn("wanted", wanted).withColumn("alone", share(_pairs(F.col("words")))["share"] >= CONFIRMED)

    # Filters are not moved below an explode, so they do not evaluate words once per element.
    held = lambda rows, c: rows.withColumn(c, F.array(c)).withColumn(c, F.explode_outer(c))
    parts = candidates.select("a", "b", "words").filter(F.size("words") > 0).filter(F.arrays_overlap(_triples(F.col("words")), wording))
    asked = alone(parts).filter(~F.col("alone")).select("a", "b").distinct()
    # Stored in few files, so that planning sees how few documents these are; else all texts would be shuffled to find them.
    asked = common.stored(common.merged(asked, candidates.count(), LINES_A_FILE))
    lines = paragraphs(_named(documents, asked))
    lines = alone(held(lines, "words").filter(F.size("words") > 0)).filter(~F.col("alone"))
    order = Window.partitionBy("a", "b").orderBy("pos")
    blocks = (
        lines.withColumn("block", F.col("pos") - F.row_number().over(order))
        .groupBy("a", "b", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "words"))).alias("rows"))
        .filter(F.size("rows") > 1)
    )
    windows = held(
        text.inline_rows(blocks, ["a", "b", "block"], F.transform("rows", lambda _, i: F.struct(i.alias("i"), F.slice("rows", i + 1, width).alias("rows"))))
        .withColumn("at", F.flatten(F.transform("rows", lambda r, k: F.transform(r["words"], lambda _: k))))
        .withColumn("w", F.slice(F.flatten("rows.words"), 1, width)), "w"
    )
    windows = (
        windows
        .withColumn("wanted", wanted).withColumn("best", share(_pairs(F.col("w")))).filter(F.col("best.share") >= CONFIRMED)
        .select("a", "b", "block", "i", "rows", "at", "w", "best.share", "best.family", "best.pairs")
    )
    run = F.col("i") - F.row_number().over(Window.partitionBy("a", "b", "block", "family").orderBy("i"))
    best = (
        windows.withColumn("run", run).groupBy("a", "b", "block", "family", "run")
        .agg(F.max_by(F.struct("rows", "at", "w", "pairs"), F.struct("share", "i")).alias("n")).select("a", "b", "n.*")
    )
    found = F.filter(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.array_contains("pairs", F.concat_ws(" ", F.col("w")[k - 1], F.col("w")[k])))
    cut = best.withColumn("found", found).withColumn("lo", F.array_min("found")).withColumn("hi", F.array_max("found") + 1)
    first, last = F.col("at")[F.col("lo") - 1], F.col("at")[F.col("hi") - 1]
    taken = F.slice("rows", first + 1, last - first + 1)
    return cut.filter(last > first).select(
        "a", "b", F.col("rows")[first]["pos"].alias("pos"), F.col("rows")[last]["pos"].alias("stop"),
        F.array_join(taken["line"], "\n").alias("line"), F.slice("w", F.col("lo"), F.col("hi") - F.col("lo") + 1).alias("words"),
    )


class Scanner:
    """The fitted classifier and its calibration."""

    def __init__(self, families: list[str], counter: CountVectorizerModel, model: LogisticRegressionModel):
        self.families, self.counter, self.model = families, counter, model
        self.calibration: LogisticRegressionModel | None = None

    def classified(self, rows: DataFrame) -> DataFrame:
        """Add ``family``, ``margin`` and ``confidence`` to rows with ``words``."""
        got = self.model.transform(self.counter.transform(_grams(rows))).withColumn("p", vector_to_array("probability"))
        top = F.sort_array("p", asc=False)
        named = got.select(
            *rows.columns, F.lit(self.families)[F.col("prediction").cast("int")].alias("guess"), (top[0] - top[1]).alias("margin"),
        )
        return named

    def suspects(self) -> set[str] | None:
        """Words of which a line has to have one to be taken as any family; None: there is no such set.

        A gram speaks for a family where it has a larger weight there than for none. Without any such gram no family
        can reach none, given that none has the largest intercept; a pair of words counts by its first one.
        """
        intercept = self.model.interceptVector.toArray()
        if intercept[1:].max(initial=-np.inf) >= intercept[0]:
            return None
        weight = self.model.coefficientMatrix.toArray()
        speaking = np.flatnonzero((weight[1:] > weight[0]).any(axis=0))
        return {self.counter.vocabulary[i].split(" ")[0] for i in speaking}

    def confident(self, rows: DataFrame) -> DataFrame:
        scored = self.calibration.transform(VectorAssembler(inputCols=["margin"], outputCol="features").transform(rows))
        return scored.select(*rows.columns, vector_to_array("probability")[1].alias("confidence"))


def fit(documents: DataFrame) -> Scanner:
    """Fit on two thirds of the examples; the rest calibrates how often a guess with some margin is right.

    The examples are bounded by ``TEMPLATES``, ``VARIANTS`` and ``MAX_NEGATIVES``.
    """
    spark = documents.sparkSession
    families = [NONE, *TEMPLATES]
    number = F.array_position(F.lit(families), F.col("family")).cast("double") - 1
    known = examples(documents).withColumn("label", number)
    known = known.withColumn("fold", F.pmod(F.xxhash64("words", "v"), F.lit(3))).cache()
    grams = _grams(known.filter("fold > 0"))
    counter = CountVectorizer(vocabSize=FEATURES, minDF=MIN_EXAMPLES, binary=True, inputCol="grams", outputCol="features").fit(grams)
    learner = LogisticRegression(maxIter=30, regParam=0.001, elasticNetParam=0.5, family="multinomial")
    scanner = Scanner(families, counter, learner.fit(counter.transform(grams).select("features", "label")))
    judged = scanner.classified(known.filter("fold = 0")).withColumn(
        "label", (F.col("guess") == F.col("family")).cast("double")
    )
    assembled = VectorAssembler(inputCols=["margin"], outputCol="features").transform(judged)
    # A wrong guess without any margin keeps the calibration defined where all guesses are right.
    wrong = spark.createDataFrame([(0.0, 0.0)] * 5, "margin double, label double")
    wrong = VectorAssembler(inputCols=["margin"], outputCol="features").transform(wrong)
    both = assembled.select("features", "label").unionByName(wrong.select("features", "label"))
    scanner.calibration = LogisticRegression(maxIter=50, regParam=0.01).fit(both)
    known.unpersist()
    return scanner


def statements(documents: DataFrame, scanner: Scanner) -> DataFrame:
    """Licence statements: (a, b, pos, line, family, confidence, share); family 'unknown' where doubt is left.

    A line, or a notice wrapped over several, is a statement where the classifier's guess is a family. The family is
    confirmed where the confidence is at least ``CONFIDENT`` and ``CONFIRMED`` of the word pairs of one of its templates
    are there. Doubtful lines inside a notice are part of it.
    """
    suspects = scanner.suspects()
    candidates = candidate_lines(documents, None if suspects is None else suspects | anchor_words())
    notices = common.stored(wrapped(documents, candidates))
    single = _judged(documents, scanner.classified(candidates).filter(F.col("guess") != NONE), scanner)
    several = _judged(documents, scanner.classified(notices.drop("stop")), scanner)
    inside = notices.select(F.col("a").alias("na"), F.col("b").alias("nb"), F.col("pos").alias("start"), "stop")
    within = (F.col("a") == F.col("na")) & (F.col("b") == F.col("nb")) & F.col("pos").between(F.col("start"), F.col("stop"))
    own = single.join(inside, within & (F.col("family") == "unknown"), "left_anti")
    return own.unionByName(several)


def _judged(documents: DataFrame, guessed: DataFrame, scanner: Scanner) -> DataFrame:
    """The guesses, with the confidence and the share of the family's best template; ``unknown`` where one is too low."""
    spark = documents.sparkSession
    by_family = {r.family: r.t for r in templates(spark).groupBy("family").agg(F.collect_list("template_pairs").alias("t")).collect()}
    literal = F.create_map(*[x for f, t in by_family.items() for x in (F.lit(f), F.array(*[F.lit(p) for p in t]))])
    rows = scanner.confident(guessed).withColumn("own", _pairs(F.col("words")))
    rows = rows.withColumn("wanted", F.coalesce(literal[F.col("guess")], F.array().cast("array<array<string>>")))
    share = F.array_max(F.transform("wanted", lambda t: F.size(F.array_intersect(t, F.col("own"))) / F.size(t)))
    sure = (F.col("guess") != NONE) & (F.col("confidence") >= CONFIDENT) & (F.col("share") >= CONFIRMED)
    return rows.withColumn("share", share).select(
        "a", "b", "pos", "line", F.when(sure, F.col("guess")).otherwise("unknown").alias("family"), "confidence", "share"
    )


def license_report(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, families found (sorted, comma-joined), statements, unknown statements, least confidence.

    Documents without a statement, null and empty texts have no family, counts 0 and a null confidence. Rows that
    repeat a document get the same figures each: statements are counted by their position.
    """
    found = statements(documents, fit(documents)).groupBy("a", "b").agg(
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("f"),
        F.countDistinct("pos").alias("s"),
        F.countDistinct(F.when(F.col("family") == "unknown", F.col("pos"))).alias("u"),
        F.min("confidence").alias("confidence"),
    )
    body = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.xxhash64("doc_id", body).alias("a"), F.xxhash64(body, "doc_id").alias("b"))
    zero = F.lit(0).cast("long")
    return rows.join(found, ["a", "b"], "left").select(
        "doc_id", F.coalesce("f", F.lit("")).alias("families"), F.coalesce("s", zero).alias("n_statements"),
        F.coalesce("u", zero).alias("n_unknown"), "confidence",
    )
