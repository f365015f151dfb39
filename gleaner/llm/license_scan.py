"""Licence notices found by a trained paragraph classifier, in DataFrame functions only.

A multinomial logistic regression over word unigrams and bigrams names the licence
family of a paragraph; paragraphs whose best family stays below a calibrated
probability are unknown, and a prediction counts only if a template of that family
confirms it.  Features are n-grams that notices have far more often than other
paragraphs, so a paragraph without any of their words is unknown without being scored.

The classifier is trained on the templates with words dropped, and on a bounded sample
of corpus paragraphs (``SAMPLE``) that templates label.  Every paragraph is scanned.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans.sizing import materialise

# Wordings of public licence notices.
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "This project is licensed under the terms of the Apache License 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Released under the BSD License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright. All rights reserved."),
]

UNKNOWN = "unknown"
# Corpus paragraphs drawn for training, in expectation, and copies of each template.
SAMPLE, COPIES = 6000, 24
# Words of a paragraph that are judged together; longer ones are judged in overlapping windows.
WINDOW, STRIDE = 40, 20
# A feature is this many times as frequent in notices as in other paragraphs.
LIFT = 20.0
# Share of a template's bigrams that label a training paragraph, and that confirm a prediction.
LABELLED, CONFIRMED = 0.8, 0.6
# Least probability of a family, whatever the calibration says.
FLOOR = 0.5
# Share of held-out paragraphs without a notice that may pass the calibrated threshold.
FALSE_RATE = 0.001


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w, i: F.concat_ws(" ", F.get(words, i), w))
    return F.array_distinct(pairs)


def _grams(words: Column) -> Column:
    return F.array_union(F.array_distinct(words), _bigrams(words))


def _windows(words: Column) -> Column:
    last = F.greatest(F.size(words) - WINDOW + STRIDE - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(STRIDE))
    return F.transform(starts, lambda i: F.slice(words, i + 1, WINDOW))


def _paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, paragraph, words): the lines of each text, counted from 0."""
    lines = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(id_col, text_col).alias("key"),
        F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("paragraph", "line"),
    )
    return lines.select("doc_id", "key", "paragraph", _words(F.col("line")).alias("words"))


def _wrapped(docs: DataFrame, anchors: list[str], id_col: str, text_col: str) -> DataFrame:
    """(key, words, lines): windows over the words of a whole text that cross line breaks.

    ``lines`` holds the line of each word.  Windows without an anchor are left out.
    """
    parts = F.transform(F.split(F.col(text_col), "\n"), _words)
    rows = docs.filter(F.contains(F.col(text_col), F.lit("\n"))).select(F.xxhash64(id_col, text_col).alias("key"), parts.alias("parts"))
    rows = rows.select(
        "key",
        F.flatten("parts").alias("words"),
        F.flatten(F.transform("parts", lambda words, i: F.array_repeat(i, F.size(words)))).alias("lines"),
    )
    last = F.greatest(F.size("words") - WINDOW + STRIDE - 1, F.lit(0))
    starts = F.filter(
        F.sequence(F.lit(0), last, F.lit(STRIDE)),
        lambda i: (F.get("lines", i) < F.get("lines", F.least(i + WINDOW, F.size("lines")) - 1))
        & F.exists(F.slice("words", i + 1, WINDOW), lambda w: w.isin(anchors)),
    )
    cut = F.transform(starts, lambda i: F.struct(F.slice("words", i + 1, WINDOW).alias("words"), F.slice("lines", i + 1, WINDOW).alias("lines")))
    # An inner explode would be filtered below the projections, with all of them inlined per word.
    cuts = rows.select("key", F.explode_outer(cut).alias("cut")).filter("cut is not null")
    return materialise(cuts.select("key", "cut.words", "cut.lines"))


def _templates(spark: SparkSession) -> DataFrame:
    """A fixed number of rows (family, templates: the bigrams of each wording)."""
    rows = spark.createDataFrame(TEMPLATES, "family string, wording string")
    return rows.select("family", "wording", _words(F.col("wording")).alias("words"))


def _likeness(grams: Column, templates: Column) -> Column:
    """The largest share of a template's bigrams that the paragraph has."""
    return F.array_max(F.transform(templates, lambda t: F.size(F.array_intersect(t, grams)) / F.size(t)))


class Classifier:
    """Vocabulary, regression, families by label, and the calibrated threshold."""

    def __init__(self, vocabulary: list[str], anchors: list[str], families: list[str], regression: LogisticRegressionModel, threshold: float) -> None:
        self.vocabulary, self.anchors, self.families = vocabulary, anchors, families
        self.regression, self.threshold = regression, threshold

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with ``grams`` -> family (or unknown) and its probability."""
        return _predict(rows, self.vocabulary, self.families, self.regression, self.threshold)


def _vectors(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", binary=True)
    return model.transform(rows)


def _predict(rows: DataFrame, vocabulary: list[str], families: list[str], regression: LogisticRegressionModel, threshold: float) -> DataFrame:
    scored = regression.transform(_vectors(rows, vocabulary))
    chances = F.slice(vector_to_array("probability"), 2, len(families) - 1)
    scored = scored.withColumn("chance", F.array_max(chances))
    names = F.array(*[F.lit(f) for f in families[1:]])
    best = F.get(names, F.array_position(chances, F.col("chance")).cast("int") - 1)
    return scored.withColumn("family", F.when(F.col("chance") >= threshold, best).otherwise(F.lit(UNKNOWN))).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    """Fit the regression and calibrate its unknown class.

    About ``sample`` paragraphs are drawn by a hash of id, text and place; those that
    hold a template's bigrams almost whole are examples of its family, those that hold
    half of one are left out, and all others are examples of no licence.
    """
    spark = docs.sparkSession
    templates = _templates(spark)
    pairs_of = {(r["family"], r["wording"]): r["pairs"] for r in templates.select("family", "wording", _bigrams(F.col("words")).alias("pairs")).collect()}
    wordings = F.array(
        *[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, pairs_of[f, w])).alias("grams")) for f, w in TEMPLATES]
    )
    lines = _paragraphs(docs, id_col, text_col).filter(F.size("words") > 0)
    # One aggregate of the table: how many paragraphs there are.
    breaks = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1
    total = docs.agg(F.coalesce(F.sum(breaks), F.lit(0)).alias("n")).first()["n"]
    drawn = lines.filter(F.pmod(F.xxhash64("key", "paragraph"), F.lit(max(1, total))) < sample)
    # Written, so that the words of a line are cut once and not for every template; their
    # bigrams are bound for the same reason.
    drawn = materialise(drawn.select(F.xxhash64("key", "paragraph").alias("place"), F.slice("words", 1, WINDOW).alias("words")))
    shares = lambda pairs: F.transform(wordings, lambda t: F.struct(
        (F.size(F.array_intersect(t["grams"], pairs)) / F.size(t["grams"])).alias("share"), t["family"].alias("family")
    ))
    best = F.get(F.transform(F.array(_bigrams(F.col("words"))), lambda pairs: F.array_max(shares(pairs))), 0)
    judged = drawn.withColumn("best", best)
    label = F.when(F.col("best.share") >= LABELLED, F.col("best.family")).when(F.col("best.share") < 0.5, F.lit(UNKNOWN))
    negatives = judged.select("place", "words", label.alias("family")).filter("family is not null")
    copies = templates.select("family", "words", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"))
    dropped = F.filter("words", lambda w, i: (F.col("copy") == 0) | (F.pmod(F.xxhash64(w, i, F.col("copy")), F.lit(10)) > 0))
    positives = copies.select(F.xxhash64("family", "words", "copy").alias("place"), dropped.alias("words"), "family")
    blank = spark.range(1).select(F.lit(1).cast("long").alias("place"), F.array().cast("array<string>").alias("words"), F.lit(UNKNOWN).alias("family"))
    rows = materialise(
        positives.unionByName(negatives).unionByName(blank).select("place", "family", _grams(F.col("words")).alias("grams"))
    )
    sizes = {r["none"]: r["n"] for r in rows.groupBy((F.col("family") == UNKNOWN).alias("none")).agg(F.count("*").alias("n")).collect()}
    seen = (
        rows.select((F.col("family") == UNKNOWN).cast("int").alias("none"), F.explode("grams").alias("gram"))
        .groupBy("gram")
        .agg(F.sum(1 - F.col("none")).alias("yes"), F.sum("none").alias("no"))
        .filter(F.col("yes") / sizes[False] >= LIFT * F.col("no") / sizes[True])
        .filter("yes > 1")
        .select("gram", "no")
        .collect()
    )
    vocabulary = sorted(r["gram"] for r in seen)
    # A feature can only occur where its own words do; its rarest word is its anchor.
    wanted = sorted({w for gram in vocabulary for w in gram.split(" ")})
    rare = {
        r["gram"]: r["no"]
        for r in rows.select((F.col("family") == UNKNOWN).cast("int").alias("none"), F.explode("grams").alias("gram"))
        .filter(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("none").alias("no")).collect()
    }
    anchors = sorted({min(gram.split(" "), key=lambda w: (rare.get(w, 0), w)) for gram in vocabulary})
    families = [UNKNOWN, *sorted({family for family, _ in TEMPLATES})]
    labels = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    fitted = materialise(_vectors(rows.withColumn("label", labels), vocabulary).select("place", "label", "grams", "features"))
    held = F.pmod("place", F.lit(5)) == 0
    regression = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=40).fit(
        fitted.filter(~held | (F.col("label") > 0)).coalesce(4)
    )
    calm = _predict(fitted.filter(held & (F.col("label") == 0)).select("grams"), vocabulary, families, regression, 0.0)
    high = calm.agg(F.percentile("chance", 1 - FALSE_RATE).alias("p")).first()["p"]
    return Classifier(vocabulary, anchors, families, regression, min(max(FLOOR, high or 0.0), 0.99))


def scan(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, notices) per row of ``docs``.

    ``notices`` lists the lines with a known family: paragraph (the line, from 0), family,
    chance, likeness and whether a template confirms it.  A notice wrapped over several
    lines counts if a template confirms it, at its first line, unless a line of it is a
    confirmed notice of that family by itself.  ``license`` is the confirmed family
    of highest chance (ties: the smaller name), else null.  Null and empty texts have no
    notice.  Rows that repeat both id and text get equal results; a null id is kept.
    """
    spark = docs.sparkSession
    lines = _paragraphs(docs, id_col, text_col)
    lines = lines.filter(F.exists("words", lambda w: w.isin(classifier.anchors)))
    windows = lines.select("key", "paragraph", F.explode(_windows(F.col("words"))).alias("words"))
    windows = windows.filter(F.exists("words", lambda w: w.isin(classifier.anchors)))
    templates = _templates(spark).groupBy("family").agg(F.collect_list(_bigrams(F.col("words"))).alias("templates"))
    best = F.struct("confirmed", "chance", "likeness", "family")

    def judged(rows: DataFrame) -> DataFrame:
        found = classifier.predict(rows.withColumn("grams", _grams(F.col("words"))))
        checked = found.filter(F.col("family") != UNKNOWN).join(F.broadcast(templates), "family")
        checked = checked.withColumn("likeness", _likeness(F.col("grams"), F.col("templates")))
        return checked.withColumn("confirmed", F.col("likeness") >= CONFIRMED)

    per_line = materialise(judged(windows).groupBy("key", "paragraph").agg(F.max(best).alias("b")))
    # A window has one family, so lines that are a notice by themselves are taken out first.
    alone = per_line.filter("b.confirmed").groupBy("key").agg(F.collect_set("paragraph").alias("alone"))
    wrapped = _wrapped(docs, classifier.anchors, id_col, text_col).join(alone, "key", "left")
    free = lambda x, i: ~F.coalesce(F.array_contains("alone", F.get("lines", i)), F.lit(False))
    wrapped = wrapped.select("key", *[F.filter(c, free).alias(c) for c in ("words", "lines")])
    checked = judged(materialise(wrapped.filter(F.exists("words", lambda w: w.isin(classifier.anchors)))))
    # A wrapped notice begins at the first three words in a row that a template has.
    known = F.flatten("templates")
    pairs = F.transform("words", lambda w, i: F.array_contains(known, F.concat_ws(" ", w, F.get("words", i + 1))))
    begin = F.array_position(F.transform(pairs, lambda x, i: x & F.coalesce(F.get(pairs, i + 1), F.lit(False))), True)
    end = F.size("words") - F.array_position(F.reverse(pairs), True).cast("int") + 1
    span = checked.filter("confirmed").withColumn("begin", F.greatest(begin.cast("int") - 1, F.lit(0)))
    span = span.select("*", F.get("lines", F.col("begin")).alias("first"), F.get("lines", F.least(end, F.size("lines") - 1)).alias("last"))
    per_span = span.groupBy("key", "first", "family").agg(F.max("last").alias("last"), F.max(best).alias("b"))
    every = materialise(
        per_line.select("key", "paragraph", F.col("paragraph").alias("last"), "b", F.lit(False).alias("wrapped")).unionByName(
            per_span.select("key", F.col("first").alias("paragraph"), "last", "b", F.lit(True).alias("wrapped"))
        ).groupBy("key").agg(F.collect_list(F.struct("paragraph", "last", "b", "wrapped")).alias("all"))
    )
    # Overlapping windows see one notice; lines that are part of a wrapped one are not notices.
    inside = lambda n, m: (m["paragraph"] >= n["paragraph"]) & (m["paragraph"] <= n["last"])
    repeats = lambda n, m: (m["b"]["family"] == n["b"]["family"]) & m["b"]["confirmed"] & F.when(
        m["wrapped"], (m["paragraph"] < n["paragraph"]) & (n["paragraph"] <= m["last"])
    ).otherwise(inside(n, m))
    kept = F.filter("all", lambda n: ~n["wrapped"] | ~F.exists("all", lambda m: repeats(n, m)))
    every = every.select("key", kept.alias("kept"))
    part = lambda n, m: m["wrapped"] & (m["b"]["family"] == n["b"]["family"]) & inside(m, n)
    whole = F.filter("kept", lambda n: n["wrapped"] | n["b"]["confirmed"] | ~F.exists("kept", lambda m: part(n, m)))
    notice = lambda n: F.struct(n["paragraph"].alias("paragraph"), *[n["b"][c].alias(c) for c in ("family", "chance", "likeness", "confirmed")])
    per_text = materialise(every.select("key", F.sort_array(F.transform(whole, notice)).alias("notices")))
    ranked = F.array_sort(F.transform(F.filter("notices", lambda n: n["confirmed"]), lambda n: F.struct((-n["chance"]).alias("c"), n["family"].alias("family"))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"))
    empty = F.array().cast(per_text.schema["notices"].dataType)
    return rows.join(per_text, "key", "left").select(
        "doc_id", F.get(ranked, 0)["family"].alias("license"), F.coalesce("notices", empty).alias("notices")
    )
