"""Licence paragraphs in documents, by a trained paragraph classifier, in DataFrame operations only.

Word uni- and bigrams of a paragraph are the features of a sparse (L1) multinomial logistic regression over
licence families and a class for all other text. It is trained on the templates below, whole and in
parts, and on a bounded sample of the corpus's own lines. A family's probability must reach a
limit calibrated on held-out examples, else the paragraph is a licence of an unknown family. What is
predicted is confirmed by the share of a template's bigrams that the paragraph holds; a paragraph that holds
enough of a template is found whatever the classifier says of it.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titleworks.session import settle

NONE, UNKNOWN = "none", "unknown"
SAMPLE = 2000  # paragraphs of the corpus in the training set, about
CONFIRMED = 0.6  # of a template's bigrams
TERMS = 4000  # features at most
NOT_NONE = 0.25  # a licence is other text with less than this probability
WINDOW, STEP = 64, 24  # words: a run of WINDOW - STEP words lies whole in some window of a longer line
BEFORE, BEHIND = 16, 4  # words of the line before, and lines behind, that a wrapped paragraph may take

# Families and wordings by which works name them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "This project is available under the Apache License 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "This software is distributed under the terms of the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("gpl-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "Distributed under the terms of the GNU General Public License v2 only."),
    ("lgpl", "This library is free software, licensed under the GNU Lesser General Public License."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Text is available under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without the prior written permission of the publisher."),
    ("proprietary", "This document is confidential and proprietary and may not be copied or distributed."),
    (NONE, "A driving license is required for this position."),
    (NONE, "The public library opens at nine, and the general manager is there from ten."),
    (NONE, "The new version of the work was distributed to members free of charge."),
    (NONE, "He was granted permission to copy the file by the person in charge."),
    (NONE, "The source of the river and the terms of the contract are found in the file."),
]
# Words that say nothing of a licence on their own.
PLAIN_WORDS = "a an and any are as at be by can for from has have he her his i in is it its may not of on or so such that the their there this to was were which will with you your".split()


def _words(text: Column) -> Column:
    """Words of letters a-z, digits and inner `.`, `+`, `-`; capitals count as small ones."""
    return F.filter(F.transform(F.split(F.lower(text), "[^a-z0-9.+-]+"), lambda w: F.trim(w, F.lit(".+-"))), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _features(words: Column) -> Column:
    pairs = F.filter(_bigrams(words), lambda g: ~F.forall(F.split(g, " "), lambda w: w.isin(*PLAIN_WORDS)))
    return F.array_distinct(F.concat(F.array_except(words, F.array(*[F.lit(w) for w in PLAIN_WORDS])), pairs))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text): the lines of every text that are not empty, numbered from 0."""
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))
    return lines.where(F.trim("text") != "")


def _examples(spark: SparkSession) -> DataFrame:
    """(family, words): the templates, and their first and last two thirds."""
    whole = spark.createDataFrame(TEMPLATES, "family string, text string").withColumn("words", _words(F.col("text")))
    n = F.size("words")
    part = F.ceil(n * 2 / 3).cast("int")
    cut = F.explode(F.array(F.col("words"), F.slice("words", F.lit(1), part), F.slice("words", n - part + 1, part)))
    return whole.select("family", cut.alias("words"))


class Classifier:
    def __init__(self, terms: CountVectorizerModel, model: LogisticRegressionModel, families: list[str], limit: float) -> None:
        self.families, self.limit = families, limit
        weights = model.coefficientMatrix.toArray()
        self.constants = [float(x) for x in model.interceptVector]
        self.weights = {t: [float(x) for x in weights[:, i]] for i, t in enumerate(terms.vocabulary) if weights[:, i].any()}
        none = families.index(NONE)
        self.telling = sorted(t for t, w in self.weights.items() if max(w) > w[none])
        odds = [math.exp(c - max(self.constants)) for c in self.constants]
        # Whether text without a telling feature is surely other text: such features only raise NONE's share.
        self.silent_is_none = odds[none] >= NOT_NONE * sum(odds)


def train(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on the templates and about `sample` lines of docs that hold fewer than two of the templates' words, plain ones aside."""
    spark = docs.sparkSession
    examples = _examples(spark)
    marks = [w for (w,) in examples.where(F.col("family") != NONE).select(F.explode(F.array_except("words", F.array(*[F.lit(x) for x in PLAIN_WORDS])))).distinct().collect()]
    hit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    n = docs.count()
    few = docs.where(hit < F.lit(max(1, int((1 << 20) * min(1.0, sample / 8 / max(1, n))))))
    lines = paragraphs(few).where(F.pmod(F.xxhash64("doc_id", "paragraph"), F.lit(4)) == 0).select(F.lit(NONE).alias("family"), _words(F.col("text")).alias("words"))
    lines = lines.where(F.size(F.array_intersect("words", F.array(*[F.lit(m) for m in marks]))) < 2)
    families = sorted({f for f, _ in TEMPLATES})
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    rows = examples.union(lines).select(number.alias("label"), _features(F.col("words")).alias("features_of"), F.when(F.col("family") == NONE, 1.0).otherwise(4.0).alias("weight")).where(F.size("features_of") > 0)
    rows = settle(rows.repartition(4, "features_of").sortWithinPartitions("label", "features_of"), "examples")
    terms = CountVectorizer(inputCol="features_of", outputCol="features", vocabSize=TERMS, binary=True).fit(rows)
    learner = LogisticRegression(maxIter=40, regParam=0.002, elasticNetParam=0.9, weightCol="weight", family="multinomial", standardization=False)
    ready = terms.transform(rows)
    held = F.pmod(F.xxhash64("features_of"), F.lit(4)) == 0
    half = learner.fit(ready.where(~held | (F.col("label") == families.index(NONE))))
    own = half.transform(ready.where(held & (F.col("label") != families.index(NONE)))).withColumn("p", F.get(_array("probability"), F.col("label").cast("int")))
    low = own.where("prediction = label").agg(F.percentile_approx("p", 0.05)).first()[0]
    return Classifier(terms, learner.fit(ready), families, min(0.9, max(0.3, low or 0.3)))


def _array(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(column))


def _template_bigrams() -> list[tuple[str, list[str]]]:
    out = []
    for family, text in TEMPLATES:
        words = [w for w in (w.strip(".+-") for w in re.split("[^a-z0-9.+-]+", text.lower())) if w]
        if family != NONE:
            out.append((family, sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})))
    return out


def anchors(classifier: Classifier) -> list[str]:
    """Words of which every licence paragraph holds one.

    They are a word of every telling feature, and as many of a template's longest words as it takes that no
    CONFIRMED of its bigrams are without one.
    """
    plain_last = lambda w: (w in PLAIN_WORDS, -len(w), w)
    found = {min(t.split(" "), key=plain_last) for t in classifier.telling}
    for _, own in _template_bigrams():
        for word in sorted({w for pair in own for w in pair.split(" ")}, key=plain_last):
            if sum(not found & set(pair.split(" ")) for pair in own) < CONFIRMED * len(own):
                break
            found.add(word)
    return sorted(found)


def _cut(own: Column) -> Column:
    """The words of a line as one list, or as windows if there are many."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(own) - (WINDOW - STEP), F.lit(1)), F.lit(STEP))
    return F.when(F.size(own) <= WINDOW, F.array(own)).otherwise(F.transform(starts, lambda i: F.slice(own, i, WINDOW)))


def _joined(before: Column, own: Column, after: Column) -> Column:
    """The words of a line between the end of the line before and the lines behind."""
    last = _let(_words(before), lambda w: F.slice(w, F.greatest(F.size(w) - BEFORE + 1, F.lit(1)), BEFORE))
    return F.concat(last, own, F.slice(_words(after), 1, WINDOW))


def _judged(classifier: Classifier, words: Column) -> Column:
    """(confirmed, share, probability, family) of one list of words; null where it is other text."""
    single = [t for t in classifier.weights if " " not in t]
    double = [t for t in classifier.weights if " " in t]
    listed = lambda terms: F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    terms = [*single, *double]
    table = F.array(*[F.array(*[F.lit(x) for x in classifier.weights[t]]) for t in terms]) if terms else None
    names = F.array(*[F.lit(f) for f in classifier.families])
    none = classifier.families.index(NONE)
    templates = _template_bigrams()
    known = sorted({pair for _, own in templates for pair in own})
    made = F.array(*[F.struct(F.lit(f).alias("family"), listed(own).alias("own")) for f, own in templates])

    def of_pairs(pairs: Column) -> Column:
        own = F.concat(F.filter(words, lambda w: w.isin(*single)), F.filter(pairs, lambda g: g.isin(*double)))
        weights = F.transform(F.array_distinct(own), lambda t: F.get(table, F.array_position(listed(terms), t).cast("int") - 1)) if terms else F.array().cast("array<array<double>>")
        constant = F.array(*[F.lit(x) for x in classifier.constants])
        logits = F.aggregate(weights, constant, lambda done, w: F.zip_with(done, w, lambda a, b: a + b))
        odds = _let(logits, lambda x: _let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
        held = F.array_distinct(F.filter(pairs, lambda g: g.isin(*known)))
        shares = F.when(F.size(held) > 0, _let(held, lambda h: F.transform(made, lambda t: F.struct((F.size(F.array_intersect(t["own"], h)) / F.size(t["own"])).alias("share"), t["family"].alias("family"), F.size(F.array_intersect(t["own"], h)).alias("n")))))
        shares = F.coalesce(shares, F.array().cast("array<struct<share:double,family:string,n:int>>"))
        return _let(F.struct(odds.alias("odds"), shares.alias("shares")), lambda x: verdict(x["odds"], x["shares"]))

    def verdict(odds: Column, shares: Column) -> Column:
        total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
        ranked = F.filter(F.zip_with(odds, names, lambda o, f: F.struct(o.alias("odds"), f.alias("family"))), lambda x: x["family"] != NONE)
        best = F.struct((F.get(odds, none) / total).alias("none"), total.alias("total"), F.array_max(ranked).alias("own"), F.array_max(shares).alias("nearest"))
        return _let(best, lambda x: choose(x, odds, shares))

    def choose(x: Column, odds: Column, shares: Column) -> Column:
        probability = x["own"]["odds"] / x["total"]
        licence = x["none"] < NOT_NONE
        family = F.when(licence & (probability >= classifier.limit), x["own"]["family"])
        own_share = F.coalesce(F.array_max(F.transform(F.filter(shares, lambda s: s["family"] == family), lambda s: s["share"])), F.lit(0.0))
        nearest = F.coalesce(x["nearest"]["share"], F.lit(0.0))
        by_template = (own_share < CONFIRMED) & (nearest >= CONFIRMED)
        name = F.when(by_template, x["nearest"]["family"]).otherwise(F.coalesce(family, F.lit(UNKNOWN)))
        of_name = F.get(odds, F.array_position(names, name).cast("int") - 1) / x["total"]
        share = F.when(by_template, nearest).otherwise(own_share)
        row = F.struct((share >= CONFIRMED).alias("confirmed"), share.alias("share"), F.when(name == UNKNOWN, probability).otherwise(of_name).alias("probability"), name.alias("family"), shares.alias("hits"))
        return F.when(licence | by_template, row)

    return _let(_bigrams(words), of_pairs)


def licences(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, paragraph, family, probability, template_share, confirmed) of every paragraph taken for a licence.

    A paragraph is judged as a line, as the windows of a long line, and, where lines of a block follow one another without an empty
    line, as a line with the end of the one before and the lines behind it, so that a wrapped notice counts as
    a whole; `paragraph` is the number of the line. A wrapped notice is reported once, at its first line that has a word
    which tells of licences and two neighbouring words of a template; lines that belong to it are not reported for themselves. Where the best family stays below the calibrated limit the family is `unknown`. confirmed: CONFIRMED
    of the bigrams of one of the family's templates occur; a paragraph that holds so many of a template is reported with the
    template's family even where the classifier takes it for other text. Of equal shares the likelier, then
    the later name counts. Long lines are judged whole, window by window. Null and empty texts have no paragraphs; a null doc_id is kept;
    repeated rows give repeated rows; an empty table none. Other columns are ignored.
    """
    telling = anchors(classifier)
    tells = lambda line: F.exists(F.split(F.lower(line), "[^a-z0-9.+-]+"), lambda w: F.trim(w, F.lit(".+-")).isin(*telling))
    if not classifier.silent_is_none:
        tells = lambda line: line.rlike(r"\S")
    known = sorted({pair for _, own in _template_bigrams() for pair in own})
    lines = F.col("lines")
    empty = lambda line: ~line.rlike(r"\S")
    blank = F.lit("")

    def behind(i: Column) -> Column:
        """The lines behind line i up to an empty one, BEHIND at most."""
        start = F.struct(F.lit(False).alias("done"), blank.alias("text"))
        ended = lambda got: F.struct(F.lit(True).alias("done"), got["text"].alias("text"))
        longer = lambda got, x: F.struct(F.lit(False).alias("done"), F.concat_ws(" ", got["text"], x).alias("text"))
        step = lambda got, x: F.when(got["done"] | empty(x), ended(got)).otherwise(longer(got, x))
        return F.aggregate(F.slice(lines, i + 2, BEHIND), start, step, lambda got: got["text"])

    def judged(i: Column) -> Column:
        before = F.when(i > 0, F.get(lines, i - 1)).otherwise(blank)
        return _let(_words(F.get(lines, i)), lambda own: alone_or_wrapped(i, own, before))

    def alone_or_wrapped(i: Column, own: Column, before: Column) -> Column:
        best = F.array_max(F.transform(_cut(own), lambda words: _judged(classifier, words)))
        starts = (F.size(own) <= WINDOW) & F.exists(_bigrams(own), lambda g: g.isin(*known))
        wrapped = lambda: _judged(classifier, _joined(before, own, behind(i)))
        alone = lambda found: F.struct(i.alias("paragraph"), F.lit(False).alias("wrapped"), found.alias("found"))
        other = lambda found, j: F.when(j["confirmed"], F.struct(i.alias("paragraph"), F.lit(True).alias("wrapped"), j.alias("found"))).otherwise(alone(found))
        done = lambda found: F.coalesce(found["confirmed"], F.lit(False)) | ~starts
        return _let(best, lambda found: F.when(done(found), alone(found)).otherwise(_let(wrapped(), lambda j: other(found, j))))

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.split("text", "\n").alias("lines")).where("lines is not null")
    rows = texts.withColumn("at", F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: tells(F.get(lines, i))))
    rows = rows.select("doc_id", F.filter(F.transform("at", judged), lambda r: r["found"].isNotNull()).alias("rows"))

    def hits(r: Column, family: Column) -> Column:
        own = F.filter(r["found"]["hits"], lambda h: h["family"] == family)
        return F.coalesce(F.array_max(F.transform(own, lambda h: h["n"])), F.lit(0))

    def once(r: Column, k: Column) -> Column:
        """Whether no neighbour tells of the same notice better."""
        near = F.slice("rows", F.greatest(k + 1 - BEHIND, F.lit(1)), 2 * BEHIND + 1)
        mine = r["found"]

        def better(q: Column) -> Column:
            other = q["found"]
            earlier = (other["share"] == mine["share"]) & (q["paragraph"] < r["paragraph"])
            again = r["wrapped"] & (other["family"] == mine["family"]) & (~q["wrapped"] | (other["share"] > mine["share"]) | earlier)
            part_of = q["wrapped"] & (other["share"] > mine["share"]) & (hits(r, other["family"]) >= F.greatest(hits(r, mine["family"]), F.lit(1)))
            return other["confirmed"] & (F.abs(q["paragraph"] - r["paragraph"]) <= BEHIND) & (again | part_of)

        return ~F.exists(near, better)

    out = rows.select("doc_id", F.inline(F.filter("rows", once)))
    return out.select("doc_id", F.col("paragraph"), "found.family", "found.probability", F.col("found.share").alias("template_share"), "found.confirmed")
