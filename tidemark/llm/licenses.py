"""Licence scans by a trained paragraph classifier.

Method: paragraphs (lines, long ones in overlapping windows, and the words around every line end) become
sparse indicators of word one-grams and two-grams out of a bounded vocabulary; a multinomial logistic
regression gives each a licence family or `unknown`. It is trained on variants of templates, against
paragraphs of the corpus and sentences that speak of licences without granting one. Probabilities are
calibrated by a temperature on paragraphs kept aside, which also tell how sure of a family the model must
be. Only what the model believes gives a row. Then a template comparison by three-word sequences
confirms the family, or doesn't.

All on DataFrame functions and Spark's own machine-learning library. The model is fitted on a bounded
sample; then every paragraph of every text is judged where it is read, but for those around line
ends that hold too little of any template to be confirmed. Nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import text_of, unpacked, whole
from tidemark.session import stored

UNKNOWN = "unknown"
SAMPLE = 4_000  # documents whose paragraphs the model is trained on, about
VARIANTS = 24  # of each template
FEATURES = 1 << 12  # one-grams and two-grams of the vocabulary: those of the templates, then the sample's commonest
LONGEST = 64  # characters of a gram of the vocabulary
WINDOW, STEP = 56, 28  # words of a long line that are judged together, and words from one window to the next
REACH = 28  # words on each side of a line end that are judged together; no template has more
REGULARISATION = 1e-6  # of the regression; notices of few words in long paragraphs need great weights
PROBABILITY = 0.5  # calibrated probability of a family, at least
FALSE_ALARMS = 0.001  # share of the corpus paragraphs kept aside that may look like a licence
DRAWS = 4  # paragraphs that a document gives to the sample, at most
CONFIRMED = 0.6  # share of a template's three-word sequences that the paragraph holds
WRAPPED = -1  # the `part` of a notice that only several lines hold together
MARK = "spdx-license-identifier"  # begins notices of two words
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)

# Notices as they are commonly written, by family.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "Licensed under the GNU General Public License, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "This work is dedicated to the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without written permission.",
        "This document is confidential and proprietary; copying and distribution are prohibited.",
    ),
}
# Sentences that speak of licences, software or rights and grant nothing.
OTHERS = (
    "The driver lost the license and had to renew it at the public office.",
    "The general public was told about the new version of the library.",
    "A fishing license costs more this year than the last one.",
    "Students at MIT released the results of their work under the supervision of a professor.",
    "The Apache helicopter was released from service under the new rules.",
    "The commons of the town are used by the public for grazing.",
    "Attribution of the painting to the master is in doubt.",
    "Please read the terms and conditions before you use the service.",
    "The software is sold with a warranty of two years.",
    "Version 2.0 of the program was released in spring.",
    "The rights of the author were discussed in court.",
    "The source code of the form was changed in the last version.",
    "It is permitted to use the pool with or without a guest.",
    "This work is part of a larger project on public law.",
)


def words_of(text: Column) -> Column:
    """Words in lower case; points and hyphens within a word belong to it."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def sequences(words: Column, n: int) -> Column:
    """The distinct n-word sequences; all words if there are fewer."""
    last = F.greatest(F.size(words) - n + 1, F.lit(1))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " ")))
    )


def paragraphs(text: Column, held: list[str] | None = None) -> Column:
    """array<struct<line,part,words,ahead,sizes>>: what the model judges.

    Lines with words, long ones in windows that overlap; and for each end of a line that is followed by one
    with words, with the part WRAPPED, the line's last REACH words and the next REACH words of the lines up to a
    line without words. `ahead` holds the two last words of the line before it, `sizes` the words of each of its lines.
    Where `held` names words, the paragraphs around line ends are only those that hold one of them.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("line"), words_of(x).alias("words")))
    last = lambda words, n: F.slice(words, F.greatest(F.size(words) - n, F.lit(0)) + 1, n)
    none = F.array().cast("array<string>")

    def unit(line: Column, part: Column, words: Column, ahead: Column, sizes: Column) -> Column:
        return F.struct(line.alias("line"), part.alias("part"), words.alias("words"), ahead.alias("ahead"), sizes.alias("sizes"))

    def windows(x: Column) -> Column:
        parts = F.sequence(F.lit(0), F.ceil(F.greatest(F.size(x.words) - WINDOW, F.lit(0)) / STEP).cast("int"))
        held = lambda k: F.slice(x.words, k * STEP + 1, WINDOW)
        return F.transform(parts, lambda k: unit(x.line, k, held(k), none, F.array().cast("array<int>")))

    def ended(x: Column, own: Column) -> Column:
        behind = F.slice(own, x.line + 2, REACH)
        blank = F.array_position(F.transform(behind, lambda y: F.size(y.words) == 0), True).cast("int")
        run = lambda b: F.when(b > 0, F.slice(behind, 1, b - 1)).otherwise(behind)
        before = F.when(x.line > 0, last(F.get(own, x.line - 1).words, 2)).otherwise(none)
        following = lambda r: F.slice(F.flatten(F.transform(r, lambda y: F.slice(y.words, 1, REACH))), 1, REACH)
        sizes = lambda r: F.concat(F.array(F.least(F.size(x.words), F.lit(REACH))), F.transform(r, lambda y: F.size(y.words)))
        return once(once(blank, run), lambda r: unit(x.line, F.lit(WRAPPED), F.concat(last(x.words, REACH), following(r)), before, sizes(r)))

    def every(own: Column) -> Column:
        ends = F.filter(own, lambda x: (F.size(x.words) > 0) & (F.coalesce(F.size(F.get(own, x.line + 1).words), F.lit(0)) > 0))
        around = lambda e: F.transform(e, lambda x: ended(x, own))
        if held is not None:
            has = lambda x: F.arrays_overlap(x.words, F.array(*[F.lit(w) for w in held]))
            wrapped = F.filter(around(F.when(F.exists(own, has), ends).otherwise(F.slice(own, 1, 0))), has)
        else:
            wrapped = around(ends)
        return F.concat(F.flatten(F.transform(F.filter(own, lambda x: F.size(x.words) > 0), windows)), wrapped)

    return once(lines, every)


def grams(words: Column) -> Column:
    """One-grams and two-grams."""
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(words[i], F.lit(" "), w))
    return F.concat(words, pairs)


def vocabulary(rows: DataFrame) -> list[str]:
    """At most FEATURES grams: those of the fixed sentences, then those that most of the sample's paragraphs hold."""
    known: dict[str, None] = {}
    for sentence in [s for sentences in TEMPLATES.values() for s in sentences] + list(OTHERS):
        words = plain_words(sentence)
        known.update(dict.fromkeys(words + [" ".join(pair) for pair in zip(words, words[1:], strict=False)]))
    common = (
        rows.select(F.explode(F.array_distinct(grams(F.col("words")))).alias("gram"))
        .where(F.length("gram") <= LONGEST)
        .groupBy("gram")
        .count()
        .orderBy(F.desc("count"), "gram")
        .limit(FEATURES)
    )
    known.update(dict.fromkeys(r.gram for r in common.collect()))
    return list(known)[:FEATURES]


def plain_words(sentence: str) -> list[str]:
    """What `words_of` gives for an ASCII sentence."""
    return re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", sentence.lower())


def grams_of(words: list[str]) -> list[str]:
    """What `sequences` gives for three words."""
    return list(dict.fromkeys(" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))))


def cues() -> list[str]:
    """The sequences of all templates."""
    return sorted({g for sentences in TEMPLATES.values() for s in sentences for g in grams_of(plain_words(s))})


def telling() -> list[str]:
    """Words of which a paragraph that confirms any template holds one.

    Of each template, words that no sentence of OTHERS has and long ones first, until the sequences without any of them
    are too few to confirm it.
    """
    common = {w for s in OTHERS for w in plain_words(s)}
    chosen: dict[str, None] = {}
    for words in (plain_words(s) for sentences in TEMPLATES.values() for s in sentences):
        every = [set(g.split(" ")) for g in grams_of(words)]
        for word in sorted(set(words), key=lambda w: (w in common, -len(w), w)):
            if sum(not g & chosen.keys() for g in every) < CONFIRMED * len(every):
                break
            chosen[word] = None
    return list(chosen)


def compared(words: Column) -> Column:
    """The sequences of a paragraph that are compared: of three words, and of two where it holds MARK."""
    return F.when(F.array_contains(words, MARK), F.array_union(sequences(words, 3), sequences(words, 2))).otherwise(sequences(words, 3))


def cued(words: Column) -> Column:
    """Whether a paragraph holds a sequence of a template."""
    known = cues()
    return F.exists(compared(words), lambda g: g.isin(known))


def templates() -> Column:
    """array<struct<family,sequences>> of all templates, a literal."""
    out = []
    for family, sentences in TEMPLATES.items():
        for words in map(plain_words, sentences):
            out.append(F.struct(F.lit(family).alias("family"), F.array(*[F.lit(g) for g in grams_of(words)]).alias("sequences")))
    return F.array(*out)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses `value` several times, or within lambdas, but computes it once."""
    return F.transform(F.array(value), use)[0]


def similarity(words: Column, family: Column) -> Column:
    """The greatest share of three-word sequences of a family's template that a paragraph holds."""
    fit = F.filter(templates(), lambda t: t.family == family)
    shares = lambda own: F.transform(fit, lambda t: F.size(F.array_intersect(t.sequences, own)) / F.size(t.sequences))
    return once(compared(words), lambda own: F.coalesce(F.array_max(shares(own)), F.lit(0.0)))


def begun(p: Column, family: Column) -> Column:
    """Whether a template of a family is confirmed by a WRAPPED paragraph `p`, begins in its first line and is
    confirmed by none of its lines alone."""
    share = lambda t, own: F.size(F.array_intersect(t.sequences, own)) / F.size(t.sequences)
    fit = F.filter(templates(), lambda t: t.family == family)
    best = once(compared(p.words), lambda own: F.array_max(F.transform(fit, lambda t: F.struct(share(t, own).alias("share"), t.sequences.alias("sequences")))))
    three = lambda words, i: F.array_join(F.slice(words, i, 3), " ")
    head = p.sizes[0]

    def placed(t: Column) -> Column:
        whole_words, before = F.concat(p.ahead, p.words), F.size(p.ahead)
        holds = lambda i: F.array_contains(t.sequences, three(whole_words, i))
        earlier = (before > 0) & F.exists(F.sequence(F.lit(1), F.greatest(before, F.lit(1))), holds)
        here = F.exists(F.sequence(before + 1, before + head), holds)
        start = lambda k: F.aggregate(F.slice(p.sizes, 1, k), F.lit(0), lambda n, x: n + x)
        alone = F.exists(F.sequence(F.lit(0), F.size(p.sizes) - 1), lambda k: share(t, compared(F.slice(p.words, start(k) + 1, p.sizes[k]))) >= CONFIRMED)
        return (t.share >= CONFIRMED) & here & ~earlier & ~alone

    return once(best, placed)


def labelled(docs: DataFrame, text: str, sample: int) -> DataFrame:
    """(label, words, aside): variants of templates, sentences of no licence, paragraphs of the corpus.

    Up to DRAWS paragraphs are drawn from each of about `sample` documents by the digest of their text, so
    the sample depends on no layout; paragraphs that hold any sequence of a template are left out, since they may
    be notices in other words: they are neither examples of no licence nor set the threshold. In variants of
    templates words are left out or replaced, and words of the corpus, up to a full window, stand before and behind them.
    """
    families = list(TEMPLATES)
    n = max(1, docs.count())
    body = text_of(F.col(f"`{text}`"))
    own = F.xxhash64(body)
    drawn = stored(
        docs.select(body.alias("body"), own.alias("own"))
        .where(F.pmod("own", F.lit(1_000_000)) < F.lit(math.ceil(1e6 * min(1.0, sample / n))))
        .dropDuplicates(["own"])
        .select("own", paragraphs(F.col("body")).alias("all"))
        .where(F.size("all") > 0)
        .select("own", F.explode(F.slice(F.array_sort(F.transform("all", lambda p: F.struct(F.xxhash64("own", p.line, p.part).alias("at"), p.words.alias("words")))), 1, DRAWS)).alias("p"))
        .select("own", "p.words"),
        "license-paragraphs",
    )
    sentences = [(k, s) for k, f in enumerate(families) for s in TEMPLATES[f]] + [(len(families), s) for s in OTHERS]
    given = F.array(*[
        F.struct(F.lit(k).alias("label"), F.array(*[F.lit(w) for w in plain_words(s)]).alias("words"), F.lit(i).alias("i"))
        for i, (k, s) in enumerate(sentences)
    ])
    noise = drawn.groupBy(F.pmod("own", F.lit(499)).alias("of")).agg(F.min("words").alias("noise"))
    made = (
        docs.sparkSession.range(VARIANTS)
        .select(F.col("id").alias("k"), F.explode(given).alias("t"))
        .select("k", "t.*", F.pmod(F.xxhash64("k", "t.i"), F.lit(499)).alias("draw"))
        .join(noise, F.col("draw") == F.col("of"), "left")
        .withColumn("noise", F.coalesce("noise", F.array(F.lit("the"))))
    )
    chance = lambda *key: F.pmod(F.xxhash64("k", "i", *key), F.lit(100))
    changed = F.transform(
        "words",
        lambda w, i: F.when((chance(i) < 5) & (F.col("k") > 0), F.lit(""))
        .when((chance(i) < 10) & (F.col("k") > 0), F.col("noise")[F.pmod(i, F.size("noise"))])
        .otherwise(w),
    )
    context = F.flatten(F.array_repeat("noise", WINDOW))
    room = F.greatest(F.lit(WINDOW) - F.size("words"), F.lit(0))
    ahead = F.when(F.col("k") % 3 > 0, chance(F.lit("b")) % (room + 1)).otherwise(0).cast("int")
    before = F.slice(context, 1, ahead)
    behind = F.slice(context, 1, F.when(F.col("k") % 2 == 1, chance(F.lit("a")) % (room - ahead + 1)).otherwise(0).cast("int"))
    variants = made.select("label", F.filter(F.concat(before, changed, behind), lambda w: w != "").alias("words"), (chance(F.lit("s")) < 20).alias("aside"))
    corpus = drawn.where(~cued(F.col("words"))).select(
        F.lit(len(families)).alias("label"), "words", (F.pmod(F.xxhash64("words"), F.lit(100)) < 20).alias("aside")
    )
    return variants.unionByName(corpus)


class Model:
    """The vocabulary, the fitted regression, its classes, its temperature and the probability from which a family is believed."""

    def __init__(self, indicators: CountVectorizerModel, regression: LogisticRegressionModel, temperature: float, least: float) -> None:
        self.indicators, self.regression, self.temperature, self.least = indicators, regression, temperature, least
        self.classes = [*TEMPLATES, UNKNOWN]

    def judged(self, rows: DataFrame) -> DataFrame:
        """Rows with `words`, with `found`: the likeliest class and its calibrated probability."""
        scored = self.regression.transform(self.indicators.transform(rows.withColumn("grams", grams(F.col("words")))))
        names = F.array(*[F.lit(c) for c in self.classes])
        pick = lambda raw: F.struct(
            names[F.array_position(raw, F.array_max(raw)).cast("int") - 1].alias("family"),
            F.array_max(likelihoods(raw, self.temperature)).alias("probability"),
        )
        return scored.select(*rows.columns, once(vector_to_array("rawPrediction"), pick).alias("found"))

    def believed(self, found: Column) -> Column:
        """Whether the likeliest class is a family, and likely enough."""
        return (found.getField("family") != UNKNOWN) & (found.getField("probability") >= self.least)


def likelihoods(raw: Column, temperature: float) -> Column:
    """Probabilities of the classes from their margins."""

    def shared(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
        return once(total, lambda t: F.transform(weights, lambda w: w / t))

    return once(F.array_max(raw), lambda top: once(F.transform(raw, lambda x: F.exp((x - top) / temperature)), shared))


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """A regression on the sample's rows, with the temperature that suits those kept aside best."""
    rows = stored(labelled(docs, text, sample).coalesce(4), "license-sample")
    indicators = CountVectorizerModel.from_vocabulary(vocabulary(rows), "grams", "features").setBinary(True)
    featured = indicators.transform(rows.withColumn("grams", grams(F.col("words")))).drop("grams")
    regression = LogisticRegression(family="multinomial", maxIter=40, regParam=REGULARISATION, standardization=False).fit(
        featured.where(~F.col("aside")).select("features", F.col("label").cast("double").alias("label"))
    )
    kept = stored(
        regression.transform(featured.where("aside")).select("label", vector_to_array("rawPrediction").alias("raw")), "license-kept"
    )
    losses = [
        F.avg(-F.log(F.greatest(likelihoods(F.col("raw"), t)[F.col("label")], F.lit(1e-9)))).alias(f"t{k}")
        for k, t in enumerate(TEMPERATURES)
    ]
    found = kept.agg(*losses).first()
    best = min(range(len(TEMPERATURES)), key=lambda k: found[k]) if found[0] is not None else TEMPERATURES.index(1.0)
    temperature = TEMPERATURES[best]
    # The unknown class: how sure of a family the model may be where there is none.
    families = F.array_max(F.slice(likelihoods(F.col("raw"), temperature), 1, len(TEMPLATES)))
    others = kept.where(F.col("label") == len(TEMPLATES)).select(families.alias("p"))
    limit = others.agg(F.percentile("p", 1 - FALSE_ALARMS)).first()[0]
    return Model(indicators, regression, temperature, max(PROBABILITY, limit or 0.0))


def scanned(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A row for each paragraph that the model takes for a licence: the document's columns without the text,
    line, part, family, probability, similarity and confirmed.

    `line` counts the text's lines from 0, `part` the windows of a long line. A family whose calibrated
    probability is below PROBABILITY, or below what all but FALSE_ALARMS of the corpus paragraphs kept
    aside reach, is unknown and gives no row. `similarity` is the greatest share of a template of the family that
    stands there, `confirmed` says whether that is enough. A notice that only several lines hold together
    stands at its first line, with the part WRAPPED, where the model believes it and a template confirms it; lines of
    it that are believed alone stand beside it, unconfirmed. A window with notices of two families gives
    the likelier one. Null and empty texts have no paragraphs; repeated rows give repeated rows; an empty table gives an
    empty table.
    """
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    model = train(docs, text)
    # Around line ends a template must confirm what the model believes, so only what can confirm one is judged there.
    judgeable = paragraphs(text_of(F.col(f"`{text}`")), telling())
    rows = docs.select(whole(docs.select(*[f"`{c}`" for c in carry])), F.explode(judgeable).alias("p"))
    judged = model.judged(rows.select("row", "p", F.col("p.words").alias("words")))
    found = judged.where(once(F.col("found"), model.believed))
    found = found.where((F.col("p.part") != WRAPPED) | begun(F.col("p"), F.col("found.family")))
    found = found.withColumn("similarity", similarity(F.col("words"), F.col("found.family")))
    return unpacked(
        found,
        carry,
        line=F.col("p.line"),
        part=F.col("p.part"),
        family=F.col("found.family"),
        probability=F.col("found.probability"),
        similarity=F.col("similarity"),
        confirmed=F.col("similarity") >= CONFIRMED,
    )
