"""Licence scan by a trained paragraph classifier.

A multinomial logistic regression over sparse word one- to three-grams tells licence families, an unknown licence
and no licence apart. It is trained here, on notices made from the names, carriers and clauses below, with an L1
penalty that leaves few weights. A family's prediction stands if its probability reaches a threshold, else it counts
as unknown; the threshold is the least from which on a model that has never seen one name form of every family is right
often enough about those forms. Comparison with the family's templates (names and clauses) confirms a prediction
(confirmed).

A paragraph is a line; where a line ends without a mark of its end and neither it nor the next line holds a licence
alone, the two together are a paragraph, too (a wrapped notice). Paragraphs without any anchor word aren't scored:
anchors are chosen so that all weights of all other words together can't lift a family over "no licence".

DataFrame functions and Spark ML's JVM trainer only; scoring is a map over rows without a shuffle.

Defined results: one row for each paragraph found to hold a licence, by its first line; null or empty text has none.
Repeated rows give their rows each; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.storage import load

NONE, UNKNOWN = "none", "unknown"
#: Fixed value: how a line that isn't wrapped ends (or that it is empty).
ENDED = r"[.!?:;…]$|^$"
#: Lists of known grams, dealt by the remainder of their hashes.
SLOTS = 1024

#: Names of each licence family, as notices give them.
NAMES = {
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache 2.0"),
    "mit": ("MIT License", "MIT license terms", "MIT/X11 License", "X11 License"),
    "gpl": ("GNU General Public License, version 3", "GNU GPL version 2 or later", "GPL-3.0", "GPLv3", "GPLv2", "General Public License"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "GNU LGPL version 3", "LGPL-2.1", "LGPLv3", "Lesser General Public License"),
    "agpl": ("GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3", "Affero General Public License"),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD license", "Berkeley Software Distribution license"),
    "mpl": ("Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License"),
    "epl": ("Eclipse Public License, version 2.0", "EPL-2.0", "Eclipse Public License"),
    "isc": ("ISC License", "ISC license terms"),
    "unlicense": ("Unlicense", "Unlicense terms"),
    "cc0": ("CC0 1.0 Universal", "CC0 public domain dedication", "CC0"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial 4.0", "CC-BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC-BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike"),
    "cc-by": ("CC BY 4.0", "CC-BY 3.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution License"),
}
#: Sentences that carry a licence's name.
CARRIERS = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the terms of the {}.",
    "This software is available under the {}; see the LICENSE file.", "You may use this file only under the {}.", "SPDX-License-Identifier: {}", "License: {}", "The source code is published under the {} by its authors.",
    "Permission to use, copy and modify is granted under the {}.", "Dual licensed under the {} or commercial terms.", "This text is shared under a {} licence.", "{}",
)
#: A clause that is typical of each family's notices or texts.
CLAUSES = {
    "apache": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "bsd": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
}
#: Made-up names, for licences of no known family.
OTHER_NAMES = ("Acme Source Terms", "Open Harbour License 1.0", "Northwind Community Licence", "Fabrikam Evaluation Agreement", "Blue Lake Public Terms, version 4", "terms of the vendor", "our own license", "license agreement of the seller")
#: Text that holds no licence, some of it with words that notices use.
BACKGROUND = (
    "the and of in is to a for with that on as by at from this are be it was or an", "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine", "le la les de des et en un une du dans est que pour qui sur par au",
    "el la los las de y en que un una por con para es no se del al", "version 2.0 of the program was faster than version 1.0", "the general public was invited to the opening", "he released the brake and drove under the bridge", "this work is new and was distributed to the members",
    "the terms of the sale were clear to all authors", "see the file for the source code of the program", "permission was granted to enter the building", "the university at mit and the berkeley campus", "an eclipse of the sun was seen in public", "the apache helicopter landed", "mozilla made a browser",
    "the commons voted on attribution of the cost", "her driver's license expired in may", "a licensed electrician checked the wires", "you may copy and modify the plan only by hand", "use this road under good conditions", "universal public domain of numbers", "commercial agreement between the two towns", "version 3 general 4.0 3.0 2.1 2.0 1.0", "by nc sa nd cc",
    "mit", "er kam mit der zeit", "mit dem haus und mit der stadt", "nicht mit einem", "von und mit im", "das ist mit sich", "mit den", "auf mit für", "mit in mit", "und mit das", "mit und die", "mit zu von",
)


def words_of(paragraph: Column) -> Column:
    return F.array_remove(F.split(F.lower(paragraph), r"[^\p{L}\p{N}.+]+|\.+(?!\p{N})"), "")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often use names it and wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def grams_of(words: Column) -> Column:
    """One- to three-grams of an array of words, as often as they are there."""
    runs = []
    for n in (2, 3):
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
        runs.append(F.transform(starts, _joined(words, n)))  # a run past the end is shorter, and no gram of its own
    return F.concat(words, *runs)


def _joined(words: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.array_join(F.slice(words, i, n), " ")


@dataclass
class Model:
    classes: list[str]
    intercept: list[float]
    weights: dict[str, list[float]]
    grams: list[str]
    hashes: list[int]  # of grams, by xxhash64
    anchors: list[str]
    threshold: float


def notices(spark: SparkSession) -> DataFrame:
    """(family, text, held_out): the training table. Of families with three names or more, one whole form is held out."""
    rows = [(f, c.format(n), len(names) > 2 and n == names[1]) for f, names in NAMES.items() for n in names for c in CARRIERS]
    rows += [(f, c, False) for f, c in CLAUSES.items() for _ in range(3)]
    rows += [(UNKNOWN, c.format(n), n == OTHER_NAMES[1]) for n in OTHER_NAMES for c in CARRIERS[:-1]]
    rows += [(NONE, b, False) for b in BACKGROUND for _ in range(4)]
    table = json.dumps([{"family": f, "text": t, "held_out": h} for f, t, h in rows])
    return spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(table), "array<struct<family string, text string, held_out boolean>>")).alias("r")).select("r.*")


def prepared(rows: DataFrame) -> DataFrame:
    return rows.withColumn("words", words_of(F.col("text"))).withColumn("grams", F.array_distinct(bind(words_of(F.col("text")), grams_of)))


def fitted(rows: DataFrame) -> Model:
    """The regression on these rows, without a threshold."""
    spark, classes = rows.sparkSession, [NONE, UNKNOWN, *NAMES]
    vectorizer = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(rows)
    found = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=0.5, maxIter=80).fit(vectorizer.transform(rows))
    matrix, intercept = found.coefficientMatrix.toArray(), [float(x) for x in found.interceptVector.toArray()]
    weights = {g: [round(float(x), 6) for x in matrix[:, j]] for j, g in enumerate(vectorizer.vocabulary) if abs(matrix[:, j]).max() > 1e-4}
    hashed = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(json.dumps(sorted(weights))), "array<string>")).alias("g")).select("g", F.xxhash64("g").alias("h")).collect()
    return Model(classes, intercept, weights, [r.g for r in hashed], [r.h for r in hashed], anchors(intercept, weights), 1.0)


def anchors(intercept: list[float], weights: dict[str, list[float]]) -> list[str]:
    """Words without any of which "no licence" (the first class) is the best one for certain.

    The margin of a class over the first is at most that of the intercepts plus all positive margins of grams free
    of anchors. The word that lowers the largest margin most becomes an anchor until none is positive.
    """
    grams = sorted(weights)
    gain = np.array([[max(0.0, w - weights[g][0]) for w in weights[g]] for g in grams])
    margin = np.array(intercept) - intercept[0]
    margin[0] = -np.inf
    free, chosen = np.ones(len(grams), dtype=bool), []
    holders: dict[str, list[int]] = {}
    for j, g in enumerate(grams):
        for w in set(g.split(" ")):
            holders.setdefault(w, []).append(j)
    while grams and (margin + gain[free].sum(axis=0)).max() >= 0:
        worst = int((margin + gain[free].sum(axis=0)).argmax())
        lowers = {w: sum(gain[j, worst] for j in js if free[j]) for w, js in holders.items()}
        word = max(lowers, key=lambda w: (lowers[w], w))
        if not lowers[word]:
            break  # the intercepts alone favour a licence: nothing bounds it
        chosen.append(word)
        free[holders.pop(word)] = False
    return sorted(chosen)


def learn(spark: SparkSession, precision: float = 0.98) -> Model:
    """The model of all notices, with the threshold of one that hasn't seen the held-out name forms."""
    rows = prepared(notices(spark)).withColumn("label", F.array_position(F.lit([NONE, UNKNOWN, *NAMES]), F.col("family")).cast("double") - 1).cache()
    part = fitted(rows.where(~F.col("held_out")))
    tried = rows.where("held_out").select("family", bind(F.col("words"), lambda w: judged(w, part)).alias("v")).select("family", "v.*").collect()
    by = sorted(((r.probability, r.best == r.family) for r in tried if r.best not in (NONE, UNKNOWN)), reverse=True)
    model, right = fitted(rows), 0
    for i, (p, ok) in enumerate(by, 1):
        right += ok
        if right >= precision * i:
            model.threshold = p
    rows.unpersist()
    return model


def judged(words: Column, model: Model) -> Column:
    """Struct of the best class and its probability.

    Few of a paragraph's grams are known. Which are is read from a table of hashes by their remainder, so that the
    list of all is gone through for those few only.
    """
    n = len(model.classes)
    known = F.lit(np.array(model.hashes, dtype=np.int64))
    slots = F.expr(f"array({', '.join('array(' + ', '.join(f'{h}L' for h in model.hashes if h % SLOTS == i) + ')' for i in range(SLOTS))})")
    table = F.expr(f"array({', '.join(f'{x!r}D' for g in model.grams for x in model.weights[g])})")
    hits = F.array_distinct(F.filter(F.transform(grams_of(words), lambda g: F.xxhash64(g)), lambda h: F.array_contains(F.get(slots, F.pmod(h, F.lit(SLOTS)).cast("int")), h)))
    places = F.transform(hits, lambda h: F.array_position(known, h))
    sums = F.aggregate(places, F.lit(np.array(model.intercept)), lambda acc, p: F.zip_with(acc, F.slice(table, ((p - 1) * n + 1).cast("int"), n), lambda a, b: a + b))

    def verdict(s: Column) -> Column:
        best = F.element_at(F.lit(model.classes), F.array_position(s, F.array_max(s)).cast("int"))
        total = bind(F.array_max(s), lambda top: F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))
        return F.struct(best.alias("best"), (1 / total).alias("probability"))

    return bind(sums, verdict)


def templates(family: Column) -> Column:
    """The names and the clause of the family, as arrays of words."""
    split = lambda n: [w for w in re.split(r"[^\w.+]+|\.+(?!\w)", n.lower()) if w]
    table = F.create_map(*[x for f, names in NAMES.items() for x in (F.lit(f), F.array(*[F.lit(split(n)) for n in (*names, *([CLAUSES[f]] if f in CLAUSES else []))]))])
    return F.try_element_at(table, family)


def license_scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, confirmed) of every paragraph that holds a licence."""
    model = model or learn(docs.sparkSession)
    split = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)

    def verdict(words: Column) -> Column:
        return F.when(F.arrays_overlap(words, F.lit(model.anchors)), bind(judged(words, model), lambda v: found(words, v)))

    def found(words: Column, v: Column) -> Column:
        family = F.when(v["probability"] >= model.threshold, v["best"]).otherwise(UNKNOWN)
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        same = F.exists(templates(family), lambda n: joined.contains(F.concat(F.lit(" "), F.array_join(n, " "), F.lit(" "))) | (F.size(F.array_intersect(n, words)) >= F.ceil(F.size(n) * 0.8)))
        return F.when(v["best"] != NONE, F.struct(family.alias("family"), v["probability"].alias("probability"), F.coalesce(same, F.lit(False)).alias("confirmed")))

    # a line, and the next one where this one doesn't end; what follows is judged only where a word could matter
    pairs = bind(split, lambda lines: F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.when(~F.rtrim(x).rlike(ENDED), F.get(lines, i + 1)).alias("following"))))
    lines = docs.select("doc_id", F.posexplode(pairs).alias("paragraph", "p")).where(F.length("p.line") > 0).select("doc_id", "paragraph", "p.line", "p.following")
    words = lines.withColumn("words", words_of(F.col("line"))).withColumn("more", words_of(F.col("following")))

    def wrapped(both: Column) -> Column:
        return F.when(F.col("more").isNotNull(), F.when(bind(F.col("more"), verdict).isNull(), verdict(both)))

    # unpacked, not filtered: the planner would move a filter below the verdicts and compute them twice
    judged_line = F.coalesce(bind(F.col("words"), verdict), bind(F.concat("words", "more"), wrapped))
    return words.select("doc_id", "paragraph", F.inline(F.filter(F.array(judged_line), lambda v: v.isNotNull())))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents"))
