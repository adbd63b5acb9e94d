"""Licence scans: a trained paragraph classifier (DataFrame functions and Spark's own
logistic regression; no Python code on the rows).

Every line of every whole text is reduced to its distinct 2- and 3-word grams, and so is every run
of consecutive lines (a hard-wrapped notice) in which grams of the model go over each line end; lines
without words, as blank ones, end a run. A run is reported at its first line if it says more than any of its
lines, or is confirmed for a family that none of them is confirmed for; it then takes the place of its
lines of unknown or the same family that are not confirmed. All other lines stay.
A multinomial logistic regression over the grams of the training paragraphs gives a score per
licence family, for ``unknown`` (licence language of no known family) and for ``none``. The
training paragraphs are statements made by rule from licence names, published notices, and at
most ``NEGATIVES`` paragraphs of the corpus (a sample by hash) that share no 3-gram with them.
A temperature fitted on a held-out third calibrates the probabilities; a family below
``SURE`` becomes ``unknown``. The prediction is confirmed where the paragraph holds at least
``CONFIRM`` of the grams of a template of the predicted family.

Only grams of the model can move a paragraph's score from that of an empty one, which is
``none``; so paragraphs without any of them are not carried on. The gram table is bounded by
the training set and is broadcast as such.

Defined results: null and empty texts have no paragraphs; paragraphs of fewer than two words have
no grams and are ``none``; equal rows (same doc_id and text) are reported once; a null
doc_id is kept as such; equal probabilities go to the first class in order of name; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import saved

WORD_BREAK = r"[^\p{L}\p{N}]+"
NEGATIVES = 1500
SURE, CONFIRM = 0.6, 0.6
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)
NONE, UNKNOWN = "none", "unknown"

# Names under which the licence families are cited, and lines of their notices.
NAMES = {
    "Apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache Software License"],
    "MIT": ["MIT License", "MIT", "Expat License", "X11 License"],
    "BSD": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "Simplified BSD License"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL", "GPLv3", "GPL-3.0-or-later",
            "GNU General Public License"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPL-2.1-only"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPL-3.0-only"],
    "MPL": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "MPL-2.0"],
    "ISC": ["ISC License", "ISC license terms"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "Creative Commons Attribution License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0",
                 "Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0",
                 "Creative Commons Attribution-NonCommercial License"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal Public Domain Dedication", "CC0-1.0", "Creative Commons Zero"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    UNKNOWN: ["Acme Public License", "Example Community License, version 2", "terms of service", "license agreement", "Shared Source License",
              "Custom License 1.0", "following license", "same license", "license found in the LICENSE file"],
}
FRAMES = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.",
          "This work is licensed under {}.", "This software is distributed under the terms of the {}.",
          "This program is released under the {}, see the file for details.", "Available under {}.", "License: {}",
          "SPDX-License-Identifier: {}", "You may use this file under the {}."]
NOTICES = {
    "Apache": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
               "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met:",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation",
            "You should have received a copy of the GNU General Public License along with this program."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "AGPL": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC0": ["has waived all copyright and related or neighboring rights to this work"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    UNKNOWN: ["All rights reserved.", "Use of this material is subject to the license agreement.", "See the license for details.",
              "No part of this publication may be reproduced without permission of the publisher."],
}


def templates() -> list[tuple[str, str]]:
    """(family, statement): every frame with every name, and the notices."""
    made = [(fam, f.format(name)) for fam, names in NAMES.items() for name in names for f in FRAMES]
    return made + [(fam, t) for fam, ts in NOTICES.items() for t in ts]


def with_grams(df: DataFrame, text: str, out: str = "grams", ahead: str | None = None) -> DataFrame:
    """Add ``out``: the distinct hashed 2- and 3-word grams; words are runs of letters and digits. With ``ahead``
    (the next two words, as ``first_words`` gives them) also ``{out}_over``: (gram, reach) of the grams that begin in the text
    and end in a line after it."""
    w = f"_{out}_w"
    df = df.withColumn(w, F.transform(F.filter(F.split(F.lower(F.col(text)), WORD_BREAK), lambda x: x != ""), lambda x: F.xxhash64(x)))
    n = F.size(w)

    def runs(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - F.lit(k)), lambda i: F.xxhash64(*[F.get(F.col(w), i + F.lit(j)) for j in range(k)]))
                      ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(out, F.array_distinct(F.concat(runs(2), runs(3))))
    if ahead is None:
        return df.drop(w)
    back = [F.get(F.col(w), n - F.lit(j)) for j in (1, 2)]
    to = [F.get(F.col(ahead), F.lit(j)) for j in (0, 1)]

    def over(fits: Column, words: list[Column], reach: Column) -> Column:
        return F.struct(F.when(fits, F.xxhash64(*words)).alias("gram"), reach.alias("reach"))
    m = F.size(ahead)
    all_ = F.array(over((n >= 1) & (m >= 1), [back[0], to[0]["word"]], to[0]["reach"]),
                   over((n >= 2) & (m >= 1), [back[1], back[0], to[0]["word"]], to[0]["reach"]),
                   over((n >= 1) & (m >= 2), [back[0], to[0]["word"], to[1]["word"]], to[1]["reach"]))
    return df.withColumn(f"{out}_over", F.filter(all_, lambda x: x["gram"].isNotNull())).drop(w)


def first_words(line: Column, reach: int) -> Column:
    """At most the first two words of a line: (word hash, reach); the rest of the line is not split."""
    some = F.slice(F.filter(F.split(F.coalesce(line, F.lit("")), WORD_BREAK, 4), lambda x: x != ""), 1, 2)
    return F.transform(some, lambda x: F.struct(F.xxhash64(F.lower(x)).alias("word"), F.lit(reach).alias("reach")))


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, paragraph, line) of every non-blank line of every whole text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_t")).where("_t is not null")
    rows = rows.select("doc_id", F.xxhash64("_t").alias("text_hash"), F.posexplode_outer(F.split("_t", "\\r?\\n")).alias("paragraph", "line"))
    return rows.where(F.trim("line") != "")


def held_lines(docs: DataFrame, model: LicenceModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, paragraph, grams, over, end, block) of every line with grams of the model: those inside it, those
    that go over its end, the last line they reach, and the number in its text of the run that it belongs to."""
    key = ["doc_id", "text_hash", "paragraph"]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_t")).where("_t is not null")
    rows = rows.select("doc_id", F.xxhash64("_t").alias("text_hash"), F.split("_t", "\\r?\\n").alias("_lines"))
    near = F.transform("_lines", lambda x, i: F.struct(x.alias("line"), F.get("_lines", i + F.lit(1)).alias("n1"), F.get("_lines", i + F.lit(2)).alias("n2")))
    rows = rows.select("doc_id", "text_hash", F.posexplode_outer(near).alias("paragraph", "_l"))
    rows = rows.select("doc_id", "text_hash", "paragraph", "_l.*").where(F.trim("line") != "").withColumn("_a", first_words(F.col("n1"), 1))
    # a line of one word lets a gram go on into the line after it
    rows = rows.withColumn("_a", F.when(F.size("_a") == 1, F.slice(F.concat("_a", first_words(F.col("n2"), 2)), 1, 2)).otherwise(F.col("_a")))
    rows = with_grams(rows.drop("n1", "n2"), "line", ahead="_a")
    # outer: for a plain explode Spark infers a filter on the array and computes it once more below
    grams = rows.select(*key, "grams_over", F.size("grams").alias("_n"), F.posexplode_outer(F.concat("grams", F.col("grams_over.gram"))).alias("_p", "gram"))
    grams = grams.select(*key, "gram", F.when(F.col("_p") >= F.col("_n"), F.get(F.col("grams_over.reach"), F.col("_p") - F.col("_n"))).alias("reach"))
    held = grams.join(F.broadcast(model.weights.select("gram")), "gram").groupBy(*key).agg(
        F.collect_set(F.when(F.col("reach").isNull(), F.col("gram"))).alias("grams"),
        F.collect_set(F.when(F.col("reach").isNotNull(), F.col("gram"))).alias("over"),
        (F.col("paragraph") + F.coalesce(F.max("reach"), F.lit(0))).alias("end"))
    w = Window.partitionBy("doc_id", "text_hash").orderBy("paragraph")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("_new", F.when(F.col("paragraph") <= reached, 0).otherwise(1))
    return saved(held.withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new"), "licence-lines")


class LicenceModel:
    """weights: (gram, w array<double>) by class; bias, classes, temperature; templates: (family,
    template, size, gram)."""

    def __init__(self, weights: DataFrame, bias: list[float], classes: list[str], temperature: float, templates: DataFrame):
        self.weights, self.bias, self.classes, self.temperature, self.templates = weights, bias, classes, temperature, templates


def train(docs: DataFrame, negatives: int = NEGATIVES, doc_id: str = "doc_id", text: str = "text") -> LicenceModel:
    spark = docs.sparkSession
    made = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(templates())], "template int, family string, line string")
    made = with_grams(made, "line")
    # the corpus' own paragraphs: those of the texts with the smallest hashes
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    some = some.withColumn("_h", F.xxhash64("text", F.lit("negatives"))).orderBy("_h").limit(negatives).select("doc_id", "text")
    lines = with_grams(paragraphs(some).withColumn("_l", F.xxhash64("line")).orderBy("_l").limit(negatives).select("line"), "line")
    rows = made.select("family", "grams").collect()
    known = sorted({g for r in rows for g in r["grams"]})
    taught = {g for r in rows if r["family"] != UNKNOWN for g in r["grams"]}
    plain = [r["grams"] for r in lines.select("grams").collect()]
    # a corpus paragraph with much of a template's grams is no negative
    plain = [g for g in plain if sum(x in taught for x in g) < 3]
    labelled = spark.createDataFrame([(r["family"], [str(g) for g in r["grams"]]) for r in rows] + [(NONE, [str(g) for g in p if g in taught])
                                      for p in plain] + [(NONE, [])], "family string, grams array<string>")
    classes = sorted({r["family"] for r in rows} | {NONE})
    at = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    labelled = labelled.select(at[F.col("family")].alias("label"), "grams")
    bag = CountVectorizerModel.from_vocabulary([str(g) for g in known], "grams", "features", minTF=1.0)
    bag.setBinary(True)
    points = bag.transform(labelled).withColumn("_held", F.pmod(F.xxhash64("label", "grams"), F.lit(3)) == 0).select("label", "features", "_held").coalesce(1).cache()
    how = LogisticRegression(family="multinomial", maxIter=60, regParam=2e-4, standardization=False)
    raw = how.fit(points.where("not _held")).transform(points.where("_held")).select("label", vector_to_array("rawPrediction").alias("raw"))

    def loss(t: float) -> Column:
        top = F.array_max("raw")
        norm = F.log(F.aggregate(F.transform("raw", lambda x: F.exp((x - top) / t)), F.lit(0.0), lambda a, x: a + x))
        return F.avg(norm - (F.get(F.col("raw"), F.col("label").cast("int")) - top) / t)
    losses = raw.agg(*[loss(t).alias(str(i)) for i, t in enumerate(TEMPERATURES)]).first()
    temperature = min(zip([math.inf if x is None else x for x in losses], TEMPERATURES, strict=True))[1]
    fitted = how.fit(points)
    points.unpersist()
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray().tolist()
    weights = spark.createDataFrame([(g, matrix[:, i].tolist()) for i, g in enumerate(known)], "gram long, w array<double>")
    marks = spark.createDataFrame([(r["family"], i, len(r["grams"]), g) for i, r in enumerate(rows) for g in r["grams"] if r["family"] != UNKNOWN],
                                  "family string, template int, size int, gram long")
    return LicenceModel(weights, bias, classes, temperature, marks)


def scan(docs: DataFrame, model: LicenceModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, paragraph, last, family, probability, overlap, confirmed) of every line, or run
    from line ``paragraph`` to ``last``, that is not ``none``; a family that the calibrated probability does not carry is ``unknown``."""
    text_key = ["doc_id", "text_hash", "block"]
    key = [*text_key, "paragraph", "last", "run"]
    lines = held_lines(docs, model, doc_id, text)
    runs = lines.groupBy(*text_key).agg(F.min("paragraph").alias("paragraph"), F.max("end").alias("last"), F.lit(True).alias("run"),
                                        F.array_distinct(F.flatten(F.collect_list(F.concat("grams", "over")))).alias("grams"))
    held = lines.where(F.size("grams") > 0).select(*text_key, "paragraph", F.col("paragraph").alias("last"), F.lit(False).alias("run"), "grams").unionByName(
        runs.where(F.col("last") > F.col("paragraph")))
    k = len(model.classes)
    zeros = F.array(*[F.lit(0.0)] * k)
    sums = (held.select(*key, "grams", F.explode("grams").alias("gram")).join(F.broadcast(model.weights), "gram")
            .groupBy(*key).agg(F.first("grams").alias("grams"), *[F.sum(F.col("w")[i]).alias(f"_s{i}") for i in range(k)]))
    logits = F.array(*[(F.col(f"_s{i}") + F.lit(b)) / model.temperature for i, b in enumerate(model.bias)])
    sums = sums.withColumn("_z", logits).withColumn("_top", F.array_max("_z"))
    best = F.array_position("_z", F.col("_top")).cast("int")
    total = F.aggregate(F.transform("_z", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(c) for c in model.classes])
    sums = sums.withColumn("family", F.element_at(names, best)).withColumn("probability", 1.0 / total).where(F.col("family") != NONE).drop("_z", "_top")
    # the share of a template's grams that the paragraph holds, the best of the family
    hits = (sums.select(*key, "family", F.explode("grams").alias("gram")).join(F.broadcast(model.templates), ["family", "gram"])
            .groupBy(*key, "template").agg((F.count("*") / F.max("size")).alias("share"))
            .groupBy(*key).agg(F.max("share").alias("overlap")))
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}"))
    out = sums.alias("s").join(hits.alias("h"), same, "left")
    overlap = F.coalesce("h.overlap", F.lit(0.0))
    sure = F.col("s.probability") >= SURE
    family = F.when(sure, F.col("s.family")).otherwise(F.lit(UNKNOWN))
    out = out.select(*[f"s.{c}" for c in key], family.alias("family"), F.round("s.probability", 4).alias("probability"), F.round(overlap, 4).alias("overlap"),
                     (sure & (F.col("s.family") != UNKNOWN) & (overlap >= CONFIRM)).alias("confirmed"))
    # a run and its lines: what says more stays
    out = out.withColumn("_r", F.when(F.col("confirmed"), 2).when(F.col("family") != UNKNOWN, 1).otherwise(0))
    w = Window.partitionBy(*text_key)
    out = out.withColumns({"_best": F.coalesce(F.max(F.when(~F.col("run"), F.col("_r"))).over(w), F.lit(-1)), "_run": F.max(F.when(F.col("run"), F.col("_r"))).over(w),
                           "_of": F.max(F.when(F.col("run"), F.col("family"))).over(w),
                           "_said": F.collect_set(F.when(~F.col("run") & F.col("confirmed"), F.col("family"))).over(w)})
    tells = F.coalesce((F.col("_run") > F.col("_best")) | ((F.col("_run") == 2) & ~F.array_contains("_said", F.col("_of"))), F.lit(False))
    stays = F.when(F.col("run"), tells).otherwise(F.col("confirmed") | ~tells | ~F.col("family").isin(UNKNOWN) & (F.col("family") != F.col("_of")))
    return out.where(stays).select("doc_id", "text_hash", F.col("paragraph").cast("int").alias("paragraph"), F.col("last").cast("int").alias("last"),
                                   "family", "probability", "overlap", "confirmed")


def with_lines(found: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The found lines and runs with their text."""
    lines = paragraphs(docs, doc_id, text).withColumnsRenamed({"doc_id": "_d", "text_hash": "_h", "paragraph": "_p"}).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")) & F.col("_p").between(F.col("paragraph"), F.col("last"))
    rows = found.join(lines, same).groupBy(*found.columns).agg(F.array_sort(F.collect_list(F.struct("_p", "line"))).alias("_l"))
    return rows.withColumn("line", F.array_join(F.col("_l.line"), "\n")).drop("_l")


def op1_query(docs: DataFrame) -> DataFrame:
    return scan(docs, train(docs)).drop("text_hash", "last")
