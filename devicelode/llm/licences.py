"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed by templates; built-in functions only."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelode.llm.common import saved

#: Public licence notices by family, one sentence each.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "Licensed under the GNU Affero General Public License version 3", "You should have received a copy of the GNU Affero General Public License along with this program"],
    "apache": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache License 2.0",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
            "Released under the BSD 3-Clause License", "Licensed under the BSD 2-Clause License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["Released under CC0 1.0 Universal Public Domain Dedication", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License version 2",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "You should have received a copy of the GNU General Public License along with this program", "Released under the GNU GPL v3"],
    "lgpl": ["Licensed under the GNU Lesser General Public License version 3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
            "This project is available under the terms of the MIT license"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
            "Licensed under the Mozilla Public License version 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
                  "Released under the Unlicense"],
}
#: Licence-like sentences of no listed family, for the class of unknown licences.
UNLISTED = ["All rights reserved", "Licensed under the terms of the accompanying agreement", "This software is proprietary and confidential", "Use of this work is subject to the license terms of the publisher",
            "Released under a custom license", "Distributed under the license in the LICENSE file", "You may not copy or redistribute this work without written permission",
            "The license grants you a limited right to use this material", "Licensed under our own public license, version 1"]
NONE, UNKNOWN = "none", "unknown"
BETWEEN = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def grams_of(words: Column) -> Column:
    """Distinct word n-grams of one to three words."""
    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))

    return F.array_distinct(F.flatten(F.array_compact(F.array(*map(runs, (1, 2, 3))))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, _h, _g, place, words``: the lines of every whole text; repeated rows share their keys."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text).alias("_g"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    return lines.select("doc_id", "_h", "_g", "place", words_of(F.col("line")).alias("words"))


def examples(spark: SparkSession, docs: DataFrame, background: int) -> DataFrame:
    """``family, words, check``: each notice whole and with words left out, unlisted notices, and a bounded sample of lines.

    The sample is of at most ``background`` lines of the corpus by smallest hash; those that share three words in a row with
    a notice are not taken as background. A fifth is for calibration.
    """
    notices = [(family, line) for family, lines in TEMPLATES.items() for line in lines] + [(UNKNOWN, line) for line in UNLISTED]
    base = spark.createDataFrame(notices, "family string, line string").select("family", words_of(F.col("line")).alias("words"))
    variants = base.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(24))))
    keep = lambda w, i: (F.col("v") == 0) | (F.pmod(F.xxhash64("v", i, w), F.lit(8)) > 0)
    variants = variants.select("family", F.filter("words", keep).alias("words"), (F.col("v") % 5 == 4).alias("check"))
    known = base.select(F.explode(grams_of(F.col("words"))).alias("g")).filter(F.size(F.split("g", " ")) == 3).distinct()
    listed = F.lit([r["g"] for r in known.collect()])
    lines = paragraphs(docs).filter(F.size("words") > 0).select("words", F.xxhash64("words").alias("at"))
    # Four times as many as needed are drawn by hash first, so what is ranked stays bounded however many tasks there are.
    total = docs.agg(F.sum(F.size(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")))).first()[0] or 1
    drawn = lines.filter(F.pmod("at", F.lit(1 << 40)) < int(min(1.0, 4 * background / total) * (1 << 40)))
    sample = drawn.orderBy("at").limit(background).select(F.slice("words", 1, 400).alias("words"), "at")
    sample = sample.filter(~F.arrays_overlap(grams_of(F.col("words")), listed))
    return variants.unionByName(sample.select(F.lit(NONE).alias("family"), "words", (F.pmod("at", F.lit(5)) == 0).alias("check")))


def fit(rows: DataFrame, vocabulary: int = 4096, refused: float = 0.02) -> tuple[list[str], list[tuple], list[float], float]:
    """(families, weights per n-gram, biases, least probability): multinomial logistic regression on sparse presence of n-grams.

    N-grams that occur in background lines are no features, so a line without features has the bias alone. ``least`` is the
    quantile ``refused`` of the probability that rightly named calibration lines have; what is under it counts as unknown.
    """
    rows = saved(rows.withColumn("grams", grams_of(F.col("words"))), "examples")
    plain = rows.filter(F.col("family") == NONE).select(F.explode("grams").alias("g")).distinct()
    useful = rows.filter(F.col("family") != NONE).select(F.explode("grams").alias("g")).groupBy("g").count().join(plain, "g", "left_anti")
    words = [r["g"] for r in useful.orderBy(F.desc("count"), "g").limit(vocabulary).collect()]
    families = sorted([NONE, UNKNOWN, *TEMPLATES])
    code = F.array_position(F.lit(families), F.col("family")).cast("double") - 1
    vectors = CountVectorizerModel.from_vocabulary(words, inputCol="grams", outputCol="features").setBinary(True) if words else None
    data = saved(vectors.transform(rows).select("family", "features", "check", code.alias("label")), "vectors")
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, standardization=False).fit(data.filter("not check"))
    judged = model.transform(data.filter(F.col("check") & (F.col("family") != NONE))).filter(F.col("prediction") == F.col("label"))
    least = judged.select(F.percentile(F.array_max(vector_to_array("probability")), F.lit(refused))).first()[0]
    weights = model.coefficientMatrix.toArray()
    table = [(w, [float(x) for x in weights[:, i]]) for i, w in enumerate(words) if abs(weights[:, i]).max() > 1e-6]
    return families[:len(weights)], table, [float(x) for x in model.interceptVector.toArray()], float(least or 0.5)


def scan(docs: DataFrame, background: int = 4000, confirmed: float = 0.6) -> DataFrame:
    """``doc_id, _h, _g, place, family, probability, overlap`` of every licence line of ``docs`` (doc_id, text).

    Lines without any feature have no licence. Of the others the likeliest family counts; a line whose family is under the
    calibrated probability, or whose words cover less than ``confirmed`` of the three-word runs of its nearest notice of that family, is ``unknown``.
    Null and empty texts have no lines; repeated rows have the same result.
    """
    spark = docs.sparkSession
    families, weights, bias, least = fit(examples(spark, docs, background))
    grams = spark.createDataFrame(weights, "g string, w array<double>").withColumn("gram", F.split("g", " "))
    longest = F.array_max(F.transform("gram", lambda w, i: F.struct(F.length(w).alias("size"), w.alias("word"), i.alias("at"))))
    grams = grams.select("gram", "w", longest["word"].alias("anchor"), longest["at"].alias("before"))
    lines = paragraphs(docs)
    placed = lines.select("doc_id", "_h", "_g", "place", "words", F.posexplode("words").alias("at", "word"))
    first = F.col("at") - F.col("before")
    same = F.when(first >= 0, F.slice("words", first + 1, F.size("gram")) == F.col("gram")).otherwise(False)
    # The n-grams number at most the vocabulary's size.
    hits = placed.join(F.broadcast(grams), (F.col("word") == F.col("anchor")) & same)
    spot = ["doc_id", "_h", "_g", "place"]
    hits = hits.select(*spot, "gram", "w", "words").groupBy(*spot, "gram").agg(F.first("w").alias("w"), F.first("words").alias("words"))
    logits = [(F.sum(F.get("w", F.lit(i))) + bias[i]).alias(f"z{i}") for i in range(len(families))]
    scored = hits.groupBy(*spot).agg(*logits, F.first("words").alias("words"))
    z = F.array(*[f"z{i}" for i in range(len(families))])
    top = F.array_max(z)
    share = 1 / F.aggregate(z, F.lit(0.0), lambda total, x: total + F.exp(x - top))
    named = scored.select(*spot, "words", F.get(F.lit(families), F.array_position(z, top).cast("int") - 1).alias("likely"), share.alias("probability"))
    named = named.filter(F.col("likely") != NONE)
    notices = spark.createDataFrame([(f, line) for f, lines_ in TEMPLATES.items() for line in lines_], "likely string, line string")
    notices = notices.select("likely", grams_of(words_of(F.col("line"))).alias("g")).select(
        "likely", F.filter("g", lambda g: F.size(F.split(g, " ")) == 3).alias("g")).groupBy("likely").agg(F.collect_list("g").alias("notices"))
    own = F.filter(grams_of(F.col("words")), lambda g: F.size(F.split(g, " ")) == 3)
    overlap = F.array_max(F.transform("notices", lambda n: F.size(F.array_intersect(n, own)) / F.size(n)))
    out = named.join(F.broadcast(notices), "likely", "left").withColumn("overlap", F.coalesce(overlap, F.lit(0.0)))
    sure = (F.col("probability") >= least) & (F.col("overlap") >= confirmed)
    return out.select(*spot, F.when(sure, F.col("likely")).otherwise(F.lit(UNKNOWN)).alias("family"), "probability", "overlap")


def licences(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_licence, n_unknown, families`` (sorted, comma-joined, unknown left out)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = scan(docs, **options).groupBy("doc_id", "_h", "_g").agg(
        F.count(F.lit(1)).alias("n_licence"), F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"),
        F.array_sort(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))).alias("names")).toDF("_id", "_fh", "_fg", "n_licence", "n_unknown", "names")
    found = saved(found, "licences")
    base = docs.select("doc_id", F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text).alias("_g"),
                       F.when(F.col("text").isNotNull(), F.size(F.split(text, "\n"))).otherwise(0).cast("long").alias("n_lines"))
    same = base["doc_id"].eqNullSafe(found["_id"]) & (base["_h"] == found["_fh"]) & (base["_g"] == found["_fg"])
    zero = F.lit(0).cast("long")
    return base.join(found, same, "left").select("doc_id", "n_lines", F.coalesce("n_licence", zero).alias("n_licence"), F.coalesce("n_unknown", zero).alias("n_unknown"),
                                                 F.coalesce(F.array_join("names", ","), F.lit("")).alias("families"))
