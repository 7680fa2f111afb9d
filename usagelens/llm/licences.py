"""Licence scans: a paragraph classifier, an unknown class with a calibrated threshold, template comparison.

Paragraphs (long ones cut at sentence ends) become the set of template words and word pairs they hold. Multinomial logistic
regression, trained on sentences of well-known licence notices and on every corpus paragraph as the class `unknown`, names the
family. Paragraphs of equal sets are one training row that weighs their number, which leaves the fit as it is; the class
`unknown` as a whole weighs `UNKNOWN_WEIGHT` paragraphs at most, so that notices count in a corpus of any size. The
probability a family needs is calibrated on every corpus paragraph too, by models of the half of the sets it is not in. A
prediction is confirmed when the paragraph shares enough of its 2-grams with a template of the family, so that prose that
only uses the same words is left alone. DataFrame expressions and Spark's own vector functions do all the work.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.common import save

UNKNOWN = "unknown"
UNKNOWN_WEIGHT = 3000
LONG = 400
CONFIRM_AT = 0.6
LEAST_PROBABILITY = 0.5

# Short notices and typical sentences of public licences, by family.
TEMPLATES: Mapping[str, Sequence[str]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause"),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later"),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only"),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT"),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0"),
    "reserved": (
        "All rights reserved.",
        "Copyright (c) 2020 The Authors. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher."),
}


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def pairs(words: Column, n: Column) -> Column:
    return F.when(n >= 2, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1),
                                     lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, piece) of all paragraphs with a letter; `paragraph` numbers the lines from 0."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    pieces = F.when(F.length("line") > LONG, F.split("line", r"(?<=[.!?])\s+")).otherwise(F.array("line"))
    return lines.select("doc_id", "paragraph", F.explode(pieces).alias("piece")).where(F.col("piece").rlike(r"\p{L}"))


def gram_keys(words: Column) -> Column:
    """64-bit hashes of all words and of all pairs of adjacent words."""
    # A column inside a lambda would be computed once an element; bound as a variable it is computed once a row.
    return F.element_at(F.transform(F.array(F.transform(words, lambda word: F.xxhash64(word))), lambda h: F.concat(h, pair_keys(h))), 1)


def pair_keys(hashes: Column) -> Column:
    n = F.size(hashes)
    return F.when(n >= 2, F.zip_with(F.slice(hashes, F.lit(1), n - 1), F.slice(hashes, F.lit(2), n - 1),
                                     lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def template_keys(spark: SparkSession) -> tuple[list[int], list[int]]:
    """Sorted keys of the words and of the word pairs of all templates."""
    words = F.transform(words_of(F.col("template")), lambda word: F.xxhash64(word))
    row = template_table(spark).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(words)))).alias("words"),
                                    F.array_sort(F.array_distinct(F.flatten(F.collect_list(pair_keys(words))))).alias("pairs")).first()
    return row["words"], row["pairs"]


def held_keys(words: Column, keys: Sequence[int]) -> Column:
    """The set of `keys` that the words and their pairs hold, as a sorted array."""
    return F.array_sort(F.array_distinct(F.filter(gram_keys(words), lambda key: key.isin(*keys))))


def _features(df: DataFrame, keys: Sequence[int]) -> DataFrame:
    """`df` with the column `features`: one dimension for each of `keys`, 1 where the array `keys` holds it."""
    counter = CountVectorizerModel.from_vocabulary([str(key) for key in keys], inputCol="_names", outputCol="features", binary=True)
    return counter.transform(df.withColumn("_names", F.col("keys").cast("array<string>"))).drop("_names")


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    table = spark.createDataFrame(rows, "family string, template string").withColumn("_w", words_of(F.col("template")))
    return table.select("family", "template", F.array_distinct(pairs(F.col("_w"), F.size("_w"))).alias("template_pairs"))


def similarity(spark: SparkSession, words: Column, family: Column | None = None) -> Column:
    """Largest share of word pairs in common with a template of the family (of any without one), of the smaller of paragraph and template."""
    table = F.array(*[F.struct(F.lit(row["family"]).alias("family"), F.array(*[F.lit(g) for g in row["template_pairs"]]).alias("held"))
                      for row in template_table(spark).collect()])  # the templates above

    def share(own: Column, held: Column) -> Column:
        return F.size(F.array_intersect(own, held)) / F.greatest(F.least(F.size(own), F.size(held)), F.lit(2))

    def best(own: Column) -> Column:
        near = F.filter(table, lambda t: F.lit(True) if family is None else t["family"] == family)
        return F.array_max(F.transform(near, lambda t: share(own, t["held"])))

    own = F.array_distinct(pairs(words, F.size(words)))
    return F.coalesce(F.element_at(F.transform(F.array(own), best), 1), F.lit(0.0))  # computed once a row, as in gram_keys


def describe(docs: DataFrame, confirm_at: float = CONFIRM_AT) -> DataFrame:
    """All paragraphs of `docs(doc_id, text)` as (keys, notice, found, n), in one pass over the texts.

    `keys` holds the template words and pairs of a paragraph. `notice` says whether it is near enough to a template not to stand
    for the unknown class. Paragraphs that a template may confirm keep `found(doc_id, paragraph, piece)`; of the others equal ones
    are one row. `n` paragraphs are alike.
    """
    spark = docs.sparkSession
    words, both = template_keys(spark)
    least = min(confirm_at, CONFIRM_AT)
    held = (paragraphs(docs).withColumn("_words", words_of(F.col("piece")))
            .withColumn("keys", held_keys(F.col("_words"), sorted({*words, *both}))))
    # A share is of two pairs at least, so fewer pairs in common than that cannot reach it.
    enough = F.size(F.filter("keys", lambda key: key.isin(*both))) >= 2 * least
    nearest = held.withColumn("_nearest", F.when(enough, similarity(spark, F.col("_words"))).otherwise(F.lit(0.0)))
    return save(nearest.groupBy("keys", (F.col("_nearest") >= CONFIRM_AT).alias("notice"),
                                F.when(F.col("_nearest") >= confirm_at, F.struct("doc_id", "paragraph", "piece")).alias("found"))
                .agg(F.count("*").alias("n")), "paragraphs")


def train(described: DataFrame, weight: float = UNKNOWN_WEIGHT) -> tuple[LogisticRegressionModel, float, list[str], list[int]]:
    """The classifier, the probability a family needs, the class names in the order of its output, and the keys of its features.

    Every paragraph of `described` that is no notice itself stands for the unknown class.
    """
    spark = described.sparkSession
    keys = sorted({key for held in template_keys(spark) for key in held})
    families = [UNKNOWN, *sorted(TEMPLATES)]
    code = F.element_at(F.map_from_arrays(F.array(*[F.lit(f) for f in families]),
                                          F.array(*[F.lit(float(i)) for i in range(len(families))])), F.col("family"))
    known = template_table(spark).select("family", F.col("template").alias("piece"))
    # Each notice as a whole, its halves, and without its last words.
    w = F.split("piece", " ")
    n = F.size(w)
    cut = F.explode(F.array(F.col("piece"), F.array_join(F.slice(w, F.lit(1), F.ceil(n * 0.6).cast("int")), " "),
                            F.array_join(F.slice(w, (F.floor(n * 0.4) + 1).cast("int"), n), " ")))
    known = known.where(n >= 1).select("family", cut.alias("piece"), F.lit(20.0).alias("weight"))
    empty = spark.createDataFrame([(UNKNOWN, "", 1.0)], "family string, piece string, weight double")
    fixed = save(known.unionAll(empty).select(code.alias("label"), "weight", held_keys(words_of(F.col("piece")), keys).alias("keys")), "notices")
    unknown = save(described.where(~F.col("notice")).groupBy("keys").agg(F.sum("n").alias("n"))
                   .withColumn("half", F.pmod(F.xxhash64("keys"), F.lit(2)).cast("int")), "unknown")
    sizes = {row["half"]: row["n"] for row in unknown.groupBy("half").agg(F.sum("n").alias("n")).collect()}

    def fit(rows: DataFrame, size: int) -> LogisticRegressionModel:
        each = F.col("n") * F.lit(min(1.0, weight / max(size, 1)))
        rows = fixed.unionAll(rows.select(F.lit(0.0).alias("label"), each.alias("weight"), "keys"))
        return LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, weightCol="weight").fit(
            save(_features(rows, keys).select("label", "weight", "features"), "training"))

    model = fit(unknown, sum(sizes.values()))
    most = 0.0
    if sizes:
        checked = [fit(unknown.where(F.col("half") != half), sizes.get(1 - half, 0)).transform(_features(unknown.where(F.col("half") == half), keys))
                   for half in sorted(sizes)]
        likely = 1 - vector_to_array("probability")[0]
        # 999 of 1,000 unknown paragraphs stay below; steps of 1 / 10,000 bound what the percentile holds.
        values = [part.select((F.ceil(likely * 10_000) / 10_000).alias("likely"), "n") for part in checked]
        values = values[0].unionAll(values[-1]) if len(values) > 1 else values[0]
        most = values.agg(F.percentile("likely", 0.999, F.col("n"))).first()[0]
    return model, max(LEAST_PROBABILITY, most), families, keys


def scan(docs: DataFrame, confirm_at: float = CONFIRM_AT, **options) -> DataFrame:
    """One row per licence paragraph of `docs(doc_id, text)`: doc_id, paragraph, family, probability, similarity, text.

    Only confirmed predictions are returned. NULL, empty and letterless texts have none; a repeated row repeats its rows; on
    ties the first family by name counts; rows without doc_id keep NULL; extra columns are ignored; an empty table gives none.
    """
    described = describe(docs.select("doc_id", "text"), confirm_at)
    model, needed, families, keys = train(described, **options)
    possible = described.where(F.col("found").isNotNull()).select("keys", "found.*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_copy"))
    scored = model.transform(_features(possible, keys)).withColumn("_words", words_of(F.col("piece")))
    chances = vector_to_array("probability")
    named = scored.withColumn("_chances", F.slice(chances, 2, len(families) - 1))
    best = F.array_max("_chances")
    family = F.element_at(F.array(*[F.lit(f) for f in families[1:]]), F.array_position("_chances", best).cast("int"))
    # A paragraph is looked at as a candidate when unknown is unlikely enough; the template then decides.
    likely = named.where(1 - chances[0] >= needed).withColumn("family", family)
    confirmed = likely.withColumn("similarity", similarity(docs.sparkSession, F.col("_words"), F.col("family"))).where(F.col("similarity") >= confirm_at)
    return confirmed.select("doc_id", "paragraph", "family", F.round(F.array_max("_chances"), 6).alias("probability"),
                            F.round("similarity", 6).alias("similarity"), F.col("piece").alias("text"))
