"""Licence families of paragraphs by sparse word n-gram logistic regression, confirmed against templates.

A paragraph is a run of lines between blank ones. It is judged by its statements, whose lines are taken together, so that
a notice wrapped over lines is read whole and a paragraph that grants two licences yields both.
The main path is DataFrame functions only; the classifier is fitted with MLlib on the notices below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored

#: Public licence notices by family.
NOTICES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "See the GNU Affero General Public License for more details.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsl-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL.",
        "Released under the GNU GPL, version 3 or later.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
        "See the GNU General Public License for more details.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the LGPL.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "See the GNU Lesser General Public License for more details.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.", "Copyright the authors. All rights reserved.", "No license is granted to any party."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
        "SPDX-License-Identifier: Zlib",
    ],
}
#: Names by which a licence is granted in a line of its own.
NAMES = {
    "agpl": ["AGPL-3.0", "GNU Affero General Public License"],
    "apache-2.0": ["Apache-2.0 license", "Apache License 2.0"],
    "bsd": ["BSD-3-Clause license", "BSD license"],
    "bsl-1.0": ["BSL-1.0", "Boost Software License"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 license"],
    "cc0": ["CC0", "CC0 1.0 license"],
    "epl-2.0": ["EPL-2.0", "Eclipse Public License"],
    "gpl": ["GPL-3.0", "GPLv2 license", "GNU General Public License"],
    "isc": ["ISC", "ISC license"],
    "lgpl": ["LGPL-2.1", "GNU Lesser General Public License"],
    "mit": ["MIT", "MIT license"],
    "mpl-2.0": ["MPL-2.0", "Mozilla Public License"],
    "unlicense": ["Unlicense"],
    "zlib": ["zlib", "zlib license"],
}
#: Ways to grant a named licence.
GRANTS = ["Licensed under {}.", "Licensed under the {}.", "The code is under the {}.", "This project is released under the terms of the {}.", "License: {}"]
#: Sentences that use the same words without granting a licence.
OTHER = [
    "A driving licence must be carried at all times.",
    "The driver's license was issued by the state.",
    "The committee gave permission to build the bridge.",
    "She asked for permission to leave the room.",
    "The warranty covers parts and labour for two years.",
    "The fishing license costs ten dollars.",
    "Copyright law protects original works.",
    "The court heard a copyright dispute.",
    "The restaurant has a licence to sell alcohol.",
    "A table was reserved for six guests.",
    "The Apache helicopter landed at noon.",
    "Members of the House of Commons voted.",
    "His domain was the kitchen.",
    "The redistribution of land took years.",
    "The museum is open to the general public.",
    "The licence plate was missing.",
    "Please read the license agreement before you install the program.",
    "Artistic licence is part of every novel.",
    "The statue was dedicated to the city.",
    "The software was licensed to several companies last year.",
    "The licensing office is closed on Mondays.",
    "Her driving licence had expired in May.",
    "Permission to land was refused by the tower.",
    "The warranty does not cover damage by water.",
    "A copyright notice was printed on the last page.",
    "Two seats were reserved under his name.",
    "The committee may permit a later date; nothing else is permitted.",
    "Apache warriors rode across the plain.",
    "The gnu is a large antelope of the savannah.",
    "The domain of the function is the real line.",
    "A proprietary recipe made the bakery famous.",
    "The house has a public domain on its southern side.",
    "All rooms were reserved by the hotel.",
    "All rights reserved by the hotel include late arrival.",
    "All rights reserved by the host are listed below.",
    "The landlord reserved all rights to the garden.",
    "He was licensed under the old rules of the state.",
    "The trade is licensed under the law of the city.",
    "Licensed under protest, the bar stayed open.",
    "The eclipse began at noon and no permission was needed to watch it.",
    "The boost to sales was reserved for the spring.",
]
UNKNOWN = "unknown"
# Every feature holds one of these, so a line without any of them has no feature and is of no known family.
_ANCHOR = r"licen[sc]\p{L}*|unlicensed?|copyright\p{L}*|warrant\p{L}*|permission|permitted|redistribut\p{L}*|gnu|spdx|cc|cc0|reserved|commons|mozilla|apache|bsd|bsl|a?gpl|gplv[23]|lgpl|mpl|isc|mit|epl|zlib|dedicated|proprietary|domain|unencumbered"
_BLANK = r"\n[^\p{L}\p{N}]*\n"
# A statement ends with its sentence, or before a line that opens a notice.
_CUT = r"""(?<=[.!?]["')\]]{0,2})(?:[^\S\n]*\n|\s+(?=["'(\[]?\p{Lu}))|\n(?=[^\p{L}\p{N}\n]*(?:SPDX|Copyright|Licensed|Released|All rights|This (?:work|program|library|software)|Permission|Redistributions?)(?![\p{L}\p{N}]))"""
_IN_TEXT = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{_ANCHOR})(?![\p{{L}}\p{{N}}])"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    run = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", F.slice(words, i + 1, n)))
    return F.when(F.size(words) >= n, run).otherwise(F.array().cast("array<string>"))


def _grams(words: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Word n-grams, those of each size in order."""
    return F.concat(*[_runs(words, n) for n in sizes])


def _features(words: Column) -> Column:
    return F.filter(_grams(words), lambda g: g.rlike(rf"(?:^| )(?:{_ANCHOR})(?: |$)"))


def statements(text: Column) -> Column:
    """[(paragraph, position, statement)] of a text, those that hold a feature's word."""
    inner = lambda p, i: F.transform(F.split(p, _CUT), lambda x, j: F.struct(i.alias("paragraph"), j.alias("position"), x.alias("statement")))
    found = F.filter(F.flatten(F.transform(F.split(text, _BLANK), inner)), lambda x: x["statement"].rlike(_IN_TEXT))
    return F.when(text.rlike(_IN_TEXT), found).otherwise(F.array().cast("array<struct<paragraph:int,position:int,statement:string>>"))


@dataclass
class LicenceModel:
    """weights: (feature, w array, one a class); bias; families, the last of which is unknown.

    slope, offset: the calibration, by which log-odds of the best family become the probability that it is right.
    """

    weights: DataFrame
    bias: list[float]
    families: list[str]
    slope: float
    offset: float


FOLDS = 4


def notices(family: str) -> list[str]:
    """The family's notices, and each of its names in each way of granting."""
    return NOTICES[family] + [g.format(n) for n in NAMES.get(family, []) for g in GRANTS]


def training_rows(spark: SparkSession) -> DataFrame:
    """(label, features, fold): each notice and each other sentence, whole and broken off; a notice's parts share its fold."""
    families = sorted(NOTICES)
    rows = [(float(families.index(f)), i % FOLDS, t) for f in families for i, t in enumerate(notices(f))] + [(float(len(families)), i % FOLDS, t) for i, t in enumerate(OTHER)]
    one = spark.range(0, 1, 1, 1)  # the rows above are few: one partition
    table = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(k).alias("fold"), F.lit(b).alias("text")) for a, k, b in rows])).alias("x")).select("x.*")
    # a notice may break off: its halves are examples too, where they still hold features
    words = table.withColumn("words", _words(F.col("text"))).select("label", "fold", F.explode(F.array("words", F.slice("words", 1, F.greatest(F.lit(4), F.ceil(F.size("words") / 2)).cast("int")))).alias("words"))
    return words.select("label", "fold", _features(F.col("words")).alias("features")).where(F.size("features") > 0)


def _log_odds(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), p))
    return F.log(p) - F.log(1 - p)


def fit_licences(spark: SparkSession) -> LicenceModel:
    """Multinomial logistic regression over the features' presence; features of unknown text alone give the unknown class.

    The unknown class is calibrated by Platt's scaling: every notice and other sentence is scored by a model that has seen
    none of its parts, and a logistic curve over the best family's log-odds is fitted to whether that family is right.
    Right and wrong weigh the same in all.
    """
    rows = training_rows(spark)
    vocabulary = CountVectorizer(inputCol="features", outputCol="x", binary=True, minDF=1).fit(rows)
    data = vocabulary.transform(rows).cache()
    families = [*sorted(NOTICES), UNKNOWN]
    logistic = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=0.0005, maxIter=40, standardization=False)
    known = F.slice(vector_to_array(F.col("probability")), 1, len(families) - 1)
    best = F.array_max(known)
    right = (F.array_position(known, best) - 1 == F.col("label")).cast("double").alias("label")
    held = None
    for k in range(FOLDS):
        scored = logistic.fit(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k)).select(array_to_vector(F.array(_log_odds(best))).alias("x"), right)
        held = scored if held is None else held.unionByName(scored)
    held = held.coalesce(1).cache()
    n_right, n = held.agg(F.sum("label"), F.count("*")).first()
    weighted = held.withColumn("weight", F.when(F.col("label") == 1, F.lit(n / (2 * n_right))).otherwise(F.lit(n / (2 * (n - n_right)))))
    curve = LogisticRegression(featuresCol="x", weightCol="weight", regParam=0.001, maxIter=80).fit(weighted)
    model = logistic.fit(data)
    held.unpersist()
    data.unpersist()
    w = model.coefficientMatrix.toArray()
    entries = [F.struct(F.lit(g).alias("feature"), F.array(*[F.lit(float(x)) for x in w[:, k]]).alias("w")) for k, g in enumerate(vocabulary.vocabulary) if k < w.shape[1]]
    # literals in blocks keep each expression small; the vocabulary is fixed by the notices
    blocks = [spark.range(0, 1, 1, 1).select(F.explode(F.array(*entries[i : i + 200])).alias("x")).select("x.*") for i in range(0, len(entries), 200)]
    weights = blocks[0]
    for b in blocks[1:]:
        weights = weights.unionByName(b)
    return LicenceModel(stored(weights.coalesce(1), "licence-weights"), [float(x) for x in model.interceptVector], families, float(curve.coefficients[0]), float(curve.intercept))


def templates(spark: SparkSession) -> DataFrame:
    """(family, template grams): pairs of neighbouring words of each notice."""
    rows = [(f, t) for f in sorted(NOTICES) for t in notices(f)]
    table = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("text")) for a, b in rows])).alias("x")).select("x.*")
    return table.select("family", F.array_distinct(_grams(_words(F.col("text")), (2,))).alias("template"))


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text", alike: float = 0.6) -> DataFrame:
    """(row, id, paragraph, position, statement, family, probability, likeness, confirmed): every statement that holds a
    feature's word, by the number of its paragraph and its place in it.

    A family is predicted where its calibrated probability is a half or more, and confirmed where a template of it shares
    `alike` of the smaller one's word pairs; other statements are unknown. Of families with the same probability the first
    by name is taken. Documents without such a statement give one row with null family, so every row of docs is there,
    repeated ones too. Nulls count as empty; texts are read whole; other columns of docs are left aside, whatever their
    names; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    found = statements(F.coalesce(F.col(text_col), F.lit("")))
    base = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), found.alias("statements")), "licence-statements")
    every = base.select("row", F.explode("statements").alias("x")).select("row", "x.*").withColumn("words", _words(F.col("statement")))
    found = every.select("row", "paragraph", "position", F.explode(F.array_distinct(_features(F.col("words")))).alias("feature")).join(F.broadcast(model.weights), "feature")
    n = len(model.families)
    sums = found.groupBy("row", "paragraph", "position").agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(n)])
    scored = every.join(sums, ["row", "paragraph", "position"], "left").withColumn("s", F.array(*[F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + F.lit(model.bias[k]) for k in range(n)])).drop(*[f"s{k}" for k in range(n)])
    scored = scored.withColumn("e", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    scored = scored.withColumn("p", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)))
    known = F.slice("p", 1, n - 1)
    names = F.array(*[F.lit(f) for f in model.families])
    right = 1 / (1 + F.exp(-(_log_odds(F.col("best")) * model.slope + model.offset)))
    best = scored.withColumn("best", F.array_max(known)).withColumn("probability", right).withColumn("predicted", F.when(F.col("probability") >= 0.5, F.element_at(names, F.array_position(known, F.col("best")).cast("int"))))
    pairs = F.array_distinct(_grams(F.col("words"), (2,)))
    best = best.withColumn("pairs", F.when(F.col("predicted").isNotNull(), pairs).otherwise(F.array().cast("array<string>")))
    compared = best.join(F.broadcast(templates(spark)), F.col("predicted") == F.col("family"), "left")
    like = F.size(F.array_intersect("pairs", "template")) / F.greatest(F.lit(1), F.least(F.size("pairs"), F.size("template")))
    judged = compared.groupBy("row", "paragraph", "position").agg(F.first("statement").alias("statement"), F.first("predicted").alias("predicted"), F.first("probability").alias("probability"), F.max(F.coalesce(like, F.lit(0.0))).alias("likeness"))
    confirmed = F.col("predicted").isNotNull() & (F.col("likeness") >= alike)
    judged = judged.select("row", "paragraph", "position", "statement", F.when(confirmed, F.col("predicted")).otherwise(UNKNOWN).alias("family"), F.round("probability", 6).alias("probability"), F.round("likeness", 6).alias("likeness"), confirmed.alias("confirmed"))
    return base.select("row", "id").join(judged, "row", "left").withColumnRenamed("id", id_col)


def op4_licences(spark, sf_dir: str) -> DataFrame:
    """Per document: its confirmed families, how many of its paragraphs confirm one, how many that hold a feature's word
    confirm none, the best probability."""
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), fit_licences(spark))
    n_confirmed = F.size(F.collect_set(F.when(F.col("confirmed"), F.col("paragraph")))).cast("long")
    sums = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family"))))).alias("families"),
        n_confirmed.alias("n_confirmed"),
        (F.size(F.collect_set("paragraph")) - n_confirmed).cast("long").alias("n_unknown"),
        F.coalesce(F.max(F.when(F.col("confirmed"), F.col("probability"))), F.lit(0.0)).alias("probability"),
    )
    return sums.drop("row")
