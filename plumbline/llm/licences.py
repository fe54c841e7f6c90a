"""Licence scans by a trained paragraph classifier, in DataFrame operations only.

A paragraph is what stands between blank lines, its lines joined, if all of them are short (hard-wrapped); else each of its
lines. Paragraphs are bags of word 1- to 3-grams over the vocabulary of the templates and of talk about licences. Those with a
stem of the vocabulary (STEMS, and NAMES as they are written) go to a multinomial logistic regression, trained on paragraphs of every
family, on licence talk that grants nothing, and on a bounded sample of the corpus's own paragraphs with a stem that no template explains.
A prediction counts where its probability passes a bound, calibrated between held-out paragraphs of the unknown class and
held-out mutilated ones of the families, and the paragraph shares most of its words with a template of the family.

Families: see TEMPLATES; other licences are `none`, or the family whose words they have. Result for every row of docs: the family
of the most probable confirmed paragraph, or `none`. Null or empty text has `none`. Rows with null or repeated doc_id are
kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import stored

#: Phrases and paragraphs by which public licences are named or granted. Fixed values.
TEMPLATES = {
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program if not see",
        "distributed under the gnu general public license version 2 or later",
        "released under the terms of the gnu gpl license",
        "spdx license identifier gpl 3 0 or later",
        "gpl 2 0 only",
    ],
    "lgpl": [
        "this library is licensed under the gnu lesser general public license version 2 1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "distributed under the terms of the gnu lesser general public license",
        "you should have received a copy of the gnu lesser general public license along with this library",
        "spdx license identifier lgpl 2 1",
        "lgpl 3 0",
    ],
    "agpl": [
        "this program is licensed under the gnu affero general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "you should have received a copy of the gnu affero general public license along with this program",
        "spdx license identifier agpl 3 0 only",
        "agpl 3 0",
    ],
    "mit": [
        "released under the mit license",
        "released under mit terms",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability",
        "licensed under the mit license see the license file",
        "spdx license identifier mit",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed to the apache software foundation under one or more contributor license agreements see the notice file distributed with this work for additional information regarding copyright ownership",
        "spdx license identifier apache 2 0",
        "apache 2 0",
        "released under the apache software license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "licensed under the bsd 3 clause license",
        "distributed under the bsd 3 clause terms",
        "released under the simplified bsd license",
        "spdx license identifier bsd 2 clause",
        "bsd 3 clause",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "released under the isc license",
        "spdx license identifier isc",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
        "licensed under the mozilla public license version 2 0",
        "spdx license identifier mpl 2 0",
        "mpl 2 0",
    ],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
        "licensed under the eclipse public license v2 0",
        "under the eclipse public license v 2 0",
        "spdx license identifier epl 2 0",
    ],
    "public-domain": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "released under the unlicense",
        "to the extent possible under law the author has waived all copyright and related rights to this work cc0 1 0 universal",
        "licensed under cc0 1 0",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        "licensed under cc by nc sa 4 0",
        "licensed under cc by nc nd 4 0",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ],
    "cc-by": [
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ],
    "proprietary": [
        "copyright all rights reserved no part of this work may be reproduced without written permission",
        "all rights reserved unauthorised copying of this file is prohibited copyright",
        "proprietary and confidential all rights reserved license required",
    ],
}
UNKNOWN = "none"
#: Licence talk that grants nothing: the unknown class has it beside the corpus's own paragraphs.
TALK = [
    "you need a driving license to rent a car here",
    "the pub lost its license last year",
    "poetic license is a matter of taste",
    "the license fee was raised again",
    "please ask for permission before you enter",
    "the copyright debate went on for years",
    "a fishing license costs twelve dollars",
    "his pilot license was revoked and his fishing license too",
    "she has a license to practise medicine",
    "she renewed her license",
    "they asked for permission to leave the room",
    "we had permission to use the software in the lab as is known",
    "the software is free of charge for schools",
    "the warranty covers any damage of the machine for two years",
    "the general public was not told of the terms",
    "the source of the river is in the public domain of the county",
    "he has the rights to the film and to the book",
    "a copy of the notice is provided with the goods",
    "this file is a list of conditions in the contract",
    "the apache people lived in the southwest",
]
#: What sends a paragraph to the model, in any case and as written. Fixed values.
STEMS = ["licen[cs]", "copyright", r"\bgnu\b", "apache", "permission", "rights reserved", "redistribut", "mozilla", "creative commons", r"\bcc[ -](?:by|0)", "spdx", "warrant", "merchantab", "public domain", "sublicens", "unencumbered", "without fee"]
NAMES = ["MIT", "BSD", "MPL", "ISC", "EPL", "GPL", "LGPL", "AGPL", "CC0", "Eclipse Public", "Anyone is free"]
STEM = f"(?i:{'|'.join(STEMS)})|\\b(?:{'|'.join(NAMES)})"
WRAP = 100  # characters of the longest line of a hard-wrapped paragraph
BACKGROUND = 400  # corpus paragraphs with a stem that teach the unknown class
CONFIRM = 0.6  # least share of the shorter of paragraph and template that both have
FAMILIES = [*TEMPLATES, UNKNOWN]


def words(text: Column) -> Column:
    """The lower-case words of a paragraph; marks and dots in numbers part them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]++"), lambda w: w != "")


def ngrams(w: str) -> Column:
    """The 1- to 3-grams of a column of words."""
    return F.expr(f"flatten(transform(array(1, 2, 3), n -> transform(if(size({w}) >= n, sequence(1, size({w}) - n + 1), array()), i -> array_join(slice({w}, i, n), ' '))))")


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text that have a stem."""
    parts = F.split(text, r"\r?\n[ \t]*(?:\r?\n[ \t]*)+")

    def lines(p: Column) -> Column:
        own = F.split(p, r"\r?\n|\r")
        return F.when(F.forall(own, lambda x: F.length(x) <= WRAP), F.array(F.array_join(own, " "))).otherwise(own)

    return F.filter(F.flatten(F.transform(F.filter(parts, lambda p: p.rlike(STEM)), lines)), lambda p: p.rlike(STEM))


def _shared(own: Column, template: Column) -> Column:
    """The overlap of two arrays of different words, of the smaller of both."""
    return F.size(F.array_intersect(own, template)) / F.greatest(F.least(F.size(own), F.size(template)), F.lit(2))


def _templates() -> Column:
    """The different words of every template, as one literal array."""
    some = ", ".join(f"array_distinct(split('{t}', ' '))" for ts in TEMPLATES.values() for t in ts)
    return F.expr(f"array({some})")


def _variants(t: str) -> list[str]:
    return [t, "# " + t, t + " all files", "this dataset is " + t, t + " see the notice", "note " + t]


def _mutilated(t: str) -> list[str]:
    """The template with every sixth word lost, and cut to its first two thirds if it is long: no training row."""
    w = t.split()
    out = [" ".join(x for k, x in enumerate(w) if k % 6 != 4)] if len(w) > 5 else ["in short " + t]
    return out + ([" ".join(w[: 2 * len(w) // 3])] if len(w) > 12 else [])


def fit(spark: SparkSession, found: DataFrame) -> tuple[PipelineModel, float]:
    """(model, bound) of the templates and at most 2 * BACKGROUND of the corpus's paragraphs (w: words, u: different ones).

    Half of the latter teach the unknown class. The bound lies between what the other half and talk reach and what nine of ten
    mutilated templates reach, both as the probability of a family.
    """
    rows = [(family, v, 0) for family, ts in TEMPLATES.items() for t in ts for v in _variants(t)] + [(UNKNOWN, t, 0) for t in TALK for _ in range(2)]
    rows += [(family, v, 1) for family, ts in TEMPLATES.items() for t in ts for v in _mutilated(t)]
    given = spark.createDataFrame(rows, "family string, text string, part int").select("family", words(F.col("text")).alias("w"), "part")
    back = found.select("w", "u").distinct().withColumn("e", F.array_max(F.transform(_templates(), lambda t: _shared(F.col("u"), t)))).where("e < 0.3").orderBy(F.xxhash64("w")).limit(2 * BACKGROUND)
    back = stored(back.select(F.lit(UNKNOWN).alias("family"), "w", F.pmod(F.xxhash64("w"), F.lit(2)).cast("int").alias("part")), "background")
    both = given.unionByName(back).select((F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")) - 1).cast("double").alias("label"), ngrams("w").alias("terms"), "part")
    both = stored(both, "taught")
    vocabulary = sorted({" ".join(t.split()[i : i + n]) for ts in [*TEMPLATES.values(), TALK] for t in ts for n in (1, 2, 3) for i in range(len(t.split()) - n + 1)})
    steps = Pipeline(stages=[CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="features", binary=True), LogisticRegression(maxIter=40, regParam=0.002, family="multinomial")])
    model = steps.fit(both.where("part = 0"))
    held = model.transform(both.where("part = 1")).select("label", F.array_max(F.slice(vector_to_array("probability"), 1, len(TEMPLATES))).alias("p"))
    unknown = F.col("label") == len(TEMPLATES)
    over, under = held.agg(F.max(F.when(unknown, F.col("p"))), F.expr(f"percentile(if(label < {len(TEMPLATES)}, p, null), 0.1)")).first()
    return model, min(0.95, max(0.3, ((over or 0.0) + (under or 1.0)) / 2))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, licence, score, n_paragraphs, families for every row of docs (doc_id, text)."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(STEM), paragraphs(text)).alias("parts")).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "licence-paragraphs")  # the texts are read once
    parts = rows.where("size(parts) > 0").select("row", F.posexplode("parts").alias("place", "text")).select("row", "place", words(F.col("text")).alias("w")).withColumn("u", F.array_distinct("w"))
    model, bound = fit(docs.sparkSession, parts)
    p = model.transform(parts.withColumn("terms", ngrams("w"))).select("row", "place", "u", "prediction", F.array_max(vector_to_array("probability")).alias("p"))
    p = stored(p, "licence-scores")  # a filter above would be pushed below the model's steps and have them run again
    p = p.where((F.col("prediction") < len(TEMPLATES)) & (F.col("p") >= bound))
    p = p.withColumn("family", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("prediction").cast("int") + 1))
    known = docs.sparkSession.createDataFrame([(f, sorted(set(t.split()))) for f, ts in TEMPLATES.items() for t in ts], "family string, template array<string>")  # a row a template
    p = p.join(F.broadcast(known), "family").where(_shared(F.col("u"), F.col("template")) >= CONFIRM)
    best = p.groupBy("row").agg(F.max(F.struct("p", "family")).alias("b"), F.countDistinct("place").alias("n"), F.sort_array(F.collect_set("family")).alias("families"))
    out = rows.select("row", "doc_id").join(best, "row", "left")
    return out.select("doc_id", F.coalesce("b.family", F.lit(UNKNOWN)).alias("licence"), F.coalesce("b.p", F.lit(0.0)).alias("score"), F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("families", F.array().cast("array<string>")).alias("families"))
