"""Licence scans: a trained paragraph classifier, scored with DataFrame operations only.

A paragraph is a line of a text, or a run of lines between blank ones, joined (a wrapped
notice).  A paragraph is described by its distinct word 1- and 2-grams; a sparse multinomial
logistic regression over families and an unknown class gives probabilities, scaled by a
temperature fitted on held-out samples.  A paragraph is reported if the classifier holds it for
a family's notice with a probability of ``NAME_AT`` or more (the candidate); the family is named
only if enough of a template of that family stands in the paragraph, else it is unknown.

The model is trained here on the driver, from the templates below with seeded variations;
its table (under a thousand rows, whatever the input) is broadcast.  Grams of function words
alone are no features.  From the weights follows a set of words (``needed_words``) without any
of which no paragraph can reach ``NAME_AT``, whatever else stands in it; texts and paragraphs
without them are passed over, which changes no result (a test compares with a plain scorer of
all paragraphs).

Null and empty texts have no paragraphs, an empty table gives no rows; repeated rows are scanned
each; other columns are ignored.
"""

import functools
import json
import random
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAME_AT = 0.6
CONFIRM_SHARE = 0.7
UNKNOWN = "unknown"
#: Notices by family (fixed values: the usual public wordings).
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is distributed under the terms of the MIT License", "SPDX-License-Identifier: MIT", "Released under MIT", "Licensed under MIT", "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license", "Distributed under the Apache License", "Apache-2.0", "Licensed under Apache 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL version 2", "Released under GPLv3", "GPL-3.0", "licensed under the GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "This library is licensed under the LGPL", "LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", "This service is released under the AGPL", "AGPL-3.0", "under the terms of the GNU Affero General Public License"],
    "BSD": [
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD license", "Distributed under the 2-clause BSD license", "BSD-3-Clause", "Distributed under BSD terms",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Released under the MPL 2.0 license", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the CC-BY license", "Text is licensed under Creative Commons Attribution"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 License.", "Content is available under CC-BY-SA", "Text is licensed under Creative Commons Attribution-ShareAlike"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License.", "Available under CC-BY-NC", "Text is licensed under Creative Commons Attribution-NonCommercial"],
    "public domain": ["Released under CC0 1.0.", "This work is dedicated to the public domain under CC0.", "To the extent possible under law, the author has waived all copyright to this work", "This is free and unencumbered software released into the public domain. unlicense"],
    "reserved": ["All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "No part of this publication may be reproduced without prior permission. Copyright", "Proprietary and confidential. Unauthorized copying is prohibited. Copyright"],
}
#: Uses of the same words that are no notices.
OTHERS = [
    "He lost his driving license last year", "a licensed therapist will see you", "poetic license is allowed here", "the licence fee for television rose", "the city may license taxi drivers",
    "copyright law was debated in parliament", "the court heard a copyright case", "an apache helicopter landed", "the apache people lived there", "the car comes with a warranty of two years",
    "a domain name that anyone can register", "public transport in the domain of the city", "she studied at mit before", "the bsd conference is in may", "the gnu is a large antelope", "the mozilla office moved",
    "rights of workers were reserved for later talks", "a creative commons room for all tenants", "fishing licenses are sold at the lake", "license plates of the cars", "you need a licence to fish", "the software license costs ten dollars",
    "a license agreement was signed by both firms", "the free software movement began", "the general public was invited", "permission to land was granted", "a copy of the letter was sent", "the terms of the treaty", "he was licensed to practise medicine",
    "sie fuhr mit dem zug in die stadt", "er sprach mit der frau und mit den kindern", "das haus mit garten ist nicht weit von hier", "mit ihr", "wir gehen auch mit", "ein mann mit hut sitzt auf der bank im park", "für die schule und zu den eltern", "es ist sich des weges als gast bewusst",
    "il est venu avec des amis de la ville", "les enfants et le chien sont dans la maison", "el hombre de la casa vino con los otros", "una carta para el profesor que no es de la escuela",
    "source and binary stars", "compliance with the law", "version 2.0 of the plan", "attribution of the painting is disputed", "no part of the house was painted",
]
WORD = re.compile(r"[a-z0-9]+(?:[.+][a-z0-9]+)*")
WORD_SQL = "[a-z0-9]+(?:[.+][a-z0-9]+)*"
#: Words that say nothing alone (fixed values).
FUNCTION = frozenset(
    "a all an and any are as at be been but by can do except for from had has have he her his i if in into is it its may more my no not of on one only or other our out part she so such that the their there "
    "they this to under up use was we were what when which who will with without would you your der die das und mit ist nicht auch ein eine im von zu auf den dem le la les de des du et un une est el los con en no que para por una".split()
) - {"mit"}
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams_of(text):
    """The distinct 1- and 2-grams of a paragraph."""
    words = WORD.findall(text.translate(LOWER))
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def needed_words(families, vocabulary, w, b, temperature):
    """Words of which a paragraph holds one at least if a family's probability can reach ``NAME_AT``.

    Without them, even all other grams that speak for a family stay below: words are taken, those
    first that carry most, until that holds for every family.
    """
    lead = (w[:, 1:] - w[:, :1]) / temperature
    gap = np.log(NAME_AT / (1 - NAME_AT)) - (b[1:] - b[0]) / temperature
    needed: set[str] = set()
    while True:
        rest = [g for g in vocabulary if needed.isdisjoint(g.split())]
        total = sum(np.maximum(lead[vocabulary[g]], 0) for g in rest) if rest else np.zeros(len(gap))
        over = total - gap
        if over.max() < -1e-6:
            return sorted(needed)
        carried: dict[str, float] = {}
        for g in rest:
            for word in set(g.split()) - FUNCTION:
                carried[word] = carried.get(word, 0) + max(0.0, float(lead[vocabulary[g], over.argmax()]))
        needed.add(max(sorted(carried), key=carried.get))


def samples(seed):
    """(paragraph, family) with seeded variations: other words around, words lost, notices joined to prose."""
    r = random.Random(seed)
    around = [w for t in OTHERS for w in t.split()] + "the of and a to in is that it was for on are as with his they at be this from have or by one had not but what all were".split()
    out = []
    for family, templates in TEMPLATES.items():
        for template in templates:
            for i in range(14):
                words = template.split()
                if i:
                    words = [w for w in words if r.random() > 0.04]
                    left = [r.choice(around) for _ in range(r.choice([0, 0, 3, 12]))]
                    words = left + words + [r.choice(around) for _ in range(r.choice([0, 0, 3, 12]))]
                out.append((" ".join(words), family))
    for text in OTHERS:
        for i in range(16):
            out.append((" ".join([r.choice(around) for _ in range(r.choice([0, 3, 20]))] + text.split() + [r.choice(around) for _ in range(r.choice([0, 3, 20]))]) if i else text, UNKNOWN))
    return out


@functools.cache
def model():
    """(families, vocabulary, weights by gram and family, biases, temperature)."""
    train, held = samples(1), samples(2)
    families = [UNKNOWN, *TEMPLATES]
    times: dict[str, int] = {}
    for text, _ in train:
        for g in grams_of(text):
            times[g] = times.get(g, 0) + 1
    own = {g for ts in TEMPLATES.values() for t in ts for g in grams_of(t)} | {g for t in OTHERS for g in grams_of(t)}
    vocabulary = {g: i for i, g in enumerate(sorted(g for g in own if not FUNCTION.issuperset(g.split())))}

    def matrix(data):
        x = np.zeros((len(data), len(vocabulary)), dtype=np.float32)
        for i, (text, _) in enumerate(data):
            x[i, [vocabulary[g] for g in grams_of(text) if g in vocabulary]] = 1
        return x, np.array([families.index(f) for _, f in data])

    x, y = matrix(train)
    target = np.eye(len(families), dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], len(families)), dtype=np.float32), np.zeros(len(families), dtype=np.float32)
    b[0] = 1.0
    for step in range(150):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) / len(x)
        rate = 8.0 / (1 + step / 100)
        w = w - rate * (x.T @ g + 1e-4 * w)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * 2e-5, 0)  # sparse
        b -= rate * g.sum(0) * 0.1
    xh, yh = matrix(held)
    z = xh @ w + b

    def loss(t):
        s = z / t
        s = s - s.max(1, keepdims=True)
        return -(s[np.arange(len(yh)), yh] - np.log(np.exp(s).sum(1))).mean()

    temperature = min((0.4 + 0.1 * k for k in range(40)), key=loss)
    return families, vocabulary, w, b, float(temperature)


def tables(spark):
    """The model as a DataFrame (gram, w, templates), the templates' families and sizes, biases, temperature."""
    families, vocabulary, w, b, temperature = model()
    flat = [(family, grams_of(t) & vocabulary.keys()) for family, ts in TEMPLATES.items() for t in ts]
    rows = []
    for gram, i in vocabulary.items():
        held = [k for k, (_, grams) in enumerate(flat) if gram in grams]
        if held or np.any(w[i]):
            rows.append({"gram": gram, "w": [round(float(v), 5) for v in w[i]], "templates": held})
    form = "array<struct<gram string, w array<double>, templates array<int>>>"
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), form)).alias("r")).select("r.*")
    return families, table, [(f, len(g)) for f, g in flat], [float(v) for v in b], temperature


PACK = 9  # counts of 7 bits in a whole number


def units_of(docs: DataFrame, needed: str) -> DataFrame:
    """doc, doc_id, start, paragraph, lines, line: each line, and each run of lines between blank ones as one, that match ``needed``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text")).filter(F.col("text").rlike(needed))
    rows = rows.withColumn("doc", F.monotonically_increasing_id()).withColumn("l", F.split("text", "\n"))
    rows = rows.withColumn("full", F.expr("transform(l, x -> x rlike '[^ \\\\t\\\\r\\\\f]')")).withColumn("i", F.expr("sequence(0, size(l) - 1)"))
    first = F.expr("filter(i, k -> full[k] and (k = 0 or not full[greatest(k - 1, 0)]))").alias("a")
    last = F.expr("filter(i, k -> full[k] and (k = size(l) - 1 or not full[least(k + 1, size(l) - 1)]))").alias("b")
    rows = rows.select("doc", "doc_id", "l", F.arrays_zip(first, last).alias("runs"))
    each = "transform(slice(l, x.a + 1, x.b - x.a + 1), (t, j) -> struct(x.a as start, x.a + j as paragraph, 1 as lines, t as line))"
    whole = "transform(filter(array(x), y -> y.b > y.a), y -> struct(y.a as start, y.a as paragraph, y.b - y.a + 1 as lines, array_join(slice(l, y.a + 1, y.b - y.a + 1), ' ') as line))"
    units = rows.select("doc", "doc_id", F.explode(F.expr(f"flatten(transform(runs, x -> concat({each}, {whole})))")).alias("u")).select("doc", "doc_id", "u.*")
    return units.filter(F.col("line").rlike(needed))


def pattern_of(words) -> str:
    """A pattern that finds any of the words, by first letter."""
    by: dict[str, list[str]] = {}
    for word in words:
        by.setdefault(word[0], []).append(re.escape(word[1:]))
    return "(?<![a-z0-9])(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by.items())) + ")(?![a-z0-9])"


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its first line, from 0), lines, family, candidate, probability, template_share, confirmed.

    Rows: lines with a candidate, and runs of several lines in which more of a template of their
    candidate stands than in any one of the lines.
    """
    families, table, templates, bias, temperature = tables(docs.sparkSession)
    packs = [range(k, min(k + PACK, len(templates))) for k in range(0, len(templates), PACK)]
    for j, pack in enumerate(packs):
        held = [F.when(F.array_contains("templates", k), F.lit(1 << 7 * (k - pack[0]))).otherwise(0).cast("long") for k in pack]
        table = table.withColumn(f"t{j}", functools.reduce(lambda x, y: x + y, held))
    table = table.select("gram", *[F.col("w")[k].alias(f"w{k}") for k in range(len(families))], *[f"t{j}" for j in range(len(packs))])
    units = units_of(docs, pattern_of(needed_words(*model()))).withColumn("row", F.monotonically_increasing_id())
    words = F.regexp_extract_all("line", F.lit(WORD_SQL), F.lit(0))
    pairs = F.expr("zip_with(words, slice(words, 2, greatest(size(words) - 1, 0)), (a, b) -> if(b is null, null, concat(a, ' ', b)))")
    grams = F.array_distinct(F.concat("words", F.when(F.size("words") > 1, pairs).otherwise(F.array().cast("array<string>"))))
    keys = ["row", "doc", "doc_id", "start", "paragraph", "lines"]
    each = units.withColumn("words", words).select(*keys, F.explode(grams).alias("gram")).filter("gram is not null")
    hits = each.join(F.broadcast(table), "gram")
    sums = [F.sum(f"w{k}").alias(f"z{k}") for k in range(len(families))] + [F.sum(f"t{j}").alias(f"t{j}") for j in range(len(packs))]
    scored = hits.groupBy(*keys).agg(*sums)
    z = F.array(*[((F.col(f"z{k}") + bias[k]) / temperature).alias(f"s{k}") for k in range(len(families))])
    scored = scored.withColumn("z", z).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("best", F.expr("array_position(z, top)")).withColumn("p", F.expr("1 / aggregate(z, 0D, (a, x) -> a + exp(x - top))"))
    scored = scored.withColumn("candidate", F.element_at(F.array(*map(F.lit, families)), F.col("best").cast("int")))
    named = scored.filter((F.col("p") >= NAME_AT) & (F.col("candidate") != UNKNOWN))
    count = lambda k: F.shiftright(F.col(f"t{k // PACK}"), 7 * (k % PACK)).bitwiseAND(127)
    share = F.greatest(F.lit(0.0), *[F.when(F.col("candidate") == f, count(k) / n) for k, (f, n) in enumerate(templates)])
    out = named.withColumn("template_share", share)
    line = F.max(F.when(F.col("lines") == 1, F.col("template_share"))).over(Window.partitionBy("doc", "start", "candidate"))
    out = out.withColumn("line_share", F.coalesce(line, F.lit(0.0))).filter("lines = 1 or template_share > line_share")
    confirmed = F.col("template_share") >= CONFIRM_SHARE
    family = F.when(confirmed, F.col("candidate")).otherwise(UNKNOWN).alias("family")
    return out.select("doc_id", F.col("paragraph").cast("int"), F.col("lines").cast("int"), family, "candidate", F.round("p", 4).alias("probability"), F.round("template_share", 4).alias("template_share"), confirmed.alias("confirmed"))
