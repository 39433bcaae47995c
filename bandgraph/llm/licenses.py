"""Licence families of paragraphs by sparse n-gram logistic regression, confirmed against templates [native]."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from bandgraph.llm.common import own_names, quoted, without
from bandgraph.session import cut, table

#: Paragraphs of the corpus that the model learns as no licence, at most about; each gives a run of this many words.
NEGATIVES, NEGATIVE_WORDS = 4_000, 300
#: Parts of the templates, each of which is left out once to calibrate on wording that the model hasn't seen.
PARTS = 3
#: Words of an n-gram, at most.
GRAMS = 3
#: Least calibrated probability that a paragraph is not of the unknown class; least share of a template's n-grams that
#: confirms the likeliest family.
SURE, CONFIRM = 0.5, 0.5
#: Most n-grams of a template that must be there whole (three words have six), as half of them is any mention.
WHOLE = 6
UNKNOWN = "unknown"
#: Wording of licence notices by family (short public notices and their usual variants).
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
        "Apache License 2.0",
        "Apache License, Version 2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
        "This software is distributed under the terms of the MIT license.",
        "Licensed under the MIT License.",
        "MIT License",
        "The MIT License",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL version 3.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "GNU General Public License v3.0",
        "GNU General Public License, version 3",
        "GNU GPL v3",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "CC BY-NC 4.0",
        "Creative Commons Attribution-NonCommercial 4.0",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "CC BY 4.0",
        "Creative Commons Attribution 4.0",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "CC BY-SA 4.0",
        "Creative Commons Attribution-ShareAlike 4.0",
    ],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the 3-clause BSD License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 3-Clause License",
        "3-clause BSD License",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License 2.0",
        "Mozilla Public License, version 2.0",
    ],
    "cc0-1.0": [
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
        "Released under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "CC0 1.0 Universal",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "All rights reserved.",
        "Proprietary and confidential.",
    ],
}
#: Sentences that name licences or their words without granting one.
MENTIONS = [
    "You need a driving license to rent a car.", "The restaurant lost its liquor license last year.", "Researchers at MIT published a paper on software.",
    "The Apache helicopter was built in the desert.", "He was granted permission to leave free of charge.", "The general public is invited to this free event.",
    "The creative commons of the village is open to all.", "Version 2.0 of the game is out.", "Version 3 of the program fixes many problems.", "The foundation has published a new book.",
    "The source of the river is in the mountains.", "See the file for details of the conditions.", "Copyright law is a subject of this course.",
]
#: Words that are too common in any text to speak for a licence.
PLAIN = set("a an and any as at be by for from has have if in is it may no not of on or other that the their this to under use used was were will with without you your all are can which".split())
#: Between words: all ASCII but letters and digits, one by one for Java's table lookup.
BREAK = "[" + "".join(rf"\x{i:02X}" for i in [*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]) + "]+"


def words(text: str) -> list[str]:
    return [w for w in re.split(BREAK, text.lower()) if w]


def grams(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(ws) - n + 1)}


class Model:
    """Multinomial logistic regression over the n-grams of the templates that hold a word which plain text hasn't.

    Weights are sparse (L1 by soft thresholds). The temperature that calibrates its probabilities, that of the unknown class
    too, is the likeliest for models fitted without a part of the templates, and without some variants of the others, on
    those: so notices of known and of unknown wording both count. A paragraph without such a word has
    no feature, and is unknown by the biases.
    """

    def __init__(self, negatives: list[str], seed: int = 3):
        self.families = [*TEMPLATES, UNKNOWN]
        rng = np.random.default_rng(seed)
        kept = [g for t in TEMPLATES.values() for x in t for g in [grams(words(x))]]
        plain = [ws for n in negatives if (ws := words(n)) and max(len(grams(ws) & k) / len(k) for k in kept) < CONFIRM]
        seen = Counter(w for ws in plain for w in set(ws))
        self.anchors = sorted({w for k in kept for g in k for w in g.split()} - PLAIN - {w for w, n in seen.items() if n > 0.005 * len(plain) + 1})
        anchor = set(self.anchors)
        self.vocabulary = sorted({g for k in kept for g in k if anchor & set(g.split())})
        index = {g: i for i, g in enumerate(self.vocabulary)}
        rows, labels, parts = [], [], []

        def add(ws, label, part):
            rows.append([index[g] for g in grams(ws) if g in index])
            labels.append(label)
            parts.append(part % PARTS if part >= 0 else -1)

        pad = lambda: plain[rng.integers(len(plain))][: rng.integers(0, 12)] if plain else []
        for f, templates in enumerate(TEMPLATES.values()):
            for part, t in enumerate(templates):
                ws = words(t)
                for k in range(24):  # whole, with words lost, or inside other text
                    keep = [w for w in ws if k < 6 or rng.random() > 0.03 * (k - 5) / 2]
                    add((pad() if k % 3 else []) + keep + (pad() if k % 2 else []), f, part)
        for part, ws in enumerate([*plain, *(words(m) for _ in range(20) for m in MENTIONS)]):
            add(ws, len(TEMPLATES), part)
        for w in self.anchors:  # a lone word of a licence is none, whatever the part
            add([w], len(TEMPLATES), -1)
        x = np.zeros((len(rows), len(self.vocabulary)), np.float32)
        for i, r in enumerate(rows):
            x[i, r] = 1
        y = np.array(labels)
        of, margins, truth, new = np.array(parts), [], [], []
        for part in range(PARTS):
            out = (of == part) | (np.arange(len(y)) % 4 == part)  # whole templates, and variants of known ones
            w, b = self._fit(x[~out], y[~out])
            margins.append(x[out] @ w + b)
            truth.append(y[out])
            new.append(of[out] == part)
        self.temperature = self._calibrated(*map(np.concatenate, (margins, truth, new)))
        self.weights, self.bias = self._fit(x, y)

    def _calibrated(self, z, y, new) -> float:
        """The temperature of the least mean loss; families count alike, and in each known and new wording do."""
        kind = 2 * y + new
        weight = 1 / np.bincount(kind)[kind]
        best = []
        for t in np.geomspace(0.5, 4.0, 40):
            e = z / t - (z / t).max(1, keepdims=True)
            best.append((float((weight * (np.log(np.exp(e).sum(1)) - e[np.arange(len(y)), y])).sum()), float(t)))
        return min(best)[1]

    def _fit(self, x, y, steps: int = 150, rate: float = 0.5, l1: float = 2e-5):
        n, k = len(self.vocabulary), len(self.families)
        w, b = np.zeros((n, k), np.float32), np.zeros(k, np.float32)
        gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
        hot = np.eye(k, dtype=np.float32)[y]
        share = 1 / np.maximum(np.bincount(y, minlength=k), 1)
        weight = (share / share[np.unique(y)].sum())[y][:, None].astype(np.float32)  # families count alike
        for _ in range(steps):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - hot) * weight
            g, h = x.T @ d, d.sum(0)
            gw += g * g
            gb += h * h
            step = rate / np.sqrt(gw)
            w = w - step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            b = b - rate * h / np.sqrt(gb)
        return w, b

    def table(self) -> list[tuple[str, list[float]]]:
        """(gram, weight of each family) of n-grams with a weight, over the temperature; bounded by the templates."""
        return [(g, [float(v) for v in r / self.temperature]) for g, r in zip(self.vocabulary, self.weights, strict=True) if np.any(r)]

    def biases(self) -> list[float]:
        return [float(v) for v in self.bias / self.temperature]

    def predict(self, text: str) -> tuple[str, float, float]:
        """(family, probability, share of its closest template) of a paragraph: the plain form of classify()."""
        g = grams(words(text))
        at = [i for i, v in enumerate(self.vocabulary) if v in g]
        z = (self.weights[at].sum(0) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        family = self.families[best]
        found = [(share >= (1.0 if len(k) <= WHOLE else CONFIRM), share) for t in TEMPLATES.get(family, []) for k in [grams(words(t))] for share in [len(g & k) / len(k)]]
        sure, share = max(found, default=(False, 0.0))
        return family if family != UNKNOWN and 1 - p[-1] >= SURE and sure else UNKNOWN, float(p[best]), share


def fit(docs: DataFrame, each: int = NEGATIVES) -> Model:
    """A model from the templates, and from one paragraph of each of about `each` documents as plain text."""
    share = docs.agg(F.least(F.lit(1.0), F.lit(float(each)) / F.greatest(F.count("*"), F.lit(1))).alias("share"))
    picked = docs.select("doc_id", "text").join(F.broadcast(share)).where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    lines = F.split("text", "\n")
    one = picked.where("text IS NOT NULL").select("doc_id", F.get(lines, F.pmod(F.xxhash64("doc_id", F.lit(12)), F.size(lines)).cast("int")).alias("line"))
    w = one.select("doc_id", F.array_remove(F.split(F.lower("line"), BREAK), "").alias("w"))
    start = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.greatest(F.size("w") - NEGATIVE_WORDS + 1, F.lit(1))).cast("int")
    return Model(sorted(r.line for r in w.select(F.array_join(F.slice("w", start + 1, NEGATIVE_WORDS), " ").alias("line")).collect()))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with licences: per paragraph (line) that holds one, (line_no, family, probability, template, share), by line.

    Only SQL functions run here: lines are cut into words; those with a word that licences alone have are cut into
    n-grams; these are joined with the weights (broadcast, bounded by the templates) and added up. A family is found where the
    calibrated probability of the unknown class is 1 - SURE at most, no class is likelier than it, and one of its templates
    has a share of CONFIRM or more of its n-grams in the paragraph, all of them where it has WHOLE at most.

    Null or empty texts have no licences. Equal (id, text) rows get equal results, also null ids. Other columns pass; a
    column licences is replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    k = len(model.families)
    weights = F.broadcast(spark.createDataFrame(model.table(), "gram string, weight array<double>"))
    forms = [(f, i, g, len(gs)) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for gs in [grams(words(t))] for g in sorted(gs)]
    forms = F.broadcast(spark.createDataFrame(forms, "t_family string, template int, gram string, n_grams int"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")  # first, or it is made for each line
    lines = keyed.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = F.array_remove(F.split(F.lower("line"), BREAK), "")
    lines = lines.select("doc_id", "text_key", "line_no", w.alias("w")).where(F.arrays_overlap("w", F.array(*map(F.lit, model.anchors))))
    n = F.size("w")

    def run(j: int):
        at = F.sequence(F.lit(1), F.greatest(n - j + 1, F.lit(1)))
        return F.when(n >= j, F.transform(at, lambda i: F.array_join(F.slice("w", i, j), " "))).otherwise(F.array().cast("array<string>"))

    runs = [run(j) for j in range(1, GRAMS + 1)]
    keys = ("doc_id", "text_key", "line_no")
    found = cut(lines.select(*keys, F.array_distinct(F.concat(*runs)).alias("grams")).distinct())
    each = found.select(*keys, F.explode("grams").alias("gram"))
    votes = each.join(weights, "gram").groupBy(*keys).agg(*(F.sum(F.get("weight", F.lit(i))).alias(f"z{i}") for i in range(k)))
    scores = [F.col(f"z{i}") + F.lit(b) for i, b in enumerate(model.biases())]
    top = F.greatest(*scores)
    best = F.get(F.array(*map(F.lit, model.families)), (F.array_position(F.array(*scores), top) - 1).cast("int"))
    each_one = lambda z: F.exp(z - top) / sum((F.exp(y - top) for y in scores), F.lit(0.0))
    votes = votes.select(*(F.col(c).alias(f"v_{c}") for c in keys), best.alias("family"), each_one(top).alias("probability"), each_one(scores[-1]).alias("none"))
    votes = votes.where((F.col("family") != UNKNOWN) & (1 - F.col("none") >= SURE)).drop("none")
    size = F.first("n_grams")
    shares = each.join(forms, "gram").groupBy(*keys, "t_family", "template").agg((F.count("*") / size).alias("share"), F.when(size <= WHOLE, 1.0).otherwise(CONFIRM).alias("least"))
    same = F.col("doc_id").eqNullSafe(F.col("v_doc_id")) & (F.col("text_key") == F.col("v_text_key")) & (F.col("line_no") == F.col("v_line_no")) & (F.col("t_family") == F.col("family"))
    sure = shares.join(votes, same).where(F.col("share") >= F.col("least")).groupBy(*keys).agg(F.max(F.struct("share", (-F.col("template")).alias("t"), "family", "probability")).alias("m"))
    row = F.struct("line_no", F.col("m.family").alias("family"), F.col("m.probability").alias("probability"), (-F.col("m.t")).alias("template"), F.col("m.share").alias("share"))
    key, p_id, p_key, p_found = own_names(docs, "key", "p_doc_id", "p_key", "p_found")
    per = sure.groupBy(F.col("doc_id").alias(p_id), F.col("text_key").alias(p_key)).agg(F.array_sort(F.collect_list(row)).alias(p_found))
    out = docs.withColumn(key, F.xxhash64("text")).join(per, F.col("doc_id").eqNullSafe(F.col(p_id)) & (F.col(key) == F.col(p_key)), "left")
    none = F.array().cast(per.schema[p_found].dataType)
    return out.select(*map(quoted, without(docs, "licences")), F.coalesce(p_found, none).alias("licences"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, fit(docs))
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"])))
    lines = F.transform("licences", lambda x: x["line_no"].cast("string"))
    return out.select("doc_id", F.size("licences").cast("bigint").alias("n_licences"), F.array_join(families, ",").alias("families"), F.array_join(lines, ",").alias("lines"), F.round(F.array_max(F.transform("licences", lambda x: x["probability"])), 6).alias("probability"))
