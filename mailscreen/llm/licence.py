"""Licence scans: a trained paragraph classifier with template confirmation.

Paragraphs are the lines of a text.  A paragraph is a sparse vector of word 1- to 3-grams
(presence), classified by multinomial logistic regression into licence families and
`none`.  Training texts are the licence notices below, whole and with words left out or put
in, and as `none` up to `max_negatives` paragraphs of the corpus that hold no word
"licence" or "rights" (picked by the smallest hash of the paragraph).

* Unknown class: a third of the training texts is held out; the smallest probability that
  lets no held-out `none` paragraph through (and at least `min_probability`) is the
  threshold.  Below it a paragraph is `none`.
* Confirmation: the share of a template's distinctive word pairs that the paragraph has, for
  the family's closest template, must reach `min_overlap`; otherwise the family is
  reported as `unknown`.

All paragraphs of all texts are scored, one pass, no shuffle.  The model is of the size of
the notices' and the bounded sample's vocabulary.

Edge cases: null and empty texts have no findings; repeated paragraphs are each found;
other columns are ignored; an empty table gives an empty result (and a model without
negatives is trained on `none` texts made of the notices' words in disorder).
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NONE, UNKNOWN = "none", "unknown"

# Customary notices of licence families.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU General Public License version 2 or later.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause license.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "Dedicated to the public domain under CC0."],
    "Proprietary": ["All rights reserved.", "No part of this publication may be reproduced without the prior permission of the publisher. All rights reserved."],
}
_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
_MENTIONS = r"(?i)licen[sc]|rights|copyright|public domain"


@dataclass(frozen=True)
class LicenceSettings:
    max_negatives: int = 4_000
    variants: int = 40
    min_probability: float = 0.5
    min_overlap: float = 0.6
    regularisation: float = 0.001
    seed: int = 11


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def ngrams(words: list[str]) -> set[str]:
    """1- to 3-grams."""
    grams = set(words)
    grams.update(map(" ".join, zip(words, words[1:])))
    grams.update(map(" ".join, zip(words, words[1:], words[2:])))
    return grams


def _variants(settings: LicenceSettings, filler: list[str]) -> list[tuple[str, str]]:
    """(family, paragraph): each template whole, and with words left out or put in."""
    rng, made = random.Random(settings.seed), []
    for family, templates in TEMPLATES.items():
        for template in templates:
            made.append((family, template))
            for _ in range(settings.variants):
                words = [w for w in template.split() if rng.random() > 0.08]
                around = [rng.choice(filler) for _ in range(rng.choice((0, 0, 0, 2, 6, 15)))] if filler else []
                cut = rng.randint(0, len(around))
                made.append((family, " ".join(around[:cut] + words + around[cut:])))
    return made


@dataclass(frozen=True)
class LicenceModel:
    families: list[str]
    weights: dict[str, np.ndarray]  # of an n-gram, per family
    intercept: np.ndarray
    threshold: float
    min_overlap: float

    def probabilities(self, words: list[str]) -> np.ndarray:
        margin = self.intercept.copy()
        for g in ngrams(words):
            if (w := self.weights.get(g)) is not None:
                margin += w
        odds = np.exp(margin - margin.max())
        return odds / odds.sum()

    def classify(self, paragraph: str) -> tuple[str, str, float, float] | None:
        """(family, predicted family, probability, overlap); None where no licence is found."""
        words = words_of(paragraph)
        if not any(w in self.weights for w in words):
            return None
        p = self.probabilities(words)
        best = int(p.argmax())
        if self.families[best] == NONE or p[best] < self.threshold:
            return None
        overlap = template_overlap(self.families[best], words)
        return (self.families[best] if overlap >= self.min_overlap else UNKNOWN), self.families[best], float(p[best]), overlap


def template_overlap(family: str, words: list[str]) -> float:
    """Largest share of a template's word pairs that occur among the words, in order and adjacent."""
    pairs = set(zip(words, words[1:]))
    shares = []
    for template in TEMPLATES[family]:
        own = words_of(template)
        wanted = set(zip(own, own[1:]))
        shares.append(len(wanted & pairs) / len(wanted))
    return max(shares)


def train_licences(docs: DataFrame, settings: LicenceSettings = LicenceSettings(), text: str = "text") -> LicenceModel:
    spark = docs.sparkSession
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("p")).where((F.trim("p") != "") & ~F.col("p").rlike(_MENTIONS))
    # The negatives with the smallest hashes; long lines are cut to the length of a notice.
    sample = lines.select(F.slice(F.split(F.trim("p"), r"\s+"), 1, 60).alias("w")).withColumn("h", F.xxhash64("w")).orderBy("h", F.col("w")).limit(settings.max_negatives)
    negatives = [" ".join(r["w"]) for r in sample.collect()]
    rng = random.Random(settings.seed)
    filler = sorted({w for n in negatives for w in n.split()})
    loose = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
    rows = _variants(settings, filler) + [(NONE, n) for n in negatives]
    rows += [(NONE, " ".join(rng.choice(loose) for _ in range(rng.randint(1, 12)))) for _ in range(200)]
    return _fit(spark, rows, settings, rng)


def _fit(spark: SparkSession, rows: list[tuple[str, str]], settings: LicenceSettings, rng: random.Random) -> LicenceModel:
    families = [NONE, *TEMPLATES]
    rng.shuffle(rows)
    held = rows[::3]
    fitted = [(float(families.index(f)), sorted(ngrams(words_of(p)))) for i, (f, p) in enumerate(rows) if i % 3]
    table = spark.createDataFrame(fitted, "label double, grams array<string>").repartition(2)
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0, vocabSize=1 << 18).fit(table)
    model = LogisticRegression(family="multinomial", regParam=settings.regularisation, maxIter=100).fit(counter.transform(table))
    matrix = model.coefficientMatrix.toArray()
    present = np.abs(matrix).max(axis=0) > 1e-4
    weights = {g: matrix[:, i].copy() for i, g in enumerate(counter.vocabulary) if present[i]}
    classes = families[: matrix.shape[0]]
    draft = LicenceModel(classes, weights, np.array(model.interceptVector.toArray()), 0.0, settings.min_overlap)
    # The highest probability of a licence that a held-out `none` paragraph gets is not enough.
    wrong = [float(p.max()) for f, text in held if f == NONE and (p := draft.probabilities(words_of(text))).argmax() != 0]
    threshold = min(0.95, max([settings.min_probability, *wrong]))
    return LicenceModel(classes, weights, draft.intercept, threshold, settings.min_overlap)


def scan_licences(docs: DataFrame, model: LicenceModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, start, end, family, predicted, probability, overlap): one row per notice.

    `line` counts from 0; start and end are the notice's code points in the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "line int, start long, end long, family string, predicted string, probability double, overlap double"

    @F.pandas_udf(f"array<struct<{schema.replace(' ', ':').replace(',:', ', ')}>>")
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([_findings(shared.value, t) for t in texts])

    found = docs.select(F.col(doc_id).alias("doc_id"), scan(F.col(text)).alias("f"))
    return found.select("doc_id", F.inline("f"))


def _findings(model: LicenceModel, text: str | None) -> list[dict]:
    found, at = [], 0
    for number, line in enumerate((text or "").split("\n")):
        if (c := model.classify(line)) is not None:
            found.append({"line": number, "start": at, "end": at + len(line), "family": c[0], "predicted": c[1], "probability": c[2], "overlap": c[3]})
        at += len(line) + 1
    return found
