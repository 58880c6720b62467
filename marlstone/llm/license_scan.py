"""Licence scans by a trained paragraph classifier; the scan itself is DataFrame operations only.

Multinomial logistic regression over the presence of word unigrams and bigrams, with an L1 penalty that leaves few weights, tells licence families, licence wording of no known family (``unknown``) and no licence
(``none``) apart. It is trained on the driver from the notices below, with words dropped and surrounded by others at random (seeded), and from a bounded sample of the corpus's own paragraphs, whose n-grams are features as well. A
sampled paragraph that speaks of licences is an example of ``none`` only where it has little of every notice; where it has more nobody knows, and it is left out. The temperature that calibrates the
probabilities is fitted on notices that the model has not been trained on (``FOLDS`` parts, each left out once); a licence whose family has less than ``SURE`` is ``unknown``. A family stands only if the paragraph covers ``COVERED`` of the words of
one of its templates (``confirmed``), words that few families use weighing more; else it is ``unknown`` too.

Weights say which words no licence can do without: a paragraph with none of these *anchors* cannot outweigh ``none`` even with every other weighted word, so that a scan for
anchors leaves out no paragraph that the model would report. What remains is joined with the weights, a few hundred rows, and aggregated by paragraph.

Paragraphs are lines; a line of ``WRAPPED`` characters goes on in the next one if that is not blank, so that hard-wrapped notices are one paragraph. Null and empty texts have none. Documents are known by (doc_id, hash of the text), and equal rows are reported once. An
empty table gives no rows; columns other than doc_id and text are ignored. A very long text is split in linear time; of a sampled long paragraph a stretch of ``STRETCH`` words at a place given by its hash is learnt from.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import least_hashed, prepare, text_of

#: Documents and paragraphs sampled, and words of one.
SAMPLE, PARAGRAPHS, STRETCH = 1500, 1500, 60
#: Variants of each notice, parts for calibration, n-grams of the corpus that are features, and paragraphs that must have one.
VARIANTS, FOLDS, CORPUS_GRAMS, OFTEN = 16, 4, 800, 4
#: Examples of paragraphs without any n-gram that the model knows.
BLANK = 400
SURE, COVERED, LITTLE = 0.6, 0.6, 0.3
WRAPPED = "{30,120}"

#: Notices of each family, short ones and the sentences by which long ones are known.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license",
        "This project is available under the terms of the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Released under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License",
        "This software is distributed under the terms of the Apache License, Version 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL version 2 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "Licensed under the GPL v3",
        "licensed under the GNU General Public License, version 2 or any later version",
    ),
    "LGPL": (
        "licensed under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Released under the GNU LGPL",
    ),
    "AGPL": (
        "licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Released under the GNU AGPL",
    ),
    "BSD": (
        "Released under the BSD License",
        "Licensed under the 3-Clause BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "governed by a BSD-style license that can be found in the LICENSE file",
    ),
    "CC-BY": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0", "available under the Creative Commons Attribution license"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 License", "SPDX-License-Identifier: CC-BY-SA-4.0", "available under the Creative Commons Attribution-ShareAlike license"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License", "SPDX-License-Identifier: CC-BY-NC-4.0", "available under the Creative Commons Attribution-NonCommercial license"),
    "MPL-2.0": ("subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0", "Released under the MPL 2.0"),
    "public-domain": ("This is free and unencumbered software released into the public domain", "Dedicated to the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0", "The author has placed this work in the public domain"),
}
#: Licence wording of no known family, and plain sentences with such words.
UNKNOWN = (
    "Licensed under the terms below", "Licensed under the Acme Public License, version 1", "Released under the Acme License.", "This work is licensed under the Acme License 7", "This software is provided under a custom license",
    "Use is subject to the license agreement", "All rights reserved. No part may be copied without permission", "Released under its own licence", "Copyright notice and licence terms apply",
    "Licensed under the Foo Software License, Version 3.1", "SPDX-License-Identifier: LicenseRef-Acme", "You may use this file only under the terms of the license agreement with its owner",
)
PLAIN = (
    "The driver lost his license after the race", "They apply the version of the work in public", "The general released the terms to the public", "a copy of the version under the free work", "This work is for any person and may be free of charge",
    "The shop has a license to sell wine until ten in the evening", "She asked for permission to copy the letter and it was granted", "The court spoke about copyright in public for the first time", "A fishing licence is needed on this part of the river",
    "The software was distributed to schools and modified by the students", "He was a student at MIT before he wrote the book", "The commons are open to the public and free of charge", "The house is in the public part of the domain of the king",
    "Their dog had no license and the city sent a notice", "The foundation published a free copy of the report", "Apache helicopters were seen above the Mozilla office", "The notice above the door said that the permission was required by law",
)
#: Words of paragraphs that speak of licences.
WORDING = frozenset({"license", "licence", "licensed", "licenses", "copyright", "spdx", "gpl", "permission"})


def tokens_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams_of(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}  # noqa: B905


@dataclass(frozen=True)
class Model:
    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    anchors: list[str]
    #: Expected calibration error on notices that were left out of training, and the share of their variants that got the right class.
    calibration_error: float = 0.0
    unseen_accuracy: float = 0.0


def template_words() -> tuple[list[tuple[str, list[dict[str, float]]]], dict[str, float]]:
    """For each family the weighted words of its templates; words that few families use weigh more."""
    families = {f: {w for t in ts for w in tokens_of(t)} for f, ts in TEMPLATES.items()}
    weight = {w: math.log(1 + len(families) / sum(w in ws for ws in families.values())) for ws in families.values() for w in ws}
    return [(f, [{w: weight[w] for w in sorted(set(tokens_of(t)))} for t in ts]) for f, ts in TEMPLATES.items()], weight


def covered(words: set[str], templates: list[dict[str, float]]) -> float:
    return max(sum(v for w, v in t.items() if w in words) / sum(t.values()) for t in templates)


def _fit(x: np.ndarray, y: np.ndarray, classes: int, penalty: float = 6e-4, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient for softmax regression with an L1 penalty."""
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    z, zb, t = w, b, 1.0
    target = np.eye(classes, dtype=np.float32)[y]
    rate = 4.0 / max(1.0, float((x.sum(axis=1)).mean()))
    for _ in range(rounds):
        p = x @ z + zb
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) / len(y)
        new = z - rate * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = zb - rate * g.sum(axis=0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return min(np.geomspace(0.2, 5, 60), key=loss)


def _anchors(vocabulary: list[str], w: np.ndarray, b: np.ndarray, none: int, temperature: float, common: Counter) -> list[str]:
    """Words without any of which all classes together cannot outweigh ``none``. Words are added by the weight they take from what other features could do at most, for their frequency in the corpus's
    own paragraphs, until that falls short."""
    over = np.maximum(np.delete(w, none, axis=1) - w[:, [none]], 0)
    lead = np.delete(b, none) - b[none] + temperature * math.log(len(b))
    left = {g: over[i] for i, g in enumerate(vocabulary)}
    out: list[str] = []
    while left and (reach := lead + sum(left.values())).max() >= 0:
        short = np.maximum(reach, 0)
        gain: dict[str, float] = {}
        for g, v in left.items():
            for word in g.split():
                gain[word] = gain.get(word, 0.0) + float(np.minimum(v, short).sum())
        word = max(gain, key=lambda k: (gain[k] / (1 + common[k]), k))
        out.append(word)
        left = {g: v for g, v in left.items() if word not in g.split()}
    return sorted(out)


def calibration_error(p: np.ndarray, y: np.ndarray, bins: int = 10) -> float:
    """Mean gap between the probability of the likeliest class and how often it is right, over equal ranges of that probability."""
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    at = np.minimum((top * bins).astype(int), bins - 1)
    return float(sum(abs(top[at == k].mean() - right[at == k].mean()) * (at == k).mean() for k in range(bins) if (at == k).any()))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(paragraphs: list[list[str]], seed: int = 11) -> Model:
    """``paragraphs``: words of some of the corpus's."""
    pick = random.Random(seed)
    templates, _ = template_words()

    def plain_one(words: list[str]) -> bool:
        return not WORDING & set(words) or all(covered(set(words), t) < LITTLE for _, t in templates)

    plain = [p for p in paragraphs if p and plain_one(p)]
    classes = [*TEMPLATES, "unknown", "none"]
    # (n-grams, class, notice): variants of one notice stay on one side of a fold
    rows: list[tuple[set[str], int, int]] = [(grams_of(p), len(classes) - 1, -1 - i) for i, p in enumerate(plain)]
    # what has no n-gram that the model knows is none
    rows += [(set(), len(classes) - 1, -1 - i) for i in range(BLANK)]
    notice = 0
    for c, texts in enumerate([*TEMPLATES.values(), UNKNOWN, PLAIN]):
        for text in texts:
            words = tokens_of(text)
            for v in range(VARIANTS):
                kept = [w for w in words if not v or pick.random() > 0.12]
                before, after = (pick.choice(plain)[: pick.randrange(12)] if plain and v % 2 else [] for _ in range(2))
                rows.append((grams_of(before + kept + after), c, notice))
            notice += 1
    seen = Counter(g for p in plain for g in grams_of(p))
    often = [g for g, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:CORPUS_GRAMS] if n >= OFTEN]
    known = sorted({g for ts in (*TEMPLATES.values(), UNKNOWN, PLAIN) for s in ts for g in grams_of(tokens_of(s))} | set(often))
    at = {g: i for i, g in enumerate(known)}
    x = np.zeros((len(rows), len(known)), np.float32)
    for i, (grams, _, _) in enumerate(rows):
        x[i, [at[g] for g in grams if g in at]] = 1
    y = np.array([c for _, c, _ in rows])
    order = list(range(notice))
    pick.shuffle(order)
    fold = np.array([(order[n] if n >= 0 else -n) % FOLDS for _, _, n in rows])
    unseen = np.zeros((len(rows), len(classes)))
    for f in range(FOLDS):
        w, b = _fit(x[fold != f], y[fold != f], len(classes))
        unseen[fold == f] = x[fold == f] @ w + b
    of_notice = np.array([n >= 0 for _, _, n in rows])
    temperature = _temperature(unseen[of_notice], y[of_notice])
    p = _softmax(unseen[of_notice] / temperature)
    w, b = _fit(x, y, len(classes))
    used = np.flatnonzero(np.abs(w).sum(axis=1))
    vocabulary = [known[i] for i in used]
    common = Counter(t for p in plain for t in set(p))
    return Model(
        classes, {g: w[i].tolist() for g, i in zip(vocabulary, used, strict=True)}, b.tolist(), float(temperature), _anchors(vocabulary, w[used].astype(float), b.astype(float), len(classes) - 1, temperature, common),
        calibration_error(p, y[of_notice]), float((p.argmax(axis=1) == y[of_notice]).mean()),
    )


def paragraphs_of(text: Column) -> Column:
    """Lines, hard-wrapped ones joined with those after them."""
    return F.split(F.regexp_replace(text, rf"(?<![^\n])([^\n]{WRAPPED})\n(?=[^\s])", "$1 "), "\n")


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), "[^a-z0-9]+"), "")


def fit(docs: DataFrame, sample: int = SAMPLE, paragraphs: int = PARAGRAPHS) -> Model:
    """Train with ``paragraphs`` paragraphs, those with the least hashes in whole texts of about ``4 * sample`` documents (all, where there are few)."""
    prepare(docs.sparkSession)
    steps, total = 1 << 30, docs.count()
    place = F.pmod(F.xxhash64("doc_id", text_of()), F.lit(steps))
    few = docs.where(place < max(1, steps * 4 * sample // total)) if total > 16 * sample else docs
    lines = few.select("doc_id", F.posexplode(paragraphs_of(text_of())).alias("paragraph", "line")).withColumn("words", _words(F.col("line"))).where(F.size("words") > 0)
    turn = F.xxhash64("doc_id", "paragraph", "line")
    begin = F.pmod(turn, F.greatest(F.size("words") - (STRETCH - 1), F.lit(1))).cast("int")
    stretches = lines.select(turn.alias("turn"), F.slice("words", begin + 1, STRETCH).alias("words"))
    some = least_hashed(stretches, paragraphs, "turn", "words").collect()  # at most paragraphs * STRETCH words
    return train([list(r.words) for r in some])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_hash, paragraph, family, probability, similarity, confirmed) for each paragraph with a licence; paragraphs count from 0."""
    spark = docs.sparkSession
    prepare(spark)
    k = len(model.classes)
    repeated = not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    lines = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), F.posexplode(paragraphs_of(text_of())).alias("paragraph", "line"))
    anchored = lines.where(F.lower("line").rlike(rf"(?<![a-z0-9])(?:{'|'.join(model.anchors)})(?![a-z0-9])")) if model.anchors else lines
    worded = anchored.withColumn("words", _words(F.col("line")))
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.size("words")), lambda a, b: F.concat_ws(" ", a, b))
    grams = worded.select("doc_id", "text_hash", "paragraph", F.explode(F.array_distinct(F.concat("words", pairs))).alias("gram"))
    named, words = template_words()
    every = model.weights | {w: [0.0] * k for w in words if w not in model.weights}
    weights = spark.createDataFrame(list(every.items()), "gram string, w array<double>")
    # repeated rows count once; a paragraph's grams are summed where they are made, and no line is shuffled
    met = grams.join(F.broadcast(weights), "gram").groupBy("doc_id", "text_hash", "paragraph", "gram").agg(F.first("w").alias("w")) if repeated else grams.join(F.broadcast(weights), "gram")
    sums = met.groupBy("doc_id", "text_hash", "paragraph").agg(F.collect_set("gram").alias("words"), *(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)))
    logits = F.array(*((F.col(f"s{i}") + F.lit(model.bias[i])) / F.lit(model.temperature) for i in range(k)))
    rated = sums.select("doc_id", "text_hash", "paragraph", "words", logits.alias("z")).withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
    rated = rated.withColumn("p", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, x: a + x)))
    best = F.array_max(F.slice("p", 1, k - 2))
    family = F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("p", best).cast("int"))
    licence = F.lit(1.0) - F.element_at("p", k)
    found = rated.where(licence >= 0.5).withColumn("family", F.when(best >= SURE, family).otherwise(F.lit("unknown"))).withColumn("probability", F.when(best >= SURE, best).otherwise(licence))
    rows = [(f, [list(t.items()) for t in ts]) for f, ts in named]
    templates = spark.createDataFrame(rows, "family string, templates array<array<struct<word:string,weight:double>>>")

    def total(words: Column) -> Column:
        return F.aggregate(words, F.lit(0.0), lambda a, x: a + x["weight"])

    share = F.array_max(F.transform("templates", lambda t: total(F.filter(t, lambda x: F.array_contains(F.col("words"), x["word"]))) / total(t)))
    out = found.join(F.broadcast(templates), "family", "left").withColumn("similarity", F.coalesce(share, F.lit(0.0)))
    out = out.withColumn("confirmed", F.col("similarity") >= COVERED)
    return out.select("doc_id", "text_hash", F.col("paragraph").cast("long").alias("paragraph"), F.when(F.col("confirmed"), F.col("family")).otherwise(F.lit("unknown")).alias("family"), "probability", "similarity", "confirmed")


def op2_license(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, fit(docs)).drop("text_hash")
