"""Licence scan of paragraphs by a trained n-gram classifier, in DataFrame operations.

A paragraph is a line with a letter or digit, or a block of several such lines between blank lines; every one is scored. A
multinomial logistic regression over binary word 1- and 2-grams tells licence families from an `unknown` class. It is
fitted on the driver on a bounded, generated sample: VERSIONS cut, thinned and framed versions of each family's wording
below, and NEGATIVES word mixtures and near misses. Its temperature and the probability that a family needs are calibrated
on held-out versions. A prediction counts only if the paragraph also shares RESEMBLES of its 2-grams, or of the template's
where that has fewer, with one of the family's templates.

The model is sparse: a gram is the 64-bit hash of its words, looked up by its low bits in a small table that holds the
whole hash, so a gram out of the vocabulary adds nothing. Words of no known gram are blanked first, once a line, and
grams are made of the runs of words that are left; a block's runs are those of its lines, joined. The classes of a paragraph
are summed only if its bound, the sum of each known gram's largest gain of a family over `unknown`, allows the probability
that a family needs; no other paragraph can have a candidate. Tables and templates are fixed-size constants in the plan: no
join, no shuffle.

Defined cases: null or empty texts have no paragraph and no licence; rows are judged one by one, repeated ones each; equal
probabilities take the earlier paragraph, lines before blocks; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Public licence wording by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This software is licensed under the MIT License. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one under the Mozilla Public License",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc_by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc_by_sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc_by_nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "public_domain": ("This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work, released under CC0 into the public domain."),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "You should have received a copy of the GNU Affero General Public License along with this program",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    "all_rights_reserved": ("All rights reserved.", "Copyright (c) the authors. All rights reserved.", "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher"),
}
#: Names of licences by family, put into each of FRAMES.
NAMES: dict[str, tuple[str, ...]] = {
    "mit": ("MIT License", "MIT license", "Expat License"),
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License", "GNU GPL v3", "GPL-3.0", "GPL v2"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "GNU LGPL v3", "LGPL-2.1"),
    "agpl": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"),
    "bsd": ("BSD License", "3-Clause BSD License", "BSD-2-Clause License", "BSD-3-Clause", "New BSD License"),
    "mpl": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"),
    "isc": ("ISC License", "ISC license terms"),
    "zlib": ("zlib License", "zlib/libpng License"),
    "cc_by": ("CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International"),
    "cc_by_sa": ("CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc_by_nc": ("CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "public_domain": ("CC0 1.0", "CC0 1.0 Universal Public Domain Dedication", "the public domain"),
}
FRAMES = ("Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "SPDX-License-Identifier: {}", "License: {}", "{}")
#: Near misses: other names for the frames, and sentences that grant nothing.
OTHERS = ("Eclipse Public License 2.0", "Acme Commercial License", "Oracle Technology Network License", "Artistic License 2.0", "Microsoft Public License", "European Union Public Licence", "terms of your contract", "new rules 3.0", "old agreement", "Sun Industry Standards Source License")
SENTENCES = (
    "The license of the house is old and nobody knows who wrote it.",
    "He lost his driving licence for a year after the accident.",
    "Public access to the general store is free for any later version of the plan.",
    "The software is used by the foundation to publish its work under conditions.",
    "Students of MIT and Berkeley met in the public library.",
    "The Apache helicopter landed near Mozilla street.",
    "A copy of the terms may be obtained at the office without charge.",
    "She reserved all seats; the rights of the others were not discussed.",
    "Poetic licence allows any use of words for any purpose.",
    "The institute MIT is in Cambridge, near the river.",
    "Creative people share their work with the commons of the village.",
)
#: The sample's bounds: versions a family, negatives.
VERSIONS, NEGATIVES, SEED = 200, 2800, 11
#: Share of known negatives that may pass, and the least share of 2-grams in common with a template.
FALSE_RATE, RESEMBLES = 0.002, 0.6
#: Slots of the hashes of grams, one gram each, and buckets of the table in the plan, which every task reads anew.
SLOTS, BUCKETS = 1 << 16, 1 << 10
_NOISE = "a about after all also an and any are as at be been but by can for from had has have he her his if in into is it its more new no not of on one or our out page read see she so some such text than that the their them there these they this time to under up use was we were what when which who will with work would you your version terms software file copy law".split()


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))


def paragraphs_of(text: str) -> list[str]:
    """Lines with a letter or digit, then blocks of several of them."""
    lines = [p for p in text.lower().split("\n") if re.search("[a-z0-9]", p)]
    return lines + [b for b in re.split(r"\n[ \t\r]*\n", text.lower()) if re.search(r"[a-z0-9][^\n]*\n(?:.*\n)*?.*[a-z0-9]", b)]


def gram_hash(gram: str) -> int:
    """Spark's xxhash64 of a word, or of the hashes of two, as a signed number."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    each = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in gram.split(" ")]
    if len(each) == 1:
        return each[0]
    h = 42
    for e in each:
        h = xxhash.xxh64_intdigest(e.to_bytes(8, "little", signed=True), h)
    return signed(h)


def templates_of(family: str) -> list[str]:
    return [*TEMPLATES[family], *(f.format(n) for n in NAMES.get(family, ()) for f in FRAMES)]


@dataclass
class Classifier:
    classes: list[str]
    bias: list[float]
    weights: dict[str, list[float]]
    temperature: float
    least: float
    confusion: np.ndarray

    def gains(self) -> tuple[float, dict[str, float], float]:
        """Bias and grams: the largest gain of a family's score over `unknown`; and the sum that a candidate needs."""
        gain = lambda w: max(w[:-1]) - w[-1]
        need = self.temperature * float(np.log(self.least / (1 - self.least))) if self.least < 1 else np.inf
        return gain(self.bias), {g: gain(w) for g, w in self.weights.items()}, need - 1e-6

    def probabilities(self, text: str) -> np.ndarray:
        s = np.array(self.bias)
        for g in grams_of(words_of(text)):
            if g in self.weights:
                s = s + np.array(self.weights[g])
        e = np.exp((s - s.max()) / self.temperature)
        return e / e.sum()

    def judge(self, text: str, resembles: float = RESEMBLES) -> list[tuple[int, str, float, float, bool]]:
        """The candidates of a text, as scan() has them."""
        out = []
        for i, p in enumerate(paragraphs_of(text)):
            q = self.probabilities(p)
            family = self.classes[int(q.argmax())]
            if family != UNKNOWN and q.max() >= self.least:
                pairs = {g for g in grams_of(words_of(p)) if " " in g}
                like = max(len(pairs & t) / max(min(len(t), len(pairs)), 1) for t in ({g for g in grams_of(words_of(x)) if " " in g} for x in templates_of(family)))
                out.append((i, family, float(q.max()), like, like >= resembles))
        return out


def _sample() -> list[tuple[list[str], int]]:
    rng = np.random.RandomState(SEED)
    out: list[tuple[list[str], int]] = []
    noise = lambda n: [_NOISE[i] for i in rng.randint(0, len(_NOISE), n)]
    thin = lambda w, rate: [x for x in w if rng.uniform() > rate]
    framed = lambda n: (words_of(f) for f in FRAMES[rng.randint(len(FRAMES))].split("{}")) if n else ([], [])
    every = [words_of(t) for ts in TEMPLATES.values() for t in ts]
    for c, (family, ts) in enumerate(TEMPLATES.items()):
        names = NAMES.get(family, ())
        for v in range(VERSIONS):
            if names and v % 2:
                before, after = framed(True)  # the name stays whole
                part = thin(before, 0.15) + words_of(names[rng.randint(len(names))]) + thin(after, 0.15)
            else:
                w = words_of(ts[rng.randint(len(ts))])
                size = max(min(len(w), 3), int(len(w) * rng.uniform(0.6, 1)))
                at = rng.randint(0, len(w) - size + 1)
                part = thin(w[at : at + size], 0.05) if len(w) > 12 else w
            out.append((noise(rng.randint(0, 6)) + part + noise(rng.randint(0, 6)), c))
    for v in range(NEGATIVES):
        if v % 4 < 2:
            before, after = framed(True)
            name = words_of(OTHERS[rng.randint(len(OTHERS))]) if v % 8 else noise(2)
            w = noise(rng.randint(0, 6)) + thin(before, 0.15) + name + thin(after, 0.15) + noise(rng.randint(0, 6))
        elif v % 4 == 2:
            w = noise(rng.randint(0, 8)) + thin(words_of(SENTENCES[rng.randint(len(SENTENCES))]), 0.1) + noise(rng.randint(0, 8))
        else:
            w = noise(rng.randint(1, 60))
            for _ in range(rng.randint(0, 5)):  # a few words of licences prove nothing
                src = every[rng.randint(len(every))]
                w.insert(rng.randint(len(w)), src[rng.randint(len(src))])
        out.append((w, len(TEMPLATES)))
    return [out[i] for i in rng.permutation(len(out))]


@cache
def train(steps: int = 150, rate: float = 0.8, decay: float = 1e-4) -> Classifier:
    rows = _sample()
    cut = len(rows) * 4 // 5
    counts: dict[str, int] = {}
    for w, _ in rows[:cut]:
        for g in grams_of(w):
            counts[g] = counts.get(g, 0) + 1
    # One gram a slot, the more frequent.
    slots: dict[int, str] = {}
    for g in sorted(counts, key=lambda g: (-counts[g], g)):
        if counts[g] >= 12:
            slots.setdefault(gram_hash(g) % SLOTS, g)
    vocab = {g: i for i, g in enumerate(sorted(slots.values()))}
    n_classes = len(TEMPLATES) + 1

    def matrix(part) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(part), len(vocab)), np.float32)
        for i, (w, _) in enumerate(part):
            x[i, [vocab[g] for g in grams_of(w) if g in vocab]] = 1
        return x, np.array([c for _, c in part])

    x, y = matrix(rows[:cut])
    w, b = np.zeros((len(vocab), n_classes), np.float32), np.zeros(n_classes, np.float32)
    mw, onehot = np.zeros_like(w), np.eye(n_classes, dtype=np.float32)[y]
    for _ in range(steps):
        s = x @ w + b
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - onehot) / len(x)
        mw = 0.9 * mw + x.T @ g + decay * w
        w -= rate * mw
        b -= rate * g.sum(0)
    hx, hy = matrix(rows[cut:])
    s = hx @ w + b

    def at(t: float) -> np.ndarray:
        e = np.exp((s - s.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    temperature = min((0.3, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -np.log(np.maximum(at(t)[np.arange(len(hy)), hy], 1e-12)).mean())
    q = at(temperature)
    least = max(0.5, float(np.quantile(q[hy == n_classes - 1, :-1].max(1), 1 - FALSE_RATE)))
    told = np.where(q.max(1) >= least, q.argmax(1), n_classes - 1)
    confusion = np.zeros((n_classes, n_classes), int)
    np.add.at(confusion, (hy, told), 1)
    return Classifier([*TEMPLATES, UNKNOWN], [round(float(v), 5) for v in b], {g: [round(float(v), 5) for v in w[i]] for g, i in vocab.items()}, temperature, least, confusion)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", resembles: float = RESEMBLES) -> DataFrame:
    """doc_id, n_paragraphs, candidates (array of struct: paragraph no., family, probability, similarity, confirmed)."""
    m = train()
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    # Grams by the low bits of their hash; a gram's number is its bucket's first and its place in it.
    buckets: list[list[str]] = [[] for _ in range(BUCKETS)]
    for g in m.weights:
        buckets[gram_hash(g) % BUCKETS].append(g)
    grams = [g for b in buckets for g in b]
    base, gains, need = m.gains()
    keys, begin = constant([[gram_hash(g) for g in b] for b in buckets], "array<array<bigint>>"), constant(np.cumsum([0, *map(len, buckets[:-1])]).tolist(), "array<int>")
    weights, gain = constant([m.weights[g] for g in grams], "array<array<double>>"), constant([gains[g] for g in grams], "array<double>")
    bias, names = F.array(*[F.lit(v) for v in m.bias]), F.array(*[F.lit(c) for c in m.classes])
    bucket = lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    none = F.array().cast("array<bigint>")
    used = sorted({w for g in m.weights for w in g.split(" ")})

    def pairs(u: Column) -> Column:
        return F.when(F.size(u) > 1, F.transform(F.sequence(F.lit(1), F.size(u) - 1), lambda i: F.xxhash64(F.get(u, i - 1), F.get(u, i)))).otherwise(none)

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    # Blocks of lines of words; a line without a word is none.
    line = lambda p: F.array_remove(F.split(p, "[^a-z0-9]+"), "")
    block = lambda b: F.filter(F.transform(F.split(b, "\n"), line), lambda u: F.size(u) > 0)
    df = df.select("doc_id", F.transform(F.split("_t", "\n[ \\t\\r]*\n"), block).alias("_l"))
    # The same with a word of no known gram blank, so that words with one space between are neighbours.
    blanked = lambda u: F.array_join(F.transform(u, lambda w: F.when(w.isin(used), w).otherwise("")), " ")
    df = df.withColumn("_m", F.transform("_l", lambda b: F.transform(b, blanked)))
    df = df.withColumn("_m", F.concat(F.flatten("_m"), F.transform(F.filter("_m", lambda b: F.size(b) > 1), lambda b: F.array_join(b, " "))))
    df = df.withColumn("_n", F.size("_m"))
    runs = lambda t: F.transform(F.filter(F.split(t, "  +"), lambda r: r != ""), lambda r: F.transform(F.split(F.trim(r), " "), lambda w: F.xxhash64(w)))
    df = df.withColumn("_r", F.transform("_m", runs))
    known = lambda a: F.filter(a, lambda h: F.array_position(F.get(keys, bucket(h)), h) > 0)
    number = lambda h: (F.get(begin, bucket(h)) + F.array_position(F.get(keys, bucket(h)), h) - 1).cast("int")
    found = lambda r: F.transform(F.array_distinct(known(F.concat(F.flatten(r), F.flatten(F.transform(r, pairs))))), number)
    df = df.withColumn("_h", F.transform("_r", lambda r, i: F.struct(i.alias("i"), found(r).alias("h"))))
    bound = lambda h: F.aggregate(h, F.lit(base), lambda a, x: a + F.get(gain, x))
    df = df.withColumn("_h", F.filter("_h", lambda x: bound(x["h"]) >= need))
    score = lambda h: F.aggregate(h, bias, lambda a, x: F.zip_with(a, F.get(weights, x), lambda p, q: p + q))
    df = df.withColumn("_s", F.transform("_h", lambda x: F.struct(x["i"].alias("i"), score(x["h"]).alias("s"))))
    best = lambda s, i: F.struct(i.alias("i"), F.element_at(names, F.array_position(s, F.array_max(s)).cast("int")).alias("f"), (F.lit(1.0) / F.aggregate(s, F.lit(0.0), lambda a, v: a + F.exp((v - F.array_max(s)) / m.temperature))).alias("p"))
    df = df.withColumn("_c", F.filter(F.transform("_s", lambda x: best(x["s"], x["i"])), lambda x: (x["f"] != UNKNOWN) & (x["p"] >= m.least)))
    templates = constant([{"f": f, "g": [gram_hash(g) for g in grams_of(words_of(t)) if " " in g]} for f in TEMPLATES for t in templates_of(f)], "array<struct<f:string,g:array<bigint>>>")

    every = F.concat(F.flatten("_l"), F.transform(F.filter("_l", lambda b: F.size(b) > 1), lambda b: F.flatten(b)))

    # In steps, each value once a candidate: its words, its 2-grams, then its similarity.
    step = lambda name, value: F.transform("_c", lambda x: F.struct(x["i"].alias("i"), x["f"].alias("f"), x["p"].alias("p"), value(x).alias(name)))
    df = df.withColumn("_c", step("u", lambda x: F.transform(F.get(every, x["i"]), lambda w: F.xxhash64(w))))
    df = df.withColumn("_c", step("g", lambda x: F.array_distinct(pairs(x["u"]))))

    def like(x: Column) -> Column:
        share = lambda t: F.size(F.array_intersect(t["g"], x["g"])) / F.greatest(F.least(F.size(t["g"]), F.size(x["g"])), F.lit(1))
        return F.coalesce(F.array_max(F.transform(F.filter(templates, lambda t: t["f"] == x["f"]), share)), F.lit(0.0))

    df = df.withColumn("_c", step("s", like))
    rated = F.transform("_c", lambda x: F.struct(x["i"].alias("paragraph"), x["f"].alias("family"), F.round(x["p"], 6).alias("probability"), F.round(x["s"], 6).alias("similarity"), (x["s"] >= resembles).alias("confirmed")))
    return df.select("doc_id", F.col("_n").cast("long").alias("n_paragraphs"), rated.alias("candidates"))


def verdicts(scanned: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_candidates, n_licenses, license (best confirmed family), probability, similarity."""
    yes = F.filter("candidates", lambda c: c["confirmed"])
    best = "aggregate(_y, cast(null as struct<paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>), (a, x) -> if(a is null or x.probability > a.probability, x, a))"
    df = scanned.withColumn("_y", yes).withColumn("_x", F.expr(best))
    return df.select("doc_id", "n_paragraphs", F.size("candidates").cast("long").alias("n_candidates"), F.size("_y").cast("long").alias("n_licenses"), F.col("_x.family").alias("license"), F.col("_x.probability").alias("probability"), F.col("_x.similarity").alias("similarity"))
