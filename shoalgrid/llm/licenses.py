"""Licence scan: a paragraph classifier confirmed by template comparison.

A multinomial logistic regression over sparse word 1-3-grams tells licence
families and an unknown class apart. It is trained here: on notices made of the
names and sentences below, on notices that run to several lines, and, for the
unknown class, on sentences that mention licences or use their words. Its
temperature is calibrated on sentences held out of the fit, so that a paragraph
counts as a family only at a calibrated probability of ``LEAST`` or more. A
prediction is confirmed if the paragraph holds ``SIMILAR`` or more of the
five-word shingles of one of the family's templates: its names and its notices.

Every paragraph of every text is scored. Paragraphs end at blank lines and at
line ends that follow the end of a sentence, so that a notice wrapped over lines
is one paragraph; of more than ``WINDOW`` words, windows of so many words are
scored, ``STEP`` words apart. Scoring is native: one projection of built-in
expressions, no shuffle and no Python. An n-gram is looked up by the hash of its
first word in a table of arrays, so words that begin no feature cost one look.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, SIMILAR, SHINGLE = 0.5, 0.8, 5
#: Words of a passage, and from one passage of a long paragraph to the next.
WINDOW, STEP = 120, 80
#: Lists in the table of features.
SLOTS = 4096
_WORDS = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
_PARAGRAPH = r"\n[ \t\r]*\n|(?<=[.!?:;])[ \t\r]*\n"

#: Names of licence families, as notices write them.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache Software License, version 2.0"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "3-clause BSD license", "2-clause BSD license", "New BSD License", "BSD-3-Clause", "BSD-style license", "BSD license"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license", "CC BY 4.0", "CC BY 3.0", "CC-BY-4.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons non-commercial license", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC-4.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0"],
    "CC0": ["CC0 1.0 Universal", "CC0 1.0", "CC0-1.0", "CC0 public domain dedication"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License version 2.0", "GNU GPL v2", "GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License version 3.0", "GNU GPL v3", "GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "GNU LGPL v2.1", "GNU LGPL", "LGPLv3", "LGPL-2.1"],
    "MIT": ["MIT License", "MIT license terms", "MIT X11 license", "MIT"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"],
    "Proprietary": [],
}
#: Sentences that put a text under a licence.
GRANTS = [
    "Licensed under the {}.",
    "Released under the {}.",
    "This work is licensed under the {}.",
    "This project is distributed under the terms of the {}.",
    "Use of this source code is governed by a {} that can be found in the LICENSE file.",
    "This software is provided under the {}.",
    "The text is available under the {}.",
    "You can redistribute it and/or modify it under the terms of the {}.",
    "SPDX-License-Identifier: {}",
    "Shared under a {}.",
    "License: {}",
    "All code in this package is covered by the {}, see the file COPYING.",
    "Published under {}.",
    "The authors offer this library under the {} or any later version.",
    "Except where noted, content on this site is licensed under a {}.",
    "You may copy and use these files according to the {}.",
]
#: Sentences that mention a licence, and put nothing under it.
MENTIONS = [
    "The {} was written many years ago.",
    "A court in Germany ruled on the {} last year.",
    "Many companies avoid the {} because of its terms.",
    "She compared the {} with other licenses in her article.",
    "What does the {} say about patents?",
    "The report explains how the {} came about.",
    "Some people prefer the {}.",
    "Critics of the {} met in Paris.",
    "The {} is older than most programmers.",
    "Two lawyers argued about the {} on the radio.",
    "Everything about the {} was new to him.",
    "There was a talk on the {} after lunch.",
    "Have you ever understood the {}?",
    "We read the {} at school.",
    "In the nineties the {} became popular.",
    "It took her a week to translate the {}.",
    "The professor wrote a book about the {} and its history.",
    "Before the {} there were no such rules.",
    "They decided against the {}.",
    "No other document is quoted as often as the {} in this debate.",
]
#: Notices and parts of them, by family.
NOTICES = {
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC0": [
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
        "This document is confidential and proprietary and may not be redistributed.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Sentences that use the same words and are no notices.
OTHERS = [
    "He lost his driving license last year and had to take the test again.",
    "The terms of the agreement were published by the foundation in version 3 of the report.",
    "Students at MIT released a study on public transport.",
    "She studied physics at MIT and works there.",
    "The Apache helicopter was used in version 2.0 of the simulation.",
    "Under the new law, all rights of the tenant are reserved for the court to decide.",
    "This work was done under difficult conditions, and no permission was needed.",
    "Copyright law in Europe changed in the nineteenth century.",
    "The general public is invited to the free concert; the software version is not final.",
    "You may use the kitchen and the garden in compliance with the rules of the house.",
    "Creative people in the commons discussed attribution of the painting.",
    "A license fee is due each year for every television set.",
    "The document is available at the library, free of charge, to any person.",
    "GNU is an animal that lives in the plains.",
    "The mozilla was a mascot of an early company.",
    "Released in spring, the film was licensed to three networks.",
    "The source code was modified before it was published.",
    "The weather was fine and the children played near the river.",
    "International trade grew by 4.0 percent.",
    "The domain of the function is public knowledge, with or without proof.",
    "This project is distributed over three cities.",
    "Version 3 of the plan was licensed to a partner.",
    "Released under a license.",
    "Licensed under the following license.",
    "The license, version 2, is attached.",
    "The rights are reserved.",
    "Copyright 2020 by the author.",
    "Permission was granted by the council.",
    "The commons was open to the public.",
    "Seats are reserved for all members with voting rights.",
    "The file is confidential, the judge said.",
    "Redistribution of income was the subject of the debate.",
    "",
]
#: Words that begin no feature.
COMMON = frozenset("a all an and any as at be been by can for found has he her his how i in is it its last many may not of on or our other over says that the their there these they this to via was we were what which with you your".split())


def words(text: str) -> list[str]:
    return re.findall(_WORDS, text.lower())


def grams(w: list[str]) -> set[str]:
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i] not in COMMON}


def shingles(text: str) -> list[str]:
    w = words(text)
    return sorted({" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))})


def passages(text: str) -> list[list[str]]:
    """The words of each passage that has some, in order."""
    out = []
    for part in re.split(_PARAGRAPH, text):
        w = words(part)
        out += [w[at : at + WINDOW] for at in range(0, max(1, len(w) - WINDOW + STEP), STEP)]
    return [w for w in out if w]


def templates() -> dict[str, list[list[str]]]:
    """Shingles of the names and notices of each family. A name of one word confirms nothing by itself."""
    return {k: [shingles(t) for t in [*(n for n in NAMES[k] if len(words(n)) > 1 or re.search(r"\d", n)), *NOTICES.get(k, [])]] for k in NAMES}


def examples(grants: list[str] = GRANTS, mentions: list[str] = MENTIONS) -> list[tuple[str, str, int]]:
    """(text, family or unknown, number of the sentence it is made of)."""
    made = [(g.format(n), k, i) for k, names in NAMES.items() for n in names for i, g in enumerate(grants)]
    made += [(t, k, 100 + i) for k, group in NOTICES.items() for i, t in enumerate(group) for _ in range(4)]
    made += [(m.format(n), "unknown", 200 + i) for names in NAMES.values() for n in names for i, m in enumerate(mentions)]
    return made + [(t, "unknown", 300 + i) for i, t in enumerate(OTHERS) for _ in range(4)]


@dataclass
class Model:
    families: list[str]  # the last is unknown
    names: list[str]
    weights: np.ndarray  # names x families, divided by the temperature
    bias: np.ndarray

    def probabilities(self, w: list[str]) -> dict[str, float]:
        at = self._index()
        z = self.bias + sum((self.weights[at[g]] for g in sorted(grams(w)) if g in at), np.zeros(len(self.families)))
        p = np.exp(z - z.max())
        return dict(zip(self.families, (p / p.sum()).tolist()))

    def _index(self) -> dict[str, int]:
        return {x: i for i, x in enumerate(self.names)}

    def predict(self, w: list[str]) -> tuple[str, float, bool]:
        """(family, probability, confirmed) of a passage: the definition that the native expressions follow, for tests."""
        p = self.probabilities(w)
        best = max(p, key=p.get)
        family = best if p[best] >= LEAST else "unknown"
        padded = f" {' '.join(w)} "
        held = any(sum(f" {s} " in padded for s in t) >= SIMILAR * len(t) for t in templates().get(family, []))
        return family, p[best], held


def _fit(rows: list[np.ndarray], y: np.ndarray, m: int, classes: int, rounds: int = 150, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by accelerated gradient steps; each class counts alike, the unknown one as half of all."""
    x = np.zeros((len(rows), m), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    one = np.eye(classes, dtype=np.float32)[y]
    share = np.where(y == classes - 1, 0.5, 0.5 / (classes - 1)) / one.sum(axis=0)[y]
    share = (share / share.sum())[:, None].astype(np.float32)
    w, b = np.zeros((m, classes), np.float32), np.zeros(classes, np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for k in range(rounds):
        pull = k / (k + 3)
        aw, ab = w + pull * vw, b + pull * vb
        z = x @ aw + ab
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = share * (p / p.sum(axis=1, keepdims=True) - one)
        nw, nb = aw - 0.6 * (x.T @ g + decay * aw), ab - 0.6 * g.sum(axis=0)
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w.astype(np.float64), b.astype(np.float64)


@lru_cache(maxsize=1)
def train() -> Model:
    """Fit and calibrate; takes no rows of the corpus."""
    made = examples()
    families = [*NAMES, "unknown"]
    y = np.array([families.index(k) for _, k, _ in made])
    found = [grams(words(t)) for t, _, _ in made]
    count: dict[str, int] = {}
    for g in found:
        for x in g:
            count[x] = count.get(x, 0) + 1
    names = sorted(x for x, n in count.items() if n >= 3)
    at = {g: i for i, g in enumerate(names)}
    rows = [np.array(sorted(at[x] for x in g if x in at), np.int64) for g in found]
    # sentences held out of the fit set the temperature
    held, folds = np.zeros((len(made), len(families))), np.array([s % 3 for *_, s in made])
    for fold in range(3):
        out = np.flatnonzero(folds == fold)
        w, b = _fit([rows[i] for i in np.flatnonzero(folds != fold)], y[folds != fold], len(names), len(families))
        held[out] = [w[rows[i]].sum(axis=0) + b for i in out]

    def loss(log_t: float) -> float:
        z = held / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    temperature = float(np.exp(min(np.linspace(-2, 2, 81), key=loss)))
    w, b = _fit(rows, y, len(names), len(families))
    w, b = w / temperature, b / temperature
    used = np.flatnonzero(np.abs(w - w.mean(axis=1, keepdims=True)).max(axis=1) > 0.02)
    names, w, b = [names[i] for i in used], np.round(w[used], 4), np.round(b, 4)
    if b.argmax() != len(families) - 1:
        raise ValueError("the bias must favour the unknown class")
    return Model(families, names, w, b)


def _slot(word: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(word.encode(), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % SLOTS


def found(text: Column, model: Model) -> Column:
    """array<struct<family string, probability double, confirmed boolean>> of the passages of ``text``, in order."""
    table: list[list[dict]] = [[] for _ in range(SLOTS)]
    for g, row in zip(model.names, model.weights.tolist()):
        table[_slot(g.split(" ")[0])].append({"g": g, "n": g.count(" ") + 1, "w": row})
    # constants of the plan: parsed once, however many rows there are
    features = F.from_json(F.lit(json.dumps(table)), "array<array<struct<g: string, n: int, w: array<double>>>>")
    known = F.from_json(F.lit(json.dumps([{"f": k, "t": [[f" {s} " for s in x] for x in t]} for k, t in templates().items()])), "array<struct<f: string, t: array<array<string>>>>")
    families, bias = F.array(*[F.lit(f) for f in model.families]), F.array(*[F.lit(float(x)) for x in model.bias])
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - WINDOW + STEP - 1), F.lit(STEP))
        return F.when(F.size(w) <= WINDOW, F.array(w)).otherwise(F.transform(starts, lambda s: F.slice(w, s + 1, WINDOW)))

    def score(w: Column) -> Column:
        at = lambda x, i: F.filter(F.get(features, F.pmod(F.xxhash64(x), F.lit(SLOTS)).cast("int")), lambda f: f["g"] == F.array_join(F.slice(w, i + 1, f["n"]), " "))
        z = lambda hits: F.aggregate(hits, bias, lambda a, f: F.zip_with(a, f["w"], lambda p, q: p + q))
        return let(F.array_distinct(F.flatten(F.transform(w, at))), lambda hits: let(z(hits), lambda x: decide(w, x)))

    def decide(w: Column, z: Column) -> Column:
        top = F.array_max(z)
        probability = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        best = F.get(families, F.array_position(z, top).cast("int") - 1)
        family = F.when(probability >= LEAST, best).otherwise(F.lit("unknown"))
        return let(F.struct(family.alias("family"), F.round(probability, 9).alias("probability")), lambda d: F.struct(d["family"], d["probability"], F.when(d["family"] == "unknown", False).otherwise(confirmed(w, d["family"])).alias("confirmed")))

    def confirmed(w: Column, family: Column) -> Column:
        # containment of a template's shingles: one is held if its words stand together
        padded = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
        return let(padded, lambda p: F.exists(known, lambda k: (k["f"] == family) & F.exists(k["t"], lambda t: F.size(F.filter(t, lambda s: F.contains(p, s))) >= SIMILAR * F.size(t))))

    parts = F.transform(F.split(F.lower(text), _PARAGRAPH), lambda p: F.regexp_extract_all(p, F.lit(f"({_WORDS})"), F.lit(1)))
    return F.transform(F.filter(F.flatten(F.transform(parts, cut)), lambda w: F.size(w) > 0), score)


def scan(df: DataFrame, text: str = "text", out: str = "licenses", model: Model | None = None) -> DataFrame:
    """Add ``out``: an array of (family, probability, confirmed) for each passage, in order; the family may be unknown.

    Null and empty texts, and texts without a word, have none; a column already
    named ``out`` is replaced. Rows pass through one by one, repeated rows
    included; an empty table gives no rows.
    """
    empty = F.expr("cast(array() as array<struct<family: string, probability: double, confirmed: boolean>>)")
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.select(*keep, F.coalesce(found(F.col(f"`{text}`"), model or train()), empty).alias(out))


def license_report(df: DataFrame) -> DataFrame:
    """doc_id, n_passages, n_notices (of a family), n_confirmed, n_unknown (long) and families (of confirmed notices: sorted, comma-joined) of whole texts."""
    scanned = scan(df.select("doc_id", "text")).select("doc_id", "licenses")
    known = F.filter("licenses", lambda x: x["family"] != "unknown")
    sure = F.filter("licenses", lambda x: x["confirmed"])
    return scanned.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_passages"),
        F.size(known).cast("long").alias("n_notices"),
        F.size(sure).cast("long").alias("n_confirmed"),
        (F.size("licenses") - F.size(known)).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
    )
