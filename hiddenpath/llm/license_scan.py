"""Licence scans: a trained paragraph classifier, with DataFrame functions only on the documents.

Texts are cut into paragraphs: comment marks at the starts of lines are taken off, and lines are joined until a blank
line or one that ends a sentence, so that a notice wrapped in the middle of its sentences is seen whole. A multinomial
logistic regression on sparse word n-grams, hashed to slots, names the licence family of a paragraph, with a
class ``unknown`` for other text. It is trained on paragraphs made from licence notices; its
temperature is calibrated on held-out ones. A prediction is confirmed when enough of a template of the family, in
word pairs, stands in the paragraph. Weights and templates are of bounded size and travel as literals.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
TRAINING_PARAGRAPHS, STEPS, RATE, DECAY = 5000, 120, 0.2, 1e-4
LEAST_PROBABILITY, LEAST_SIMILARITY = 0.5, 0.5
#: A paragraph is reported where its chance of being a licence notice is this at least.
LEAST_EVIDENCE = 0.2
#: Words of a window, about the longest that training has, and from one window to the next: over twice the longest template.
WINDOW, STRIDE = 240, 120
#: Slots that n-grams are hashed to, and rows of a batch in training.
SLOTS = 1 << 16

# Short notices of licence families.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL version 2.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of merchantability or fitness for a particular purpose.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under the Creative Commons Attribution License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.", "Dedicated to the public domain under the Unlicense license."),
    "Proprietary": (
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without prior written permission.",
        "This software is proprietary and confidential; unauthorized copying is prohibited without a license.",
    ),
}
# Sentences of other matters, many with words of licences.
_OTHER = (
    "The driver held a license that had expired years ago.", "You need a fishing license to use this lake.", "The restaurant lost its liquor license after complaints.", "She studied at MIT before moving west.",
    "The BSD conference takes place in spring.", "Human rights groups welcomed the decision.", "The warranty of the washing machine covers two years.", "He asked permission to leave the room early.",
    "The Apache helicopter landed near the village.", "The House of Commons voted on the bill.", "A license plate was found near the road.", "Copyright law changed during the last century.", "Gnu herds cross the river in summer.",
    "The liability insurance pays for damage.", "Creative writing classes start soon.", "The tenant has the right to redistribute furniture.", "This report is confidential until the meeting.", "No permission was needed for the parade.",
    "The program of the concert is free for any person under twelve.", "You can read and change the list of names at any time before the end of the week.", "The distribution of the work took the whole of the year, and this was no fault of the office.",
    "The general public is asked to stay at home.", "He was granted a copy of the notice without any charge.", "The names of the holders are not to be used in this form.", "All conditions of the sale were met by the following day.",
    "Software of this kind is sold as it is in most shops.", "The foundation published a book on the version of events that the later kings wrote.", "Either of the two files may be found in the lower room.",
    "It is hoped that the road will be useful to the town.", "The purpose of the visit was to see the source of the river.", "Both parties agreed to the terms of the contract in writing.", "The law applies to every part of the country unless a state decides otherwise.",
)

_WORD = re.compile(r"[a-z0-9]+")
_SPLIT = r"[^a-z0-9]+"
# Marks of comments at the start of a line, and ends of lines that close a paragraph.
_MARKS = r"(?m)^[ \t]*(?://+!?|/\*+|\*+/|\*+|#+|;+|--+|<!--|%+|\.\.|rem )?[ \t]*"
_BREAK = r"(?<=[.!?:])[\"')\]]*[ \t]*\r?\n\s*|[ \t]*\r?\n[ \t]*\r?\n\s*"


@dataclass
class LicenceModel:
    families: list[str]
    #: Weights of each slot that has some, for each family, and the intercepts.
    weights: dict[int, list[float]]
    intercepts: list[float]
    temperature: float


def slots(text: str) -> list[int]:
    """Slots of the distinct words and word pairs of a text."""
    w = _WORD.findall(text.lower())
    return sorted({zlib.crc32(g.encode()) % SLOTS for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]})


def labelled_paragraphs(count: int = TRAINING_PARAGRAPHS, seed: int = 7, templates: dict[str, tuple[str, ...]] | None = None) -> list[tuple[str, str]]:
    """Generated paragraphs and their families: notices, one or two of a family, with words lost and text around; other text,
    and words of notices out of order."""
    rng = random.Random(seed)
    out = []
    templates = TEMPLATES if templates is None else templates
    noise = "th er on an re de la und que en es ou nt st in ti al der ci".split()
    small = "the of and to a in is that it for was on with as be by this are at from or an no not any all you may we which have has been its".split()
    known = sorted({w for x in templates.values() for t in x for w in t.split()})
    other = sorted({w for t in _OTHER for w in t.split()})

    def prose(most: int) -> str:
        n, kind = rng.randint(0, most), rng.random()
        if kind < 0.3:
            return " ".join(rng.choices(other, k=n))
        if kind < 0.5:
            return " ".join(" ".join(rng.choices(_OTHER, k=1 + n // 8)).split()[:n])
        return " ".join(rng.choice(small) if rng.random() < 0.35 else "".join(rng.choices(noise, k=rng.randint(1, 4))) for _ in range(n))

    for k in range(count):
        if k % 4:
            text = rng.choice((rng.choice(_OTHER), prose(30), prose(200), f"{prose(6)} {' '.join(rng.choices(known, k=rng.randint(1, 4)))} {prose(6)}"))
            out.append((f"{prose(12)} {text} {prose(12)}", UNKNOWN))
            continue
        family = rng.choice(list(templates))
        words = " ".join(rng.sample(templates[family], min(len(templates[family]), rng.choice((1, 1, 2))))).split()
        lost = rng.random() * 0.15
        kept = [w for w in words if rng.random() >= lost] or words
        most = rng.choice((0, 0, 10, 60))
        out.append((f"{prose(most)} {' '.join(kept)} {prose(most)}", family))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, str]] | None = None) -> LicenceModel:
    """Softmax regression by Adam on four fifths of the rows; the temperature minimises the loss on the rest."""
    rows = labelled_paragraphs() if rows is None else rows
    families = sorted({f for _, f in rows})
    held = np.arange(len(rows)) % 5 == 0
    grams = [slots(t) for t, _ in rows]
    # what speaks for a notice: slots commoner in notices than elsewhere; that a paragraph lacks them is the intercept's part
    sizes = [len(g) for g in grams]
    of_row, flat = np.repeat(np.arange(len(rows)), sizes), np.array([x for g in grams for x in g], np.int64)
    notice = np.array([f != UNKNOWN for _, f in rows], bool)
    with_notice, without = (np.bincount(flat[x[of_row]], minlength=SLOTS) / max(x.sum(), 1) for x in (notice & ~held, ~notice & ~held))
    used = np.flatnonzero((with_notice * max((notice & ~held).sum(), 1) >= 3) & (with_notice > 2 * without))
    place = np.full(SLOTS, -1)
    place[used] = np.arange(len(used))
    x = np.zeros((len(rows), len(used) + 1), np.float32)
    x[:, -1] = 1  # the intercept
    for i, g in enumerate(grams):
        c = place[g]
        x[i, c[c >= 0]] = 1
    gold = np.array([families.index(f) for _, f in rows], np.int64)
    fit, y = x[~held], np.eye(len(families), dtype=np.float32)[gold[~held]]
    w = np.zeros((len(used) + 1, len(families)), np.float32)
    m, v, decay = np.zeros_like(w), np.zeros_like(w), np.full((len(used) + 1, 1), DECAY, np.float32)
    decay[-1] = 0
    for step in range(1, STEPS + 1):
        g = fit.T @ ((_softmax(fit @ w) - y) / max(len(fit), 1)) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z, gold = x[held] @ w, gold[held]
    losses = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(gold)), gold], 1e-12)).mean() for t in np.arange(0.5, 4.01, 0.25)} if len(gold) else {1.0: 0.0}
    return LicenceModel(families, {int(s): w[k].astype(float).round(4).tolist() for k, s in enumerate(used)}, w[-1].astype(float).round(4).tolist(), float(min(losses, key=losses.get)))


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _long_array(values: list, kind: str) -> Column:
    """A literal array of any length: Spark folds the parts of one string once, when it plans."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def paragraphs(text: Column) -> Column:
    """Paragraphs of whole texts, without comment marks at the starts of lines; blank ones too."""
    return F.split(F.regexp_replace(text, _MARKS, ""), _BREAK)


def scan_licences(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """Licence paragraphs of whole texts: ``doc_id, paragraph, family, probability, similarity, confirmed``, a row per
    paragraph that is a licence notice with probability LEAST_EVIDENCE at least.

    ``docs`` has ``doc_id`` and ``text``. Paragraphs are numbered from 0; they end at blank lines and at ends of lines that end a
    sentence. A paragraph of over WINDOW words is scored by windows of so many, STRIDE apart, and the one that speaks most for
    a notice stands for it. ``family`` is the likeliest, or ``unknown`` where none reaches LEAST_PROBABILITY, its ``probability`` then that
    of not being a known notice. ``similarity`` is the largest share of
    a template's word pairs that the paragraph holds, over the family's templates; a prediction is
    ``confirmed`` at LEAST_SIMILARITY. Null and empty texts have no paragraphs; rows that repeat are scanned
    each, with null ids too; ties go to the first family by name; an empty table gives an empty result.
    """
    model = train() if model is None else model
    n = len(model.families)
    # slot -> row of the weights, 0 for none; one flat array of weights
    at = np.zeros(SLOTS, np.int64)
    used = sorted(model.weights)
    at[used] = np.arange(len(used)) + 1
    row_of, flat = _long_array(at.tolist(), "int"), _long_array([0.0] * n + [x for s in used for x in model.weights[s]], "double")
    words = F.array_remove(F.split(F.lower("p"), _SPLIT), "")
    # explode() of one value keeps an array from being computed again for each element of a lambda that names it
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).select("doc_id", "row", F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "p")).select("doc_id", "row", "paragraph", F.explode(F.array(words)).alias("w")).where("size(w) > 0")
    # a score is a sum over n-grams, so longer paragraphs are scored by windows of the length that training knows
    windows = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("w") - WINDOW) / STRIDE), F.lit(0)).cast("int"))
    rows = rows.select("doc_id", "row", "paragraph", F.explode(F.transform(windows, lambda k: F.slice("w", k * STRIDE + 1, WINDOW))).alias("w"))
    hits = F.array_distinct(F.array_remove(F.transform(F.concat("w", _pairs(F.col("w"))), lambda g: F.get(row_of, (F.crc32(g.cast("binary")) % SLOTS).cast("int"))), 0))
    rows = rows.select("doc_id", "row", "paragraph", "w", F.explode(F.array(hits)).alias("hits")).where("size(hits) > 0")
    total = F.transform(F.array(*[F.lit(k) for k in range(n)]), lambda k: F.aggregate("hits", F.lit(0.0), lambda a, r: a + F.get(flat, r * n + k)))
    z = F.zip_with(total, _array(model.intercepts), lambda t, b: (t + b) / model.temperature)
    rows = rows.select("doc_id", "row", "paragraph", "w", F.explode(F.array(z)).alias("z"))

    def chance(z: Column) -> Column:
        return 1 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - z))

    unknown = chance(F.get("z", model.families.index(UNKNOWN))) if UNKNOWN in model.families else F.lit(0.0)
    named = F.array(*[F.struct(F.get("z", k).alias("z"), F.lit(-k).alias("k"), F.lit(f).alias("family")) for k, f in enumerate(model.families) if f != UNKNOWN])
    rows = rows.select("doc_id", "row", "paragraph", "w", "z", unknown.alias("none"), F.array_max(named).alias("best")).where(F.col("none") <= 1 - LEAST_EVIDENCE)
    # the window that speaks most for a notice stands for its paragraph; few rows are left to be shuffled
    best = F.max(F.struct((-F.col("none")).alias("notice"), F.col("best.z").alias("evidence"), "w", "none", "best", "z")).alias("x")
    rows = rows.groupBy("row", "doc_id", "paragraph").agg(best).select("doc_id", "paragraph", "x.w", "x.z", "x.none", "x.best")
    rows = rows.select("doc_id", "paragraph", "w", "none", "best", chance(F.col("best.z")).alias("p"))
    sure = F.col("p") >= LEAST_PROBABILITY
    rows = rows.withColumn("family", F.when(sure, F.col("best.family")).otherwise(UNKNOWN)).withColumn("probability", F.when(sure, F.col("p")).otherwise(F.col("none")))
    known = []
    for f, texts in TEMPLATES.items():
        pairs = [sorted({f"{a} {b}" for a, b in zip(w, w[1:])}) for w in (_WORD.findall(t.lower()) for t in texts)]
        known += [F.lit(f), F.array(*[F.array(*[F.lit(p) for p in x]) for x in pairs])]
    templates = F.try_element_at(F.create_map(*known), F.col("family"))
    rows = rows.select("doc_id", "paragraph", "family", "probability", F.explode(F.array(_pairs(F.col("w")))).alias("pairs"))
    share = F.array_max(F.transform(templates, lambda t: F.size(F.array_intersect(t, F.col("pairs"))) / F.size(t)))
    similarity = F.coalesce(share, F.lit(0.0))
    return rows.select("doc_id", "paragraph", "family", "probability", similarity.alias("similarity"), (similarity >= LEAST_SIMILARITY).alias("confirmed"))
