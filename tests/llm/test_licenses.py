"""Licence scans: wrapped notices, held-out wordings, scores against a plain computation, odd rows."""

import random
import re
import zlib

import numpy as np
import pytest

from hiddenpath.llm import license_scan

WRAPPED = """# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files, to deal in the Software
# without restriction.
#
# The above copyright notice and this permission notice shall be included in all
# copies or substantial portions of the Software.

def main(): pass
"""
# Wordings of notices that no template has.
OTHER_WORDINGS = {
    "MIT": "Distributed under the MIT license, see the file LICENSE.",
    "Apache-2.0": "This file is made available under the terms of the Apache License, Version 2.0.",
    "GPL": "Foo is free software; you may redistribute it under the terms of the GNU General Public License, version 2 or later.",
    "MPL-2.0": "This file is subject to the Mozilla Public License version 2.0.",
    "CC-BY-SA": "Text is available under the Creative Commons Attribution-ShareAlike 4.0 license.",
    "BSD": "Use of this source is governed by a BSD 3-Clause license: redistribution and use in source and binary forms are permitted.",
}


@pytest.fixture(scope="module")
def model():
    return license_scan.train()


def test_wrapped_notice(spark, model):
    got = license_scan.scan_licences(spark.createDataFrame([(1, WRAPPED)], "doc_id long, text string"), model).collect()
    assert [(r.paragraph, r.family, r.confirmed) for r in sorted(got, key=lambda r: r.paragraph)] == [(0, "MIT", True), (1, "MIT", True)]
    assert all(r.similarity == 1.0 for r in got)


def test_other_wordings(spark, model):
    """Notices that the model wasn't trained on; and sentences about other matters."""
    other = ["He was told that his license had been taken away.", "The museum is open to the public free of charge.", "We found a copy of the notice in the software shop.", "The Mozilla office moved to another town."]
    rows = list(enumerate([*OTHER_WORDINGS.values(), *other]))
    got = {r.doc_id: r.family for r in license_scan.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    right = sum(got.get(k) == f for k, f in enumerate(OTHER_WORDINGS))
    assert right >= len(OTHER_WORDINGS) - 1
    assert not any(got.get(k, license_scan.UNKNOWN) != license_scan.UNKNOWN for k in range(len(OTHER_WORDINGS), len(rows)))


def test_held_out_templates():
    """A model without a fourth of the templates still finds most notices (0.86 where this was written), and leaves other text alone."""
    kept = {f: t[1:] if len(t) > 1 else t for f, t in license_scan.TEMPLATES.items()}
    model = license_scan.train(license_scan.labelled_paragraphs(templates=kept))
    rows = license_scan.labelled_paragraphs(1000, seed=50)
    p = [plain(t, model) for t, _ in rows]
    notice = np.array([f != license_scan.UNKNOWN for _, f in rows])
    found = np.array([x[model.families.index(license_scan.UNKNOWN)] < 0.5 for x in p])
    assert (found & ~notice).sum() < 0.04 * (~notice).sum() and (found & notice).sum() > 0.8 * notice.sum()
    # calibrated: of notices named with probability 0.9 and more, as many are right
    named = [(max(x), model.families[int(np.argmax(x))] == f) for x, (_, f) in zip(p, rows, strict=True) if max(x) > 0.9]
    assert sum(ok for _, ok in named) > 0.9 * len(named) > 0


def plain(text, model):
    w = re.findall("[a-z0-9]+", text.lower())
    slots = {zlib.crc32(g.encode()) % license_scan.SLOTS for g in w + [f"{a} {b}" for a, b in zip(w, w[1:])]}
    z = np.array(model.intercepts) + sum((np.array(model.weights[s]) for s in slots if s in model.weights), np.zeros(len(model.families)))
    e = np.exp((z - z.max()) / model.temperature)
    return e / e.sum()


def test_scores_against_a_plain_computation(spark, model):
    rng = random.Random(3)
    texts = [t.replace("\n", " ") for t, _ in license_scan.labelled_paragraphs(150, seed=9)] + ["", "...", "MIT"]
    texts = [t if rng.random() < 0.5 else t.upper() for t in texts]
    one = [re.sub(r"[.!?:]\s", " ", t) for t in texts]
    got = {r.doc_id: r for r in license_scan.scan_licences(spark.createDataFrame(list(enumerate(one)), "doc_id long, text string"), model).collect()}
    unknown = model.families.index(license_scan.UNKNOWN)
    for k, t in enumerate(one):
        p = plain(t, model)
        if abs(p[unknown] - 0.8) < 1e-6:
            continue
        assert (k in got) == (p[unknown] < 0.8 and any(s in model.weights for s in license_scan.slots(t)))
        if k in got:
            named = np.delete(p, unknown)
            if named.max() >= license_scan.LEAST_PROBABILITY:
                assert got[k].family == [f for f in model.families if f != license_scan.UNKNOWN][int(named.argmax())]
                assert got[k].probability == pytest.approx(named.max())
            else:
                assert (got[k].family, got[k].probability) == (license_scan.UNKNOWN, pytest.approx(p[unknown]))


def test_odd_rows(spark, model):
    long = "word and word, " * 60_000 + "\n\nReleased under the MIT License."
    rows = [(None, None, "x"), (1, "", "x"), (2, "Released under the MIT License.", "x"), (2, "Released under the MIT License.", "x"), (None, long, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, family string")
    got = license_scan.scan_licences(d, model).collect()
    assert sorted((r.doc_id or 0, r.paragraph, r.family, r.confirmed) for r in got) == [(0, 1, "MIT", True), (2, 0, "MIT", True), (2, 0, "MIT", True)]
    assert license_scan.scan_licences(d.limit(0), model).count() == 0
    # two families tie: neither reaches the least probability
    tie = license_scan.LicenceModel(["A", "B", license_scan.UNKNOWN], {license_scan.slots("mit")[0]: [3.0, 3.0, 0.0]}, [0.0, 0.0, -9.0], 1.0)
    assert {r.family for r in license_scan.scan_licences(d, tie).collect()} == {license_scan.UNKNOWN}


def test_long_paragraphs(spark):
    """None of 100 unbroken texts of 10,000 words is called a notice; a notice inside one is found."""
    rng = random.Random(31)
    vocabulary = "".join(f"{a}{b} " for a in "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system".split() for b in ("", "s", "ly")).split()
    small = "the of and to a in is that it for was on with as be by this are at from or an no not any all you may we which have has been its".split()
    words = [[rng.choice(small) if rng.random() < 0.45 else rng.choice(vocabulary) for _ in range(10_000)] for _ in range(100)]
    rows = [(k, " ".join(w)) for k, w in enumerate(words)]
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction"
    rows += [(1000 + k, " ".join([*words[k][: 3333 * k], notice, *words[k][3333 * k :]])) for k in range(4)]
    got = license_scan.scan_licences(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert sorted(r.doc_id for r in got) == [1000, 1001, 1002, 1003]
    assert {(r.family, r.paragraph, r.confirmed) for r in got} == {("MIT", 0, True)}
