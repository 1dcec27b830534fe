"""Figures of models by known values: parameters, distances, intervals, distribution functions; casts of sequences."""

import math

import numpy as np
import pytest

from hiddenpath.model import Component, ContinuousHmm, parameter_distance, phi
from hiddenpath.operators import sequences
from hiddenpath.plans.catalog import NORMAL, OTHER, PLAIN


def test_free_parameters():
    assert NORMAL.free_parameters() == 2 + 3 * 2 + 3 * 2
    m = ContinuousHmm(pi=[1.0, 0.0], a=[[0.5, 0.5], [0.0, 1.0]], components=[[Component("normal", 0.5, 0, 1), Component("normal", 0.5, 3, 1, fixed=True)], [Component("normal", 1, 5, 2)]], fixed=frozenset({1}))
    assert m.free_parameters() == 0 + 1 + (1 + 2)
    wide = ContinuousHmm(pi=[1.0], a=[[1.0]], components=[[Component("multinormal", 1.0, [0, 0, 0], np.eye(3))]])
    assert wide.free_parameters() == 3 + 6


def test_parameter_distance():
    assert parameter_distance(PLAIN, PLAIN) == 0
    parts = np.concatenate([PLAIN.pi - OTHER.pi, (PLAIN.a - OTHER.a).reshape(-1), *[p - q for p, q in zip(PLAIN.b, OTHER.b)]])
    assert parameter_distance(PLAIN, OTHER) == pytest.approx(math.sqrt((parts**2).sum() / (3 + 9 + 15)))


def test_intervals_and_distribution_functions():
    m = ContinuousHmm(pi=[1.0], a=[[1.0]], components=[[Component("normal", 0.25, 0.0, 4.0), Component("normal", 0.75, 10.0, 1.0)]])
    assert m.interval(0) == (-6, 13)
    for x in (-3.0, 0.0, 4.0, 9.5, 20.0):
        assert m.cumulative(0, x) == pytest.approx(0.25 * phi(x / 2) + 0.75 * phi(x - 10))
    # a distribution function is the integral of its density, for every kind
    for c, lo, hi in ((Component("normal", 1, 1.0, 2.0), -12, 14), (Component("normal_right", 1, 1.0, 2.0, lo=0.5), 0.5, 14), (Component("normal_left", 1, 1.0, 2.0, hi=1.5), -12, 1.5), (Component("uniform", 1, lo=-1.0, hi=3.0), -1, 3)):
        x = np.linspace(lo, hi, 200_001)
        p = c.density(x)
        for q in (0.1, 0.5, 0.9):
            k = int(q * 200_000)
            area = np.trapezoid(p[: k + 1], x[: k + 1])
            assert area == pytest.approx(c.cumulative(float(x[k])), abs=1e-5)
        assert c.cumulative(lo - 1) == pytest.approx(0, abs=1e-9) and c.cumulative(hi + 1) == pytest.approx(1)


def test_a_normal_of_two_dimensions():
    cov = np.array([[2.0, 0.6], [0.6, 1.0]])
    c = Component("multinormal", 1.0, [1.0, -1.0], cov)
    off = np.array([0.5, 2.0]) - [1.0, -1.0]
    want = math.exp(-0.5 * off @ np.linalg.inv(cov) @ off) / (2 * math.pi * math.sqrt(np.linalg.det(cov)))
    assert c.density(np.array([0.5, 2.0])) == pytest.approx(want)


def test_casts_and_weights(spark):
    d = sequences.from_lists(spark, [[1.4, -2.6], []], "double")
    assert [r.obs for r in sequences.to_integers(d).orderBy("seq_id").collect()] == [[1, 3], []]
    assert [r.obs for r in sequences.to_reals(sequences.to_integers(d)).orderBy("seq_id").collect()] == [[1.0, 3.0], []]
    total = sequences.extremes(sequences.to_integers(d).withColumn("weight", d["weight"] * 2.5)).first()
    assert total.n == 2 and total.total_weight == 5.0
