"""Queries and operators over whole sequences and all classes."""

from collections import Counter
from itertools import zip_longest

import numpy as np
import pytest

from hiddenpath.model import Component, ContinuousHmm, DiscreteHmm
from hiddenpath.functions import registry
from hiddenpath.operators import decoding, labelling, sampling, sequences, training
from hiddenpath.plans import catalog
from hiddenpath.streaming.online import online_filter

SF = "/root/testdata/sf0.01"


def test_whole_sequences(spark):
    obs = {r.seq_id: r.obs for r in catalog.symbols(spark, SF).collect()}
    both = [(i, obs[i], obs[i + 1]) for i in obs if i + 1 in obs]
    assert max(map(len, obs.values())) > 64
    want = Counter(z for _, x, y in both for z in zip_longest(x, y))
    assert {(r.a, r.b): r.n for r in catalog.pair_counts_whole(spark, SF).collect()} == want
    got = {r.pair_id: r.path for r in catalog.pair_alignment(spark, SF).collect()}
    steps = catalog._PAIR.steps
    assert {i: tuple(np.array([steps[int(q)] for q in got[i].split(",")]).sum(0)) for i in got} == {i: (len(x), len(y)) for i, x, y in both}
    x = {r.seq_id: r.obs for r in catalog.reals(spark, SF).collect()}
    cells = {(r.k, r.l): r.value for r in sequences.scatter_matrix(catalog.reals(spark, SF)).collect()}
    n = max(map(len, x.values()))
    assert set(cells) == {(k, l) for l in range(n) for k in range(l + 1)}
    for k, l in [(0, 3), (2, 50), (5, n - 1), (70, 70)]:
        a, b = (np.array([float(v[j]) for v in x.values() if len(v) > l]) for j in (k, l))
        assert abs(cells[k, l] - ((a * b).mean() - a.mean() * b.mean())) < 1e-6


def test_sampling_with_classes(spark):
    """Class 0 keeps the state, class 1 changes it; the class is the last symbol."""
    m = DiscreteHmm(pi=[0.5, 0.5], a=[np.eye(2), [[0, 1], [1, 0]]], b=[[0.7, 0.3], [0.4, 0.6]], alphabet=("0", "1"))
    rows = sampling.sample(spark, m, 30, 25, seed=2, rule=_last).collect()
    assert all(p ^ q == x for r in rows for p, q, x in zip(r.states, r.states[1:], r.obs))
    s = spark.createDataFrame([(r.seq_id, r.obs, r.obs) for r in rows], "seq_id long, obs array<int>, cls array<int>")
    for r in sampling.sample_paths(s, m, 1, classes="cls").collect():
        assert all(p ^ q == x for p, q, x in zip(r.path, r.path[1:], r.obs))
    sure = DiscreteHmm(pi=[1, 0], a=[np.eye(2), [[0, 1], [1, 0]]], b=[[0, 1], [1, 0]], alphabet=("0", "1"))
    one = spark.createDataFrame([(1, [1])], "seq_id long, obs array<int>")
    assert sampling.extend(one, sure, 4, rule=_last).first().next == [0, 0, 0, 0]
    for call in (lambda: sampling.sample(spark, m, 2, 2), lambda: sampling.extend(one, m, 2), lambda: sampling.sample_paths(one, m), lambda: sampling.gibbs(one, m, 1)):
        with pytest.raises(ValueError, match="classes"):
            call()


def _last(obs):
    return obs[-1]


def test_models_that_an_operator_cannot_take(spark):
    """Silent, higher-order and switching models raise where the operator would give wrong figures."""
    two = np.array([[[0.5, 0.5], [0.5, 0.5]]] * 2)
    plain = {"pi": [0.5, 0.5], "a": two[0], "alphabet": (0, 1)}
    silent = DiscreteHmm(**plain, b=[[0.5, 0.5], [0, 0]], labels=["x", "y"])
    deep = DiscreteHmm(**plain, b=[[0.5, 0.5, 0.5, 0.5], [0.5, 0.5]], labels=["x", "y"])
    switching = DiscreteHmm(pi=[0.5, 0.5], a=two, b=[[0.5, 0.5]] * 2, alphabet=(0, 1), labels=["x", "y"])
    s = spark.createDataFrame([(1, [0, 1, 1])], "seq_id long, obs array<int>")
    e = spark.createDataFrame([(1, 1, 0)], "u long, t int, x int")
    for m in (silent, switching):
        with pytest.raises(ValueError):
            labelling.label(s, m)
        with pytest.raises(ValueError):
            sampling.sample_paths(s, m)
    for m in (silent, deep, switching):
        with pytest.raises(ValueError):
            sampling.gibbs(s, m, 1)
        with pytest.raises(ValueError):
            online_filter(e, m, "u", "t", "x")


def test_sql_functions_on_many_rows(spark):
    registry.register(spark, "plain", catalog.PLAIN)
    s = catalog.symbols(spark, SF)
    got = {r.seq_id: (r.l, r.p) for r in s.selectExpr("seq_id", "plain_logp(obs) AS l", "plain_path(obs) AS p").collect()}
    want = {r.seq_id: (r.logp, r.path) for r in decoding.decode(s, catalog.PLAIN, ["logp", "path"]).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == pytest.approx(want[i][0]) and got[i][1] == want[i][1] for i in want)
    odd = spark.createDataFrame([(1, None), (2, [0, 1])], "seq_id long, obs array<int>").selectExpr("plain_logp(obs) AS l", "plain_path(obs) AS p").collect()
    assert odd[0].l is None and odd[0].p is None and len(odd[1].p) == 2


def test_independent_dimensions_are_fitted_as_such(spark):
    """Covariances near 0 stay near 0, and a flat cloud of points gives a positive definite matrix."""
    rng = np.random.default_rng(4)
    start = ContinuousHmm(pi=[1], a=[[1]], components=[[Component("multinormal", 1, np.array([0.2, 0.1]), np.eye(2))]])
    for cloud in (rng.normal(size=(4000, 2)), np.repeat(rng.normal(size=(500, 1)), 2, 1)):
        s = spark.createDataFrame([(1, cloud.tolist())], "seq_id long, obs array<array<double>>")
        got = training.baum_welch(s, start, 4).model.components[0][0]
        want = np.cov(cloud.T, bias=True)
        assert np.asarray(got.var) == pytest.approx(want, abs=2e-3)
        np.linalg.cholesky(got.var)
