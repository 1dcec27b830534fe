"""Samplers: ids of all kinds, tuples, runs, mixtures of normals."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiddenpath.functions import chain
from hiddenpath.model import Component, ContinuousHmm
from hiddenpath.operators import sampling
from hiddenpath.plans.catalog import NORMAL, PLAIN, SWITCHING

ROWS = [("a", [0, 1, 2, None, 4, 3, 1]), ("b", [1]), ("c", []), ("d", None), ("e", [0, 9]), (None, [2, 2, 0]), (None, [4, 1]), ("long", [k % 5 for k in range(50)])]


def test_ids_of_all_kinds(spark):
    """Text and null ids; the same draws under any partitioning."""
    d = spark.createDataFrame(ROWS, "seq_id string, obs array<int>")
    for draw in (lambda s: sampling.extend(s, PLAIN, 5, seed=2), lambda s: sampling.sample_paths(s, PLAIN, seed=2).drop("obs"), lambda s: sampling.sample_paths_by_tuples(s, PLAIN, 3, seed=2).drop("obs")):
        one, many = ([tuple(r) for r in draw(s).collect()] for s in (d.coalesce(1), d.repartition(5)))
        assert sorted(one, key=str) == sorted(many, key=str) and len(one) == len(ROWS)
        got = dict(one)
        assert got["d"] is None and got["e"] is None and len(got["a"]) in (5, 7)
    assert sampling.key_of(17, b"") == 17 and sampling.key_of("17", b"") != 17


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_tuples_give_the_same_draws(spark, width):
    d = spark.createDataFrame(ROWS, "seq_id string, obs array<int>")
    for sweep in range(3):
        plain = {(r.seq_id, str(r.obs)): r.path for r in sampling.sample_paths(d, PLAIN, 5, sweep).collect()}
        assert plain == {(r.seq_id, str(r.obs)): r.path for r in sampling.sample_paths_by_tuples(d, PLAIN, width, 5, sweep).collect()}
    s = sampling.sample(spark, PLAIN, 30, 25, seed=1)
    a, b = sampling.gibbs(s, PLAIN, 3, seed=4), sampling.gibbs(s, PLAIN, 3, seed=4, width=width)
    assert np.allclose(a[0].a, b[0].a) and sorted(map(tuple, a[1].collect())) == sorted(map(tuple, b[1].collect()))
    assert sampling.tuple_width(10) == 2 and sampling.tuple_width(10**6) == 4


def test_law_of_paths(spark):
    """Many draws of one sequence have the frequencies of its posterior."""
    obs = [0, 3, 2]
    many = spark.range(6000).select(F.col("id").alias("seq_id"), F.array(*[F.lit(x) for x in obs]).alias("obs"))
    weight = {}
    for p in np.ndindex(3, 3, 3):
        weight[p] = PLAIN.pi[p[0]] * PLAIN.a[0][p[0], p[1]] * PLAIN.a[0][p[1], p[2]] * np.prod([PLAIN.b[q][x] for q, x in zip(p, obs)])
    total = sum(weight.values())
    for draws in (sampling.sample_paths(many, PLAIN, 3), sampling.sample_paths_by_tuples(many, PLAIN, 2, 4)):
        seen = Counter(tuple(r.path) for r in draws.collect())
        assert sum((seen[p] - 6000 * w / total) ** 2 / (6000 * w / total) for p, w in weight.items()) < 60  # chi-square of 26 degrees


def test_runs_of_one_item_are_the_plain_sampler(spark):
    s = sampling.sample(spark, NORMAL, 25, 30, seed=6).select("seq_id", "obs")
    s = s.unionByName(spark.createDataFrame([(100, None), (101, []), (102, [80.0, 80.0, 400.0])], "seq_id long, obs array<double>"))
    prior = sampling.NormalPrior(m0=200.0, k0=0.01, a0=1.0, b0=1000.0)
    plain = sampling.gibbs_normal(s, NORMAL, 3, 200.0, 0.01, 1.0, 1000.0, seed=2)
    runs = sampling.gibbs_runs(s, NORMAL, 0.0, 3, prior, seed=2)
    for x, y in zip(plain[0].components, runs[0].components):
        assert y[0].mean == pytest.approx(x[0].mean, rel=1e-9) and y[0].var == pytest.approx(x[0].var, rel=1e-9)
    a, b = ({r.seq_id: r.path for r in m[1].collect()} for m in (plain, runs))
    assert a == b and a[100] is None and a[101] == [] and len(a[102]) == 3


def test_compressed_runs(spark):
    rows = [(1, [1.0, 1.5, 4.0, 4.1, None, 4.2, 9.0]), (2, []), (3, None), (4, [2.0])]
    got = {r.seq_id: r for r in sampling.compressed(spark.createDataFrame(rows, "seq_id int, obs array<double>"), 1.0).collect()}
    assert got[1].n == [2, 4, 1] and got[1].k == [2, 3, 1] and got[1].mean == pytest.approx([1.25, 4.1, 9.0])
    assert got[1].spread == pytest.approx([0.125, 0.02, 0.0]) and got[2].n == [] and got[3].n is None and got[4].n == [1]


def test_likelihood_of_runs():
    """A run's figures are the chance of all its items in a state, steps to itself included."""
    m = ContinuousHmm(pi=[0.6, 0.4], a=[[0.9, 0.1], [0.3, 0.7]], components=[[Component("normal", 1, 0.0, 1.0)], [Component("normal", 1, 3.0, 2.0)]])
    x = np.array([0.1, 0.2, 2.9, 3.3, 3.1])
    k, mean, spread = 3, x[2:].mean(), ((x[2:] - x[2:].mean()) ** 2).sum()
    for i in range(2):
        c = m.components[i][0]
        log = 2 * math.log(m.a[0][i, i]) - 0.5 * (k * math.log(2 * math.pi * c.var) + (spread + k * (mean - c.mean) ** 2) / c.var)
        assert log == pytest.approx(np.log(m.density(i, x[2:])).sum() + 2 * math.log(m.a[0][i, i]))


def test_runs_recover_levels(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(30):
        levels = np.repeat(rng.integers(0, 2, 8), 12)
        rows.append((k, [float(v) for v in np.where(levels, 10.0, 0.0) + rng.normal(0, 0.2, len(levels))]))
    start = ContinuousHmm(pi=[0.5, 0.5], a=[[0.6, 0.4], [0.4, 0.6]], components=[[Component("normal", 1, 2.0, 9.0)], [Component("normal", 1, 7.0, 9.0)]])
    got, paths = sampling.gibbs_runs(spark.createDataFrame(rows, "seq_id long, obs array<double>"), start, 3.0, 6, seed=1)
    assert sorted(c[0].mean for c in got.components) == pytest.approx([0.0, 10.0], abs=0.2)
    truth = {r[0]: [int(v > 5) for v in r[1]] for r in rows}
    high = int(np.argmax([c[0].mean for c in got.components]))
    assert all([int(q == high) for q in r.path] == truth[r.seq_id] for r in paths.collect())


def test_mixtures_of_normals(spark):
    """Two components in one state are recovered beside a state of one."""
    true = ContinuousHmm(pi=[0.5, 0.5], a=[[0.9, 0.1], [0.1, 0.9]], components=[[Component("normal", 0.4, -4.0, 0.5), Component("normal", 0.6, 4.0, 0.5)], [Component("normal", 1, 20.0, 1.0)]])
    start = ContinuousHmm(pi=[0.5, 0.5], a=[[0.7, 0.3], [0.3, 0.7]], components=[[Component("normal", 0.5, -1.0, 9.0), Component("normal", 0.5, 1.0, 9.0)], [Component("normal", 1, 15.0, 9.0)]])
    s = sampling.sample(spark, true, 60, 40, seed=3).select("seq_id", "obs")
    got, _ = sampling.gibbs_normal(s, start, 12, seed=5)
    low, high = sorted(got.components[0], key=lambda c: c.mean)
    assert (low.mean, high.mean) == (pytest.approx(-4, abs=0.3), pytest.approx(4, abs=0.3)) and low.weight == pytest.approx(0.4, abs=0.06)
    assert got.components[1][0].mean == pytest.approx(20, abs=0.3) and low.weight + high.weight == pytest.approx(1)


def test_rules_see_growing_sequences(spark):
    """The class of a step comes from the emissions so far, of the sequence and of what follows it."""
    d = spark.createDataFrame([(1, [0, 1, 2, 3]), (2, [])], "seq_id int, obs array<int>")
    seen = sampling.extend(d, SWITCHING, 3, seed=1, rule=lambda past: len(past) % 2).collect()
    assert all(len(r.next) == 3 for r in seen)
    with pytest.raises(ValueError, match="classes"):
        sampling.gibbs_runs(d, ContinuousHmm(pi=[1.0], a=np.ones((2, 1, 1)), components=[[Component()]]), 1.0)


def test_backward_draws_side_by_side():
    """Paths of a block are those that one row after the other would get."""
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 5, k) for k in (9, 9, 6, 2, 1)]
    at = np.cumsum([0, *map(len, rows)])
    for _, n, x in chain.padded(np.concatenate(rows).astype(float), at, 3):
        alpha, _, _ = chain.forward(PLAIN, chain.emissions(PLAIN, x), n)
        u = rng.random((len(n), int(n[0])))
        got = sampling._backward_draws(alpha, PLAIN.a, n, u)
        for k in range(len(n)):
            after = None
            for t in range(int(n[k]) - 1, -1, -1):
                p = alpha[k, t] if after is None else alpha[k, t] * PLAIN.a[0][:, after]
                after = min(int(np.searchsorted(np.cumsum(p), u[k, t] * p.sum(), "right")), 2)
                assert got[k, t] == after


def test_walks_side_by_side():
    """They are the walks of one row after the other, also where a model ends."""
    ending = PLAIN.copy()
    ending.a = ending.a.copy()
    ending.a[0, 2] = 0
    for model in (PLAIN, ending):
        for length in (0, 1, 17):
            one = [sampling.walk(sampling.generator(5, i), model, length) for i in range(40)]
            assert sampling.walks(model, [sampling.generator(5, i) for i in range(40)], length) == one
