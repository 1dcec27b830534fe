"""Recursions against known values and against sums over all paths."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hiddenpath.functions import chain
from hiddenpath.model import DNA, Component, ContinuousHmm, DiscreteHmm
from hiddenpath.operators import labelling, pairs

# The models, observations and expected figures of the known-value tests below are published ones, kept as they are.
SILENT = DiscreteHmm(pi=[1, 0, 0], a=[[0.3, 0.3, 0.4], [0.6, 0.1, 0.3], [1, 0, 0]], b=[[0, 0.5, 0.5, 0], [0.1, 0, 0.8, 0.1], [0, 0, 0, 0]], alphabet=DNA)
LABELLED = DiscreteHmm(
    pi=[1, 0, 0], a=[[0, 0.5, 0.5], [0.4, 0.2, 0.4], [0.3, 0.3, 0.4]], b=[[0.2, 0.1, 0.1, 0.6], [0.3, 0.1, 0.1, 0.5], [0.25] * 4 + [0, 0, 1, 0] + [0.25] * 8], alphabet=DNA, labels=["la", "ma", "na"]
)


def codes(text):
    return np.array([["acgt".index(c) for c in text]], float), np.array([len(text)])


def test_viterbi_with_silent_states():
    # Fixed values.
    x, n = codes("ccgccgggggcgggc")
    paths, logp = chain.viterbi(SILENT, chain.emissions(SILENT, x), n)
    assert paths[0].tolist() == [0, 2, 0, 1, 0, 2, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0]
    assert logp[0] == pytest.approx(-19.698557965224637, abs=1e-12)


def test_higher_order_viterbi_and_labelling():
    # Fixed values.
    x, n = codes("acgttaaacgtgacgcattt")
    e = chain.emissions(LABELLED, x)
    _, logp = chain.viterbi(LABELLED, e, n)
    assert logp[0] == pytest.approx(-35.735009627142446, abs=1e-10)
    names, best = labelling.likeliest_labelling(LABELLED, e[0], 1)
    assert best == pytest.approx(-35.735009627142446, abs=1e-10)
    assert " ".join(names) == "la na na ma la ma la ma na na la na na na na na ma la ma la"
    flat = LABELLED.copy()
    flat.b = [b[:4] for b in flat.b]
    assert chain.viterbi(flat, chain.emissions(flat, x), n)[1][0] == pytest.approx(-39.893892710502115, abs=1e-10)


def test_first_step_counts_silent_states():
    alpha, scale, _ = chain.forward(SILENT, chain.emissions(SILENT, codes("g")[0]), np.array([1]))
    assert scale[0, 0] == pytest.approx(0.7)
    assert alpha[0, 0] == pytest.approx([0.5 / 0.7, 0, 0.2 / 0.7])


def test_densities():
    # Fixed values.
    mixed = [Component("normal", 0.5, 0, 1), Component("normal", 0.3, 1, 2.5), Component("normal", 0.2, 2, 5.5)]
    model = ContinuousHmm(pi=[1], a=[[1]], components=[mixed])
    assert model.density(0, np.array(1.0)) == pytest.approx(0.227744770124, abs=1e-7)
    right, left = Component("normal_right", 1, 6, 4, lo=5.3), Component("normal_left", 1, -1, 1, hi=0)
    assert right.density(np.array([5.2, 5.4])) == pytest.approx([0, 0.29944210031070617])
    assert left.density(np.array([0.2, -1.2])) == pytest.approx([0, 0.46478295110622631])
    assert Component("uniform", lo=1, hi=2).density(np.array([0.5, 1.5])) == pytest.approx([0, 1])
    assert right.cumulative(5.3) == 0 and left.cumulative(0) == pytest.approx(1)


def test_multivariate_viterbi_values():
    # Fixed values.
    cov = [[0.9, 0.4, 0.4, 0.3], [1, 0.3, 0.3, 0.2], [0.4, 0.3, 0.3, 1]]
    means = [[1, -1], [2, 6], [0, 1]]
    m = ContinuousHmm(pi=[0.5, 0, 0.5], a=[[0, 1, 0], [0.5, 0, 0.5], [0.3, 0.3, 0.4]], components=[[Component("multinormal", 1, np.array(u, float), np.array(c).reshape(2, 2))] for u, c in zip(means, cov, strict=True)])
    x = np.array([[[1, -1], [2, 6]] * 3], float)
    e = chain.emissions(m, x)
    assert e[0, 0, 0] == pytest.approx(1 / math.sqrt((2 * math.pi) ** 2 * (0.9 * 0.3 - 0.16)))
    assert chain.viterbi(m, e, np.array([6]))[0][0].tolist() == [0, 1] * 3


probabilities = st.lists(st.floats(0.05, 1), min_size=3, max_size=3).map(lambda v: [x / sum(v) for x in v])


@settings(max_examples=25, deadline=None)
@given(probabilities, st.lists(probabilities, min_size=3, max_size=3), st.lists(probabilities, min_size=3, max_size=3), st.lists(st.integers(0, 2), min_size=1, max_size=5))
def test_all_paths(pi, a, b, obs):
    m = DiscreteHmm(pi=pi, a=a, b=b, alphabet=(0, 1, 2))
    x, n = np.array([obs], float), np.array([len(obs)])
    every = {q: pi[q[0]] * math.prod(a[s][t] for s, t in zip(q, q[1:])) * math.prod(b[s][o] for s, o in zip(q, obs, strict=True)) for q in itertools.product(range(3), repeat=len(obs))}
    e = chain.emissions(m, x)
    alpha, scale, logp = chain.forward(m, e, n)
    assert logp[0] == pytest.approx(math.log(sum(every.values())))
    assert chain.viterbi(m, e, n)[1][0] == pytest.approx(math.log(max(every.values())))
    beta = chain.backward(m, e, n, scale)
    assert (alpha * beta).sum(2)[0] == pytest.approx(np.ones(len(obs)))
    first = np.array([sum(p for q, p in every.items() if q[0] == s) for s in range(3)]) / sum(every.values())
    assert (alpha * beta)[0, 0] == pytest.approx(first)


def test_pair_alignment_against_all_paths():
    rng = np.random.default_rng(1)
    a = rng.dirichlet([1, 1, 1], 3)
    m = pairs.PairHmm(pi=[0.5, 0.3, 0.2], a=a, b=[rng.dirichlet([1] * 4), [0.3, 0.7], [0.6, 0.4]], steps=[(1, 1), (1, 0), (0, 1)], m=2)
    x, y = np.array([0, 1, 1]), np.array([1, 0])
    best = max((pairs.path_log_likelihood(m, x, y, list(q)), q) for k in range(2, 6) for q in itertools.product(range(3), repeat=k))
    path, logp = pairs.align(m, x, y)
    assert logp == pytest.approx(best[0]) and tuple(path) == best[1]
    assert pairs.path_log_likelihood(m, x, y, [0]) == -math.inf


def test_model_edits():
    # The figures of ties and backgrounds.
    m = SILENT.copy()
    m.set_start(1, 0.5)
    assert m.pi.tolist() == [0.5, 0.5, 0] and not m.check()
    long = SILENT.with_duration(1, 3)
    assert long.n == 5 and long.a[0][1].tolist() == [0, 0, 0, 1, 0] and long.a[0][4, :3].tolist() == [0.6, 0.1, 0.3]
    tied = DiscreteHmm(pi=[1, 0, 0], a=SILENT.a[0], b=[[0, 0.5, 0.5, 0], [0.1, 0, 0.8, 0.1], [0.2, 0.2, 0.2, 0.4]], alphabet=DNA, ties=[[1, 2]]).tied()
    assert tied.b[1] == pytest.approx([0.15, 0.1, 0.5, 0.25]) and tied.b[2] == pytest.approx(tied.b[1])
    mixed = DiscreteHmm(pi=[1], a=[[1]], b=[[0, 0.5, 0.5, 0]], alphabet=DNA, backgrounds={"x": np.array([0.2, 0.3, 0.1, 0.4])}).with_background({0: ("x", 0.1)})
    assert mixed.b[0] == pytest.approx([0.02, 0.48, 0.46, 0.04])
