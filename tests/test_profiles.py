"""Profile models by known values, joint likelihoods of all kinds of models, distances by length, models of sets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiddenpath.model import models_of_sequences
from hiddenpath.operators import decoding, labelling, sampling
from hiddenpath.plans.catalog import ORDER1, OTHER, PLAIN, SILENT, SWITCHING
from hiddenpath.sources import files

PROFILE = """HMMER2.0
NAME  little
LENG  3
ALPH  Nucleotide
XT    -1000 -1000 -1000 -1000 -1000 -1000 -1000 -1000
NULT  -4 -8455
NULE  0 0 1000 -1000
HMM   A C G T
      m->m m->i m->d i->m i->i d->m d->d b->m m->e
      -500 * -2000
   1  1000 0 -1000 0 1
   -  0 0 0 0
   -  -1000 -2000 -2000 -1000 -1000 -1000 -1000 -500 *
   2  0 0 0 0 2
   -  0 1000 0 0
   -  -1000 -2000 -2000 -500 -1500 0 -3000 -2000 -4000
   3  * * * 2000 3
   -  * * * *
   -  * * * * * * * -3000 0
//
"""


def test_profile_reader(spark, tmp_path):
    (tmp_path / "x.hmm").write_text(PROFILE)
    (m,) = files.read_models(spark, str(tmp_path / "x.hmm"))
    at = {s: i for i, s in enumerate(["N", "B", "E", "J", "C", "T", "M1", "I1", "D1", "M2", "I2", "D2", "M3", "D3"])}
    assert m.n == len(at) and m.name == "little" and m.alphabet == ("A", "C", "G", "T") and m.pi[at["N"]] == 1

    def row(state, **moves):
        total = sum(moves.values())
        got = {s: m.a[0][at[state], i] for s, i in at.items() if m.a[0][at[state], i] > 0}
        assert got == pytest.approx({k: v / total for k, v in moves.items()})

    p = lambda s: 2 ** (s / 1000)
    row("N", B=p(-1000), N=p(-1000))
    row("E", C=p(-1000), J=p(-1000))
    row("B", M1=p(-500), M2=p(-2000), M3=p(-3000), D1=p(-2000))
    row("M1", M2=p(-1000), I1=p(-2000), D2=p(-2000))
    row("I1", M2=p(-1000), I1=p(-1000))
    row("D1", M2=p(-1000), D2=p(-1000))
    row("M2", M3=p(-1000), I2=p(-2000), D3=p(-2000), E=p(-4000))
    row("I2", M3=p(-500), I2=p(-1500))
    row("D2", M3=p(0), D3=p(-3000))
    row("M3", E=p(0))
    row("D3", E=1.0)
    row("J", B=p(-1000), J=p(-1000))
    row("C", T=p(-1000), C=p(-1000))
    assert not m.a[0][at["T"]].any()
    null = np.array([1, 1, 2, 0.5]) / 4.5
    for state, scores in (("N", [0] * 4), ("M1", [1000, 0, -1000, 0]), ("I2", [0, 1000, 0, 0])):
        want = null * [p(s) for s in scores]
        assert m.b[at[state]] == pytest.approx(want / want.sum())
    assert m.b[at["M3"]] == pytest.approx([0, 0, 0, 1]) and sorted(m.silent) == sorted(at[s] for s in ("B", "E", "T", "D1", "D2", "D3"))


def test_profile_likelihood_is_the_sum_over_all_paths(spark, tmp_path):
    """The forward figure of a profile equals the sum over all its paths of the items."""
    (m,) = files.models_from_profiles(PROFILE)

    def total(state, obs):
        if state in m.silent:
            rest, weight = obs, 1.0
        elif obs:
            rest, weight = obs[1:], m.b[state][obs[0]]
        else:
            return 0.0
        if not rest and state not in m.silent:
            return weight  # the last item ends the sequence, in whatever state
        return weight * sum(m.a[0][state, q] * total(q, rest) for q in range(m.n) if m.a[0][state, q] > 0)

    rows = [(1, [0, 1, 2]), (2, [3]), (3, [2, 2, 0, 3])]
    got = {r.seq_id: r.logp for r in decoding.decode(spark.createDataFrame(rows, "seq_id int, obs array<int>"), m, ["logp"]).collect()}
    assert got == pytest.approx({i: math.log(sum(m.pi[q] * total(q, o) for q in range(m.n) if m.pi[q] > 0)) for i, o in rows})


@pytest.mark.parametrize("model,classes", [(PLAIN, None), (SILENT, None), (ORDER1, None), (SWITCHING, "c")])
def test_joint_likelihood_of_all_kinds(spark, model, classes):
    """It is the figure that decoding gives for its own path; the sum over paths is the likelihood."""
    s = sampling.sample(spark, PLAIN, 15, 9, seed=6).select("seq_id", "obs", F.transform("obs", lambda x: x % 2).alias("c"))
    d = s.join(decoding.decode(s, model, ["path", "path_logp"], classes), "seq_id")
    got = {r.seq_id: r.logp for r in decoding.joint_log_likelihood(d, model, "path", classes).collect()}
    assert got == pytest.approx({r.seq_id: r.path_logp for r in d.collect()})
    rows = [(1, [0, 1], [0], [0, 0]), (2, None, [0], None), (3, [0], None, [0]), (4, [], [], []), (5, [0], [0, 1], [0])]
    odd = spark.createDataFrame(rows, "seq_id int, obs array<int>, path array<int>, c array<int>")
    bad = {r.seq_id: r.logp for r in decoding.joint_log_likelihood(odd, model, "path", classes).collect()}
    assert bad == {1: -math.inf, 2: None, 3: None, 4: 0.0, 5: -math.inf}


def test_joint_likelihoods_sum_up(spark):
    obs, paths = [0, 3, 1], []

    def go(path, left):
        if not left:
            paths.append(path)
            return
        for q in range(3):
            quiet = q in SILENT.silent
            if not (quiet and path and path[-1] in SILENT.silent):
                go([*path, q], left - (not quiet))

    go([], 3)
    rows = [(k, obs, p) for k, p in enumerate(paths)]
    got = decoding.joint_log_likelihood(spark.createDataFrame(rows, "seq_id int, obs array<int>, path array<int>"), SILENT, "path").collect()
    want = decoding.decode(spark.createDataFrame([(1, obs)], "seq_id int, obs array<int>"), SILENT, ["logp"]).first().logp
    assert math.log(sum(math.exp(r.logp) for r in got)) == pytest.approx(want)


def test_distance_by_length(spark):
    s = sampling.sample(spark, PLAIN, 12, 30, seed=2).unionByName(sampling.sample(spark, PLAIN, 5, 10, seed=3)).select("seq_id", "obs")
    got = {r["items"]: r for r in decoding.distance_curve(PLAIN, OTHER, s, 10).collect()}
    assert {t: r.n for t, r in got.items()} == {10: 17, 20: 12, 30: 12}
    for t in got:
        cut = s.where(F.size("obs") >= t).select("seq_id", F.slice("obs", 1, t).alias("obs"))
        assert got[t].distance == pytest.approx(decoding.distance(PLAIN, OTHER, cut).first().distance)


def test_models_of_sets(spark):
    rows = [[0, 2, 1], [], [1]]
    models = models_of_sequences(rows)
    assert [m.n for m in models] == [3, 1] and all(m.m == 3 for m in models)
    d = spark.createDataFrame([(k, r) for k, r in enumerate(rows) if r], "seq_id int, obs array<int>")
    assert [r.scores for r in decoding.score_all(d, models).orderBy("seq_id").collect()] == [[0.0, -math.inf], [-math.inf, 0.0]]


def test_labelling_with_classes(spark):
    """With room for all hypotheses, the likeliest labelling of all, over models with one class or two."""
    two = SWITCHING.copy()
    two.labels = ["0", "1", "1"]
    rng = np.random.default_rng(3)
    for model, classes in ((PLAIN, None), (two, "c")):
        rows = [(k, rng.integers(0, 5, 5).tolist(), rng.integers(0, 2, 5).tolist()) for k in range(6)]
        got = {r.seq_id: r for r in labelling.label(spark.createDataFrame(rows, "seq_id int, obs array<int>, c array<int>"), model, 64, classes).collect()}
        for i, obs, cls in rows:
            totals = {}
            for q in itertools.product(range(3), repeat=5):
                p = model.pi[q[0]] * np.prod([model.a[cls[t] if classes else 0][q[t], q[t + 1]] for t in range(4)]) * np.prod([model.b[s][x] for s, x in zip(q, obs)])
                name = "".join(model.labels[s] for s in q)
                totals[name] = totals.get(name, 0.0) + p
            best = max(totals, key=totals.get)
            assert got[i].logp == pytest.approx(math.log(totals["".join(got[i].labels)])) and got[i].logp >= math.log(totals[best]) - 0.1
    with pytest.raises(ValueError, match="classes"):
        labelling.label(spark.createDataFrame([], "seq_id int, obs array<int>"), two)
