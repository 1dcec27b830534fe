"""Training: closed discriminative steps, kept scores, tails, starts; thresholds, classes, the table function."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiddenpath.functions import chain, folds, registry
from hiddenpath.model import Component, ContinuousHmm, DiscreteHmm
from hiddenpath.operators import decoding, sampling, training
from hiddenpath.plans.catalog import NORMAL, OTHER, PLAIN, SWITCHING


def labelled(spark, count=40, length=15):
    x = sampling.sample(spark, PLAIN, count, length, seed=1).select("seq_id", "obs").withColumn("own", F.lit(0))
    y = sampling.sample(spark, OTHER, count, length, seed=2).select((F.col("seq_id") + 1000).alias("seq_id"), "obs").withColumn("own", F.lit(1))
    return x.unionByName(y)


@pytest.mark.parametrize("closed", [False, True])
def test_discriminative_never_falls(spark, closed):
    d = labelled(spark)
    models, trace = training.discriminative(d, [PLAIN, OTHER], "own", steps=4, closed=closed)
    assert all(b > a for a, b in zip(trace, trace[1:])) and len(trace) > 1
    assert all(not m.normalised().check() and np.allclose(m.a.sum(2), 1) and m.pi.sum() == pytest.approx(1) for m in models)
    assert decoding.log_odds(d, models, "own").agg(F.sum("gain")).first()[0] == pytest.approx(trace[-1])


def test_discriminative_counts_are_the_gradient(spark):
    """The weighted counts are the derivatives of the objective by the logarithms of the parameters, by finite differences."""
    d = labelled(spark, 10, 6).persist()

    def value(models):
        return decoding.log_odds(d, models, "own").agg(F.sum("gain")).first()[0]

    both = training._gathered([PLAIN, OTHER] * 2, training.statistics(training._discriminated(d, [PLAIN, OTHER], "own"), [PLAIN, OTHER] * 2, "w"))
    up, down = both[:2], both[2:]
    h = 1e-5
    for k, (i, j) in ((0, (0, 1)), (1, (2, 2)), (0, (1, 0))):
        moved = []
        for sign in (1, -1):
            models = [PLAIN.copy(), OTHER.copy()]
            models[k].a[0, i, j] *= math.exp(sign * h)
            moved.append(value(models))
        assert (moved[0] - moved[1]) / (2 * h) == pytest.approx(up[k].of["a"][i, j] - down[k].of["a"][i, j], rel=1e-3, abs=1e-6)
    for k, (i, j) in ((0, (1, 2)), (1, (0, 3))):
        moved = []
        for sign in (1, -1):
            models = [PLAIN.copy(), OTHER.copy()]
            models[k].b[i][j] *= math.exp(sign * h)
            moved.append(value(models))
        assert (moved[0] - moved[1]) / (2 * h) == pytest.approx(up[k].of[f"b{i}"][j] - down[k].of[f"b{i}"][j], rel=1e-3, abs=1e-6)
    d.unpersist()


def test_closed_form_without_competitors():
    """Without counts to take away a row becomes its shares of the counts, as far as it is trusted."""
    held, free = training._Sums(PLAIN), training._Sums(PLAIN)
    held.of["a"][0] = [6.0, 3.0, 1.0]
    got = training._pushed(PLAIN, held, free, 1e-9)
    assert got.a[0][0] == pytest.approx([0.6, 0.3, 0.1], abs=1e-6) and (got.a[0][1] == PLAIN.a[0][1]).all()
    assert training._pushed(PLAIN, held, free, 1e12).a[0][0] == pytest.approx(PLAIN.a[0][0], abs=1e-6)
    free.of["a"][0] = [0.0, 9.0, 0.0]
    assert (training._pushed(PLAIN, held, free, 1.01).a[0][0] > 0).all()


@pytest.mark.parametrize("settle", [False, True])
def test_kept_scores_are_those_of_scoring_everything(spark, monkeypatch, settle):
    """Models that didn't change aren't scored again, and the clusters are the same."""
    third = PLAIN.copy()
    third.pi, third.b = np.array([0.0, 0.0, 1.0]), [np.eye(5)[4]] * 3  # has next to no members
    seqs = labelled(spark, 25, 12).select("seq_id", "obs")
    asked = []

    def counting(s, models, classes=None, only=None):
        asked.append(only)
        return decoding.score_all(s, models, classes, only)

    monkeypatch.setattr(training, "score_all", counting)
    models, members = training.cluster(seqs, [PLAIN, OTHER, third], rounds=6, priors=True, settle=settle)
    kept = {r.seq_id: r.model_id for r in members.collect()}
    assert any(only is not None and len(only) < 3 for only in asked)

    def everything(s, models, classes=None, only=None):
        return decoding.score_all(s.drop("scores"), models, classes)

    monkeypatch.setattr(training, "score_all", everything)
    again, members = training.cluster(seqs, [PLAIN, OTHER, third], rounds=6, priors=True, settle=settle)
    assert kept == {r.seq_id: r.model_id for r in members.collect()} and all(training._same(p, q) for p, q in zip(models, again))


def test_the_callers_cache_stays(spark):
    seqs = labelled(spark, 8, 6).persist()
    seqs.count()
    training.baum_welch(seqs, PLAIN, 1)
    training.discriminative(seqs, [PLAIN, OTHER], "own", steps=1)
    training.mixture(seqs, [PLAIN, OTHER], rounds=1)
    training.cluster(seqs, [PLAIN, OTHER], rounds=1)
    assert seqs.storageLevel.useMemory
    seqs.unpersist()
    other = labelled(spark, 8, 7)
    with pytest.raises(Exception):
        training.gradient_search(other, PLAIN, "nothing", steps=1)
    assert not other.storageLevel.useMemory


@pytest.mark.parametrize("kind", ["normal_right", "normal_left"])
def test_tail_moments_are_hit(kind):
    """Over a grid of cuts, the fitted tail has the mean and variance it was given."""
    for z in (-30, -8, -3, -1, -0.2, 0, 0.4, 1, 2.5, 4.9, 5.1, 8, 30, 80):
        for sd in (0.3, 1.0, 40.0):
            d, v = training.tail_moments(z)
            sign = 1 if kind == "normal_right" else -1
            c = Component(kind, 1.0, 0.0, 1.0, lo=2.0, hi=2.0)
            training._fit_tail(c, 2.0 + sign * d * sd, v * sd * sd)
            if v * sd * sd < training.LEAST_VARIANCE:
                continue
            at = sign * (2.0 - c.mean) / math.sqrt(c.var)
            d2, v2 = training.tail_moments(at) if at > training.NEAREST_CUT else (-at, 1.0)
            assert d2 * math.sqrt(c.var) == pytest.approx(d * sd, rel=1e-8) and v2 * c.var == pytest.approx(v * sd * sd, rel=1e-6 if z > 20 else 1e-8)
    x = np.linspace(3.0, 60.0, 2_000_001)
    p = np.exp(-((x - 1.0) ** 2) / 2)
    d, v = training.tail_moments(2.0)
    mean = (x * p).sum() / p.sum()
    assert mean - 3 == pytest.approx(d, rel=1e-4) and ((x - mean) ** 2 * p).sum() / p.sum() == pytest.approx(v, rel=1e-3)


def test_roots():
    assert training.bracketed_root(lambda x: x**3 - 2, 0, 5) == pytest.approx(2 ** (1 / 3), rel=1e-12)
    assert training.bracketed_root(lambda x: math.atan(x - 1e-3), -1e6, 50) == pytest.approx(1e-3, rel=1e-9)
    assert training.bracketed_root(lambda x: math.exp(x) - 1e-200, -1000, 10) == pytest.approx(math.log(1e-200), rel=1e-9)
    assert training.bracketed_root(lambda x: x, 0, 1) == 0
    with pytest.raises(ValueError):
        training.bracketed_root(lambda x: 1.0, 0, 1)


@pytest.mark.parametrize("start", training.STARTS)
def test_mixture_starts(spark, start):
    seqs = labelled(spark, 20, 12).select("seq_id", "obs")
    models, priors, trace = training.mixture(seqs, [PLAIN, OTHER], rounds=4, tolerance=0, start=start, seed=3)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:])) and sum(priors) == pytest.approx(1) and len(trace) == 4
    again = training.mixture(seqs.repartition(3), [PLAIN, OTHER], rounds=4, tolerance=0, start=start, seed=3)
    assert again[2] == pytest.approx(trace)


def test_best_of_several_starts(spark):
    seqs = labelled(spark, 15, 10).select("seq_id", "obs")
    tries = [("models", 0), ("random", 1), ("spread", 2)]
    models, priors, report = training.best_mixture(seqs, [PLAIN, OTHER], tries, rounds=2)
    assert [r[:2] for r in report] == tries
    want = max(report, key=lambda r: r[2])
    assert all(training._same(p, q) for p, q in zip(models, training.mixture(seqs, [PLAIN, OTHER], rounds=2, start=want[0], seed=want[1])[0]))
    with pytest.raises(ValueError, match="starts"):
        training.mixture(seqs, [PLAIN, OTHER], start="nothing")


def plain_logp(model, obs):
    """Unscaled forward sum in exact order: a null item has likelihood 1."""
    alpha = None
    for x in obs:
        e = np.array([1.0 if x is None else (model.b[i][x] if 0 <= x < model.m else 0.0) if isinstance(model, DiscreteHmm) else float(model.density(i, np.array(x))) for i in range(model.n)])
        alpha = (model.pi if alpha is None else alpha @ model.a[0]) * e
    return 0.0 if alpha is None else math.log(alpha.sum()) if alpha.sum() > 0 else -math.inf


def test_outliers_are_possible(spark):
    """Densities depend on the unit: values far out have a likelihood, in the fold and in the Arrow path alike."""
    rows = [(1, [80.0, 900.0, 200.0]), (2, [80.0, None, 420.0]), (3, [1e9, 80.0]), (4, []), (5, None), (6, [900.0, 950.0, 910.0])]
    s = spark.createDataFrame(rows, "seq_id int, obs array<double>")
    arrow = {r.seq_id: r.logp for r in decoding.decode(s, NORMAL, ["logp"]).collect()}
    fold = {r.seq_id: r.l for r in s.select("seq_id", folds.log_likelihood(NORMAL, F.col("obs")).alias("l")).collect()}
    want = {i: None if o is None else plain_logp(NORMAL, o) for i, o in rows}
    assert arrow == pytest.approx(want) and fold == pytest.approx(want) and want[1] == pytest.approx(-52.3, abs=0.1) and want[3] == -math.inf
    trained = training.baum_welch(s.where("seq_id in (1, 2, 6)"), NORMAL, 2, 0)
    assert trained.trace[0] == pytest.approx(want[1] + want[2] + want[6]) and trained.trace[1] > trained.trace[0]


def test_nulls_and_unknown_codes_in_folds(spark):
    rows = [(1, [0, None, 1]), (2, [0, 7, 1]), (3, [None, None]), (4, [-1]), (5, [4, 2])]
    s = spark.createDataFrame(rows, "seq_id int, obs array<int>")
    arrow = {r.seq_id: r.logp for r in decoding.decode(s, PLAIN, ["logp"]).collect()}
    fold = {r.seq_id: r.l for r in s.select("seq_id", folds.log_likelihood(PLAIN, F.col("obs")).alias("l")).collect()}
    want = {i: plain_logp(PLAIN, o) for i, o in rows}
    assert arrow == pytest.approx(want) and fold == pytest.approx(want)
    rare = DiscreteHmm(pi=[1.0], a=[[1.0]], b=[[1 - 1e-9, 1e-9]], alphabet=("x", "y"))
    one = s.where("seq_id = 1").select("seq_id", F.array(F.lit(0), F.lit(1)).alias("obs"))
    assert one.select(folds.log_likelihood(rare, F.col("obs"))).first()[0] == decoding.decode(one, rare, ["logp"]).first().logp == -math.inf
    unknown = spark.createDataFrame([(1, ["click", "what", "view"])], "seq_id int, obs array<string>").select("seq_id", folds.encode(F.col("obs"), PLAIN.alphabet).alias("obs"))
    assert unknown.select(folds.log_likelihood(PLAIN, F.col("obs"))).first()[0] == pytest.approx(decoding.decode(unknown, PLAIN, ["logp"]).first().logp)


def test_classes_must_be_told(spark):
    s = spark.createDataFrame([(1, [0, 1, 2], [0, 1, 0])], "seq_id int, obs array<int>, c array<int>")
    for call in (lambda: decoding.decode(s, SWITCHING, ["logp"]), lambda: decoding.score_all(s, [PLAIN, SWITCHING]), lambda: training.baum_welch(s, SWITCHING), lambda: decoding.trajectory(s, [SWITCHING]), lambda: folds.log_likelihood(SWITCHING, F.col("obs")), lambda: registry.register(spark, "x", SWITCHING)):
        with pytest.raises(ValueError, match="class"):
            call()
    got = decoding.score_all(s, [PLAIN, SWITCHING], "c").first().scores
    assert got[1] == pytest.approx(decoding.decode(s, SWITCHING, ["logp"], classes="c").first().logp) and got[0] == pytest.approx(decoding.decode(s, PLAIN, ["logp"]).first().logp)


def test_table_function(spark):
    registry.register(spark, "tf", PLAIN)
    rows = [(1, [0, 3, 2, 2, None]), (2, None), (3, []), (4, [9]), (5, [4])]
    d = spark.createDataFrame(rows, "seq_id int, obs array<int>")
    d.createOrReplaceTempView("tf_seqs")
    got = spark.sql("SELECT s.seq_id, d.t, d.state, d.label FROM tf_seqs s, LATERAL tf_decode(s.obs) d ORDER BY seq_id, t").collect()
    paths = {r.seq_id: r.path for r in decoding.decode(d, PLAIN, ["path"]).collect()}
    assert [(r.seq_id, r.t, r.state) for r in got] == [(i, t, q) for i in (1, 5) for t, q in enumerate(paths[i])]
    assert [r.label for r in got] == [PLAIN.labels[r.state] for r in got]
    registry.register(spark, "tn", NORMAL)
    assert [r.t for r in spark.sql("SELECT * FROM tn_decode(array(80.0D, 400.0D))").collect()] == [0, 1]


def test_labelled_training(spark):
    """Labels bind states: counts come only from states of the label, and the labelled likelihood rises."""
    s = sampling.sample(spark, PLAIN, 30, 15, seed=8).select("seq_id", "obs", F.transform("states", lambda q: (q > 0).cast("int")).alias("l"))
    got = training.baum_welch(s, PLAIN, 5, 0, restrict="l")
    assert all(b >= a - 1e-9 for a, b in zip(got.trace, got.trace[1:]))
    rows = [(r.obs, r.l) for r in s.collect()]
    moves = {(0, 0): 0, (0, 1): 0}
    for _, lab in rows:
        for p, q in zip(lab, lab[1:]):
            if p == 0:
                moves[0, q] += 1
    # state 0 is the only one of its label, so its row is counted, not estimated
    assert got.model.a[0][0, 0] == pytest.approx(moves[0, 0] / sum(moves.values()))
    first = [o for obs, lab in rows for o, x in zip(obs, lab) if x == 0]
    assert got.model.b[0] == pytest.approx(np.bincount(first, minlength=5) / len(first))


def test_descaled_steps_of_outliers():
    x = np.array([[80.0, 2500.0, 90.0]])
    e = chain.emissions(NORMAL, x)
    alpha, scale, logp = chain.forward(NORMAL, e, np.array([3]))
    beta = chain.backward(NORMAL, e, np.array([3]), scale)
    assert np.isfinite(logp).all() and np.allclose((alpha * beta).sum(2), 1)


def test_gradient_search_counts_are_the_gradient(spark):
    """Counts with the labels less those without are the derivatives of the objective, by finite differences."""
    s = sampling.sample(spark, PLAIN, 12, 8, seed=8).select("seq_id", "obs", F.transform("states", lambda q: (q > 0).cast("int")).alias("l")).persist()

    def both(m):
        return training._gathered([m, m], training.statistics(s, [m, m], restrict="l", held=[True, False]))

    def value(m):
        held, free = both(m)
        return held.of["logp"][0] - free.of["logp"][0]

    held, free = both(PLAIN)
    h = 1e-5
    for name, (i, j) in (("a", (0, 1)), ("a", (2, 0)), ("b1", (0, 3))):
        moved = []
        for sign in (1, -1):
            m = PLAIN.copy()
            row = m.a[0, i] if name == "a" else m.b[1]
            row[j] *= math.exp(sign * h)
            moved.append(value(m))
        want = (held.of[name] - free.of[name])[(i, j) if name == "a" else j]
        assert (moved[0] - moved[1]) / (2 * h) == pytest.approx(want, rel=1e-3, abs=1e-6)
    s.unpersist()
