"""Model edits and files, the backward side, recursive classes, distances both ways, SQL of training."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiddenpath.functions import chain, registry
from hiddenpath.model import Component, ContinuousHmm, DiscreteHmm, inverse_phi, phi
from hiddenpath.operators import decoding, sampling
from hiddenpath.plans.catalog import NORMAL, ORDER1, OTHER, PLAIN
from hiddenpath.sources import files

TWO = """# two models
SHMM = { cos = 2; M = 2; N = 2; density = 0; prior = 0.25;
  Pi = vector { 0.25, 0.75; };  # start
  A = matrix { 0.5, 0.5; 0.1, 0.9; };
  C = matrix { 0.3, 0.7; 1.0, 0.0; };
  Mue = matrix { 1.0, 2.0; 3.0, 4.0; };
  U = matrix { 0.5, 0.6; 0.7, 0.8; };
  fix_state = vector { 0, 1; };
};
HMM = { M = 3; N = 1; multip = 2; Pi = vector { 1; }; A = matrix { 1; }; B = matrix { 0.2, 0.3, 0.5; }; };
SHMM = { cos = 2; M = 1; N = 1; density = 1; Pi = vector { 1; }; Ak_0 = matrix { 1; }; Ak_1 = matrix { 0.5; }; C = matrix { 1; }; Mue = matrix { 2; }; U = matrix { 4; }; };
"""


def test_models_of_fields(spark, tmp_path):
    (tmp_path / "x.smo").write_text(TWO)
    x, y, again, z = files.read_models(spark, str(tmp_path / "x.smo"))
    assert x.a.shape == (2, 2, 2) and (x.a[0] == x.a[1]).all() and x.prior == 0.25 and x.fixed == {1}
    assert [(c.weight, c.mean, c.var) for c in x.components[0]] == [(0.3, 1, 0.5), (0.7, 2, 0.6)]
    assert y.m == 3 and y.prior is None and (again.b[0] == [0.2, 0.3, 0.5]).all()
    assert z.a[:, 0, 0].tolist() == [1, 0.5] and z.components[0][0].kind == "normal_right"
    with pytest.raises(ValueError, match="lacks"):
        files.models_from_fields("HMM = { M = 3; N = 1; };")


def test_blocks_by_lines(spark, tmp_path):
    (tmp_path / "x.sqd").write_text("# a; remark { with } signs\nSEQ = {\n O = {\n <4> 1, 2 # half; a row\n 3;\n\n (7) |2| 5; 6, 6;\n };\n};\nSEQD = { O = { 0.5, 1\n } };\n")
    rows = files.read_blocks(spark, str(tmp_path / "x.sqd")).orderBy("set_id", "pos").collect()
    assert [(r.set_id, r.pos, r.obs, r.label, r.id, r.weight) for r in rows] == [(0, 0, [1, 2, 3], 4, None, 1), (0, 1, [5], None, 7, 2), (0, 2, [6, 6], None, None, 1), (1, 0, [0.5, 1], None, None, 1)]
    seqs = spark.range(50).select(F.transform(F.sequence(F.lit(0), F.col("id") % 5), lambda i: i + 0.25).alias("obs"), F.col("id").cast("double").alias("id"), F.lit(1.5).alias("weight")).repartition(3)
    files.write_blocks(seqs, str(tmp_path / "out"), reals=True)
    back = files.read_blocks(spark, str(tmp_path / "out"))
    assert sorted((r.id, r.obs, r.weight) for r in back.collect()) == sorted((r.id, r.obs, r.weight) for r in seqs.collect())
    assert back.groupBy("pos").count().agg(F.max("count")).first()[0] <= 3
    files.write_blocks(seqs.where("false"), str(tmp_path / "none"))
    assert files.read_blocks(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("model", [PLAIN, ORDER1, NORMAL])
def test_backward_side_and_scales(model):
    rng = np.random.default_rng(3)
    rows = [[], *[[sampling.walk(rng, model, 1 + k)[0] for k in range(6)][k] for k in range(6)]]
    at = np.cumsum([0, *map(len, rows)])
    for _, n, x in chain.padded(np.array([v for r in rows for v in r], float), at, model.n):
        e = chain.emissions(model, x)
        alpha, scale, logp = chain.forward(model, e, n)
        assert chain.begun(model, e, n, chain.backward(model, e, n, scale), scale) == pytest.approx(logp)
        plain = chain.descaled(alpha, scale)
        for k in range(len(n)):
            assert n[k] == 0 or math.log(plain[k, n[k] - 1].sum()) == pytest.approx(logp[k])


def test_recursive_classes_end_as_classify(spark):
    s = sampling.sample(spark, PLAIN, 20, 9, seed=1).select("seq_id", "obs").unionByName(spark.createDataFrame([(90, None), (91, [])], "seq_id long, obs array<int>"))
    models = [PLAIN, OTHER]
    steps = {r.seq_id: r.posteriors for r in decoding.trajectory(s, models).collect()}
    whole = {r.seq_id: r.posteriors for r in decoding.classify(s.where("size(obs) > 0"), models).collect()}
    assert all(len(steps[k]) == 9 and steps[k][-1] == pytest.approx(p) and sum(steps[k][3]) == pytest.approx(1) for k, p in whole.items())
    assert steps[90] is None and steps[91] == [] and decoding.trajectory(s.where("false"), models).count() == 0
    first = [sum(m.pi[i] * m.b[i][s.first().obs[0]] for i in range(m.n)) for m in models]
    assert steps[0][0][0] == pytest.approx(first[0] / sum(first))


def test_distance_both_ways(spark):
    x, y = (sampling.sample(spark, m, 60, 40, seed=k) for k, m in enumerate((PLAIN, OTHER)))
    r = decoding.distances(PLAIN, OTHER, x, y).first()
    assert r.there == pytest.approx(decoding.distance(PLAIN, OTHER, x).first()[0]) and r.back == pytest.approx(decoding.distance(OTHER, PLAIN, y).first()[0])
    assert r.there > 0 and r.back > 0 and r.distance == pytest.approx((r.there + r.back) / 2)


def test_edits():
    m = PLAIN.with_noise(0.1, 5)
    assert not m.check() and 0 < np.abs(m.a - PLAIN.a).max() < 0.2 and not PLAIN.with_noise(0.0).check()
    d = DiscreteHmm(pi=[1], a=[[1]], b=[[0.5, 0.5]], alphabet=("h", "t"))
    d.set_emission(0, [0.1, 0.9, 0.4, 0.6])
    assert d.order(0) == 1
    with pytest.raises(ValueError):
        d.set_emission(0, [0.2, 0.3, 0.5])
    c = ContinuousHmm(pi=[1], a=[[1]], components=[[Component(weight=0.2), Component(weight=0.2), Component(weight=0.6, fixed=True)]])
    c.set_weight(0, 0, 0.3)
    assert [x.weight for x in c.components[0]] == pytest.approx([0.3, 0.1, 0.6])
    with pytest.raises(ValueError):
        c.set_weight(0, 0, 0.5)


def test_tails_and_quantiles():
    assert [phi(inverse_phi(p)) for p in (1e-9, 0.3, 0.975)] == pytest.approx([1e-9, 0.3, 0.975])
    far = Component("normal_right", mean=0.0, var=1.0, lo=9.0)
    x = np.linspace(9, 12, 30001)
    assert np.trapezoid(far.density(x), x) == pytest.approx(1, abs=1e-4) and far.cumulative(9.2) == pytest.approx(np.trapezoid(far.density(x[:2001]), x[:2001]), abs=1e-4)
    beyond = Component("normal_right", mean=0.0, var=1.0, lo=60.0)
    assert (beyond.density(np.array([59.0, 61.0])) == 0).all() and beyond.cumulative(61.0) == 1
    left = Component("normal_left", mean=0.0, var=1.0, hi=-1.0)
    assert left.cumulative(-1.0) == 1 and left.density(np.array([0.0]))[0] == 0


def test_posteriors_in_sql(spark):
    registry.register(spark, "plain", PLAIN)
    s = sampling.sample(spark, PLAIN, 5, 7, seed=2).select("seq_id", "obs").unionByName(spark.createDataFrame([(90, None), (91, [])], "seq_id long, obs array<int>"))
    s.createOrReplaceTempView("drawn")
    got = {r.seq_id: r.p for r in spark.sql("SELECT seq_id, plain_posterior(obs) AS p FROM drawn").collect()}
    want = {r.seq_id: r.posterior for r in decoding.decode(s, PLAIN, ["posterior"]).collect()}
    assert got[90] is None and got[91] == [] and len(got) == len(want)
    assert all(np.allclose(got[k], want[k]) for k in range(5))
    steps = spark.sql("SELECT seq_id, posexplode(plain_path(obs)) AS (t, state) FROM drawn").count()
    assert steps == 35
