"""DataFrame operators on small sequences: nulls, empties, training, sampling, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiddenpath.functions import folds, registry
from hiddenpath.model import DNA, Component, ContinuousHmm, DiscreteHmm, model_of_sequence
from hiddenpath.operators import decoding, sampling, sequences, training
from hiddenpath.plans.catalog import NORMAL, OTHER, PLAIN
from hiddenpath.sources import files

COIN = DiscreteHmm(pi=[0.5, 0.5], a=[[0.9, 0.1], [0.2, 0.8]], b=[[0.9, 0.1], [0.2, 0.8]], alphabet=("h", "t"))


def test_nulls_empties_and_impossible(spark):
    s = spark.createDataFrame([(1, None), (2, []), (3, [0, None, 1]), (4, [0, 7])], "seq_id int, obs array<int>")
    r = {x.seq_id: x for x in decoding.decode(s, COIN, ["logp", "path", "posterior"]).collect()}
    assert r[1].logp is None and r[1].path is None
    assert r[2].logp == 0 and r[2].path == []
    assert math.isfinite(r[3].logp) and len(r[3].path) == 3
    assert r[4].logp == -math.inf and r[4].path == []
    assert decoding.decode(s.where("false"), COIN, ["logp"]).count() == 0


def test_fold_equals_arrow(spark):
    s = sampling.sample(spark, PLAIN, 20, 15, seed=1)
    a = {r.seq_id: r.logp for r in decoding.decode(s, PLAIN, ["logp"]).collect()}
    b = {r.seq_id: r.l for r in s.select("seq_id", folds.log_likelihood(PLAIN, F.col("obs")).alias("l")).collect()}
    assert a == pytest.approx(b)


def test_joint_likelihood_of_the_best_path(spark):
    s = sampling.sample(spark, PLAIN, 10, 12, seed=2).select("seq_id", "obs")
    d = s.join(decoding.decode(s, PLAIN, ["path", "path_logp"]), "seq_id")
    for r in d.select("path_logp", folds.joint_log_likelihood(PLAIN, F.col("obs"), F.col("path")).alias("j")).collect():
        assert r.j == pytest.approx(r.path_logp)


def test_one_label_changes_nothing(spark):
    m = COIN.copy()
    m.labels = ["1", "1"]
    s = sampling.sample(spark, m, 5, 9, seed=2).withColumn("l", F.transform("obs", lambda x: F.lit(1)))
    a = decoding.decode(s, m, ["logp"], restrict="l").orderBy("seq_id").collect()
    assert a == decoding.decode(s, m, ["logp"]).orderBy("seq_id").collect()


def test_training_never_falls_and_ignores_partitions(spark):
    s = sampling.sample(spark, OTHER, 60, 30, seed=4)
    one = training.baum_welch(s.repartition(1), PLAIN, 6, 0)
    many = training.baum_welch(s.repartition(5), PLAIN, 6, 0)
    assert all(b >= a - 1e-9 for a, b in zip(one.trace, one.trace[1:]))
    assert one.trace == pytest.approx(many.trace)
    assert not one.model.normalised().check()


def test_training_recovers_normals(spark):
    true = ContinuousHmm(pi=[0.5, 0.5], a=[[0.9, 0.1], [0.1, 0.9]], components=[[Component("normal", 1, 0.0, 1.0)], [Component("normal", 1, 6.0, 1.0)]])
    start = true.copy()
    start.components = [[Component("normal", 1, 1.5, 2.0)], [Component("normal", 1, 4.0, 2.0)]]
    got = training.baum_welch(sampling.sample(spark, true, 40, 50, seed=5), start, 15).model
    assert got.components[0][0].mean == pytest.approx(0, abs=0.2) and got.components[1][0].mean == pytest.approx(6, abs=0.2)


def test_clusters_and_mixtures_separate(spark):
    x = DiscreteHmm(pi=[1.0], a=[[1.0]], b=[[0.9, 0.1]], alphabet=("h", "t"))
    y = DiscreteHmm(pi=[1.0], a=[[1.0]], b=[[0.2, 0.8]], alphabet=("h", "t"))
    s = sampling.sample(spark, x, 30, 40, 1).unionByName(sampling.sample(spark, y, 30, 40, 2).withColumn("seq_id", F.col("seq_id") + 100)).select("seq_id", "obs")
    a, b = x.copy(), y.copy()
    a.b, b.b = [np.array([0.6, 0.4])], [np.array([0.4, 0.6])]
    models, found = training.cluster(s, [a, b])
    assert {(r.seq_id >= 100, r.model_id) for r in found.collect()} == {(False, 0), (True, 1)}
    assert models[0].b[0][0] == pytest.approx(0.9, abs=0.05)
    _, priors, trace = training.mixture(s, [a, b])
    assert priors[0] == pytest.approx(0.5, abs=0.05) and trace[-1] >= trace[0]
    labelled = s.withColumn("own", (F.col("seq_id") >= 100).cast("int"))
    _, gains = training.discriminative(labelled, [a, b], "own", 3)
    assert gains == sorted(gains)
    assert {(r.label, r.model_id) for r in decoding.confusion(labelled, models, "own").collect()} == {(0, 0), (1, 1)}


def test_gradient_search_climbs(spark):
    m = PLAIN.copy()
    s = sampling.sample(spark, m, 30, 20, seed=6).withColumn("l", F.transform("state_labels", lambda v: v.cast("int")))
    start = OTHER.copy()
    trace = training.gradient_search(s, start, "l", 3).trace
    assert len(trace) > 1 and trace == sorted(trace) and trace[-1] <= 0


def test_gibbs_runs_the_same_on_any_partitioning(spark):
    s = sampling.sample(spark, COIN, 20, 20, seed=7).select("seq_id", "obs")
    (m, paths), (k, _) = (sampling.gibbs(s.repartition(n), COIN, 3, seed=1) for n in (1, 4))
    assert m.pi == pytest.approx(k.pi) and paths.count() == 20
    r = sampling.sample(spark, NORMAL, 20, 20, seed=8).select("seq_id", "obs")
    assert len(sampling.gibbs_normal(r, NORMAL, 2, m0=200.0, b0=100.0)[0].components) == 3


def test_extension_and_distance(spark):
    m = model_of_sequence([0, 1, 2, 3], DNA)
    s = sequences.from_lists(spark, [[0, 1], [3]])
    got = {r.seq_id: r.next for r in sampling.extend(s, m, 2).collect()}
    assert got == {0: [2, 3], 1: None}
    d = decoding.distance(COIN, COIN, sampling.sample(spark, COIN, 5, 10)).first()[0]
    assert d == 0


def test_sequence_sets(spark):
    s = sequences.from_lists(spark, [[3, 1, 4, 1], [5, 0], [2, 6, 5, 3, 5, 0, 2], [7, 7, 7, 1, 0, 2], [4]])
    assert [len(r.obs) for r in sequences.subset(s, [2, 1, 3]).orderBy("pos").collect()] == [7, 2, 6]
    assert tuple(sequences.extremes(s).first()) == (5, 5.0, 7, 20, 0, 7)
    assert sequences.merge(s, s).count() == 10
    a, b = sequences.partition(s, 0.5)
    assert a.count() + b.count() == 5
    assert sequences.from_long(sequences.to_long(s)).orderBy("seq_id").select("obs").collect() == s.select("obs").collect()
    assert [r.obs for r in sequences.truncate(s, -1).collect()] == [[]] * 5
    means = {r.t: r["mean"] for r in sequences.mean_sequence(s).collect()}
    assert means[0] == pytest.approx(21 / 5) and means[6] == pytest.approx(2 / 5)


def test_files_round_trip(spark, tmp_path):
    fasta = tmp_path / "x.fa"
    fasta.write_text(">one\nacg\ntt\n>bad\nacn\n>two\nca\n")
    got = {r.seq_id: r.obs for r in files.read_fasta(spark, str(fasta), DNA).collect()}
    assert got == {"one": [0, 1, 2, 3, 3], "two": [1, 0]}
    files.write_fasta(files.read_fasta(spark, str(fasta), DNA).coalesce(1), str(tmp_path / "out"), DNA, 3)
    assert {r.seq_id: r.obs for r in files.read_fasta(spark, str(tmp_path / "out"), DNA).collect()} == got
    sets = tmp_path / "x.sqd"
    sets.write_text("# remark\nSEQD = {\n O = {\n (1) <2> |3| 1.5, 2.5;\n 4, 5, 6;\n };\n};\nSEQ = { O = { 1, 2; }; };\n")
    rows = files.read_blocks(spark, str(sets)).orderBy("set_id", "pos").collect()
    assert [(r.set_id, r.obs, r.label, r.id, r.weight) for r in rows] == [(0, [1.5, 2.5], 2, 1, 3), (0, [4, 5, 6], None, None, 1), (1, [1, 2], None, None, 1)]
    models = [PLAIN, NORMAL, DiscreteHmm(pi=[1, 0], a=[[0.5, 0.5], [1, 0]], b=[[0.5, 0.5], [0, 0]], alphabet=("h", "t"))]
    for m, back, again in zip(models, files.models_from_xml(files.models_to_xml(models)), files.models_from_json(files.models_to_json(models)), strict=True):
        for x in (back, again):
            assert np.allclose(m.a, x.a) and np.allclose(m.pi, x.pi) and m.labels == x.labels
            assert m.silent == x.silent and type(m) is type(x)


def test_sql_names(spark):
    registry.register(spark, "coin", COIN)
    r = spark.sql("SELECT coin_logp(array(0, 1)) AS l, coin_path(array(0, 1)) AS p, coin_logp(CAST(NULL AS array<int>)) AS z").first()
    assert r.p == [0, 0] or len(r.p) == 2
    assert math.isfinite(r.l) and (r.z is None or math.isnan(r.z))


def test_stream_equals_batch(spark, tmp_path):
    from hiddenpath.streaming.online import online_filter

    rows = [(u, t, (u * 7 + t * t) % 2) for u in range(3) for t in range(8)]
    spark.createDataFrame(rows, "u int, t int, x int").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = online_filter(spark.readStream.schema("u int, t int, x int").parquet(str(tmp_path / "in")), COIN, "u", "t", "x")
    q = stream.writeStream.format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.u: r.logp for r in spark.sql("SELECT u, max_by(logp, t) AS logp FROM online GROUP BY u").collect()}
    s = sequences.build(spark.createDataFrame(rows, "u int, t int, x int"), "u", ["t"], "x")
    assert last == pytest.approx({r.seq_id: r.logp for r in decoding.decode(s, COIN, ["logp"]).collect()})
