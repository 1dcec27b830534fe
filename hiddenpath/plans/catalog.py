"""The registered queries over the test tables, and DuckDB SQL that computes the same another way.

Sequences are the events of a user in order of time (``event_type`` as symbols, ``value`` as reals). The SQL recursions are
unscaled products over joined rows; the Spark side folds or scans arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiddenpath.functions import folds, registry
from hiddenpath.model import Component, ContinuousHmm, DiscreteHmm, Hmm
from hiddenpath.operators import decoding, labelling, pairs, sampling, sequences, training

EVENTS = ("click", "error", "purchase", "signup", "view")
_A = [[0.8, 0.15, 0.05], [0.1, 0.7, 0.2], [0.25, 0.05, 0.7]]
_B = [[0.4, 0.1, 0.05, 0.15, 0.3], [0.1, 0.45, 0.2, 0.05, 0.2], [0.05, 0.1, 0.5, 0.3, 0.05]]
PLAIN = DiscreteHmm(pi=[0.6, 0.3, 0.1], a=_A, b=_B, alphabet=EVENTS, labels=["0", "1", "1"])
OTHER = DiscreteHmm(pi=[0.2, 0.5, 0.3], a=[[0.5, 0.3, 0.2], [0.2, 0.6, 0.2], [0.1, 0.3, 0.6]], b=[[0.25, 0.2, 0.2, 0.15, 0.2], [0.1, 0.3, 0.15, 0.35, 0.1], [0.15, 0.1, 0.35, 0.1, 0.3]], alphabet=EVENTS, labels=["0", "1", "1"])
SWITCHING = DiscreteHmm(pi=PLAIN.pi, a=[_A, OTHER.a[0]], b=_B, alphabet=EVENTS)
SILENT = DiscreteHmm(pi=[0.7, 0.3, 0], a=[[0.6, 0.2, 0.2], [0.2, 0.5, 0.3], [0.65, 0.35, 0]], b=[_B[0], _B[1], [0] * 5], alphabet=EVENTS)
_ORDER1 = np.array([[0.3, 0.1, 0.2, 0.15, 0.25], [0.1, 0.35, 0.15, 0.2, 0.2], [0.2, 0.25, 0.3, 0.1, 0.15], [0.15, 0.2, 0.05, 0.4, 0.2], [0.25, 0.1, 0.1, 0.2, 0.35]])
ORDER1 = DiscreteHmm(pi=[0.9, 0.1], a=[[0.6, 0.4], [0.3, 0.7]], b=[_B[0], _ORDER1.reshape(-1)], alphabet=EVENTS)
NORMAL = ContinuousHmm(pi=[0.5, 0.3, 0.2], a=_A, components=[[Component("normal", 1.0, 80.0, 3600.0)], [Component("normal", 1.0, 220.0, 5000.0)], [Component("normal", 1.0, 400.0, 4000.0)]])
MIXED = ContinuousHmm(pi=[0.5, 0.3, 0.2], a=_A, components=[[Component("normal", 0.7, 80.0, 3600.0), Component("normal", 0.3, 150.0, 2500.0)], [Component("normal", 1.0, 220.0, 5000.0)], [Component("normal", 0.6, 400.0, 4000.0), Component("uniform", 0.4, lo=0.0, hi=500.0)]])
_PAIR = pairs.PairHmm(pi=[0.8, 0.1, 0.1], a=[[0.8, 0.1, 0.1], [0.6, 0.35, 0.05], [0.6, 0.05, 0.35]], b=[(np.eye(5) * 0.15 + 0.0125).reshape(-1), [0.2] * 5, [0.2] * 5], steps=[(1, 1), (1, 0), (0, 1)], m=5)
#: Values over 300 are impossible.
BOUNDED = ContinuousHmm(pi=[0.5, 0.5], a=[[0.9, 0.1], [0.2, 0.8]], components=[[Component("uniform", 1.0, lo=0.0, hi=300.0)], [Component("uniform", 1.0, lo=0.0, hi=150.0)]])
#: Order statuses against event types: a status with an event, two statuses at once, an event alone.
_LONG_PAIR = pairs.PairHmm(pi=[0.6, 0.2, 0.2], a=[[0.7, 0.1, 0.2], [0.5, 0.3, 0.2], [0.5, 0.1, 0.4]], b=[(np.outer([0.3, 0.3, 0.4, 0, 0], [0.3, 0.1, 0.2, 0.1, 0.3]) * (1 + 0.5 * np.eye(5)) / (1 + 0.5 * 0.2 * 0.7)).reshape(-1), [0.4, 0.3, 0.3, 0.0, 0.0], [0.3, 0.1, 0.2, 0.1, 0.3]], steps=[(1, 1), (2, 0), (0, 1)], m=5)
#: States that share emissions, a background, tails, two dimensions.
TIED = DiscreteHmm(pi=PLAIN.pi, a=_A, b=_B, alphabet=EVENTS, ties=[[1, 2]])
BACKGROUND = [0.3, 0.1, 0.2, 0.1, 0.3]
TAILS = ContinuousHmm(pi=[0.5, 0.5], a=[[0.7, 0.3], [0.4, 0.6]], components=[[Component("normal_right", 1.0, 60.0, 6400.0, lo=0.0)], [Component("normal_left", 0.6, 300.0, 10000.0, hi=520.0), Component("normal_right", 0.4, 150.0, 2500.0, lo=0.0)]])
BIVARIATE = ContinuousHmm(pi=[0.4, 0.6], a=[[0.8, 0.2], [0.3, 0.7]], components=[[Component("multinormal", 1.0, [80.0, 100.0], [[6000.0, 1500.0], [1500.0, 9000.0]])], [Component("multinormal", 1.0, [250.0, 200.0], [[12000.0, -2000.0], [-2000.0, 15000.0]])]])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event types as codes."""
    s = sequences.build(events(spark, sf_dir), "user_id", ["ts"], "event_type")
    return s.select("seq_id", folds.encode(F.col("obs"), EVENTS).alias("obs"))


def reals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.build(events(spark, sf_dir), "user_id", ["ts"], "value")


def with_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, and for each step whether its value is 250 or more."""
    items = events(spark, sf_dir).select("user_id", "ts", F.struct("event_type", "value").alias("v"))
    s = sequences.build(items, "user_id", ["ts"], "v")
    code = folds.encode(F.transform("obs", lambda r: r["event_type"]), EVENTS)
    return s.select("seq_id", code.alias("obs"), F.transform("obs", lambda r: (r["value"] >= 250).cast("int")).alias("high"))


def _text(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def seq_build(spark, d):
    return symbols(spark, d).select("seq_id", F.size("obs").alias("n"), _text("obs").alias("obs"))


def symbol_counts(spark, d):
    return sequences.to_long(symbols(spark, d)).groupBy(F.col("x").alias("symbol")).agg(F.count("*").alias("n"))


def bigram_counts(spark, d):
    return sequences.transitions_of(symbols(spark, d))


def forward_logp(spark, d):
    """Flagship: log-likelihood of every user's events, a fold inside the JVM."""
    return symbols(spark, d).select("seq_id", F.round(folds.log_likelihood(PLAIN, F.col("obs")), 4).alias("logp"))


def forward_logp_arrow(spark, d):
    return decoding.decode(symbols(spark, d), PLAIN, ["logp"]).select("seq_id", F.round("logp", 4).alias("logp"))


def filtered_states(spark, d):
    f = symbols(spark, d).select("seq_id", folds.filtered(PLAIN, F.col("obs")).alpha.alias("p"))
    return f.select("seq_id", F.posexplode("p").alias("state", "p")).select("seq_id", "state", F.round("p", 6).alias("p"))


def posterior_at(spark, d):
    s = decoding.decode(symbols(spark, d), PLAIN, ["posterior"]).select("seq_id", F.posexplode(F.col("posterior")[10]).alias("state", "p"))
    return s.select("seq_id", "state", F.round("p", 6).alias("p"))


def viterbi_path(spark, d):
    return decoding.decode(symbols(spark, d), PLAIN, ["path", "path_logp"]).select("seq_id", _text("path").alias("path"), F.round("path_logp", 4).alias("logp"))


def viterbi_labels(spark, d):
    return decoding.decode(symbols(spark, d), PLAIN, ["path_labels"]).select("seq_id", F.array_join("path_labels", ",").alias("labels"))


def joint_logp(spark, d):
    s = symbols(spark, d).withColumn("path", F.transform("obs", lambda x: x % 3))
    return s.select("seq_id", F.round(folds.joint_log_likelihood(PLAIN, F.col("obs"), F.col("path")), 4).alias("logp"))


def normal_logp(spark, d):
    return reals(spark, d).select("seq_id", F.round(folds.log_likelihood(NORMAL, F.col("obs")), 4).alias("logp"))


def mixed_logp(spark, d):
    return decoding.decode(reals(spark, d), MIXED, ["logp"]).select("seq_id", F.round("logp", 4).alias("logp"))


def normal_viterbi(spark, d):
    return decoding.decode(reals(spark, d), NORMAL, ["path", "path_logp"]).select("seq_id", _text("path").alias("path"), F.round("path_logp", 4).alias("logp"))


def labelled_logp(spark, d):
    return decoding.decode(with_companions(spark, d), PLAIN, ["logp"], restrict="high").select("seq_id", F.round("logp", 4).alias("logp"))


def switching_logp(spark, d):
    return decoding.decode(with_companions(spark, d), SWITCHING, ["logp"], classes="high").select("seq_id", F.round("logp", 4).alias("logp"))


def switching_viterbi(spark, d):
    return decoding.decode(with_companions(spark, d), SWITCHING, ["path", "path_logp"], classes="high").select("seq_id", _text("path").alias("path"), F.round("path_logp", 4).alias("logp"))


def order1_logp(spark, d):
    return decoding.decode(symbols(spark, d), ORDER1, ["logp"]).select("seq_id", F.round("logp", 4).alias("logp"))


def silent_logp(spark, d):
    return decoding.decode(symbols(spark, d), SILENT, ["logp"]).select("seq_id", F.round("logp", 4).alias("logp"))


def em_step(spark, d):
    """Expected counts of one training step."""
    s = training.statistics(symbols(spark, d), [PLAIN])
    b = F.col("stat").startswith("b")
    return s.where("stat <> 'logp'").select(F.when(b, "b").otherwise(F.col("stat")).alias("stat"), F.when(b, F.substring("stat", 2, 9).cast("int")).otherwise(F.col("i")).alias("i"), "j", F.round("value", 4).alias("value"))


def normal_em_step(spark, d):
    """Means and variances (about the old means) after one training step."""
    s = training.statistics(reals(spark, d), [NORMAL]).where(F.col("stat").startswith("c")).groupBy(F.substring("stat", 2, 9).cast("int").alias("state")).pivot("j", [0, 1, 2]).agg(F.sum("value"))
    return s.select("state", F.round(F.col("1") / F.col("0"), 4).alias("mean"), F.round(F.col("2") / F.col("0"), 3).alias("var"))


def bayes_classify(spark, d):
    return decoding.classify(symbols(spark, d), [PLAIN, OTHER]).select("seq_id", "model_id", F.round("posterior", 6).alias("posterior"))


def class_trajectory(spark, d):
    """Share of the first model after each event."""
    s = decoding.trajectory(symbols(spark, d), [PLAIN, OTHER]).select("seq_id", F.posexplode("posteriors").alias("t", "p"))
    return s.select("seq_id", "t", F.round(F.col("p")[0], 6).alias("p"))


def model_distance(spark, d):
    """Mean difference of the log-likelihoods under two models for each event of all users."""
    return decoding.distance(PLAIN, OTHER, symbols(spark, d)).select(F.round("distance", 6).alias("distance"))


def distance_curve(spark, d):
    """The distance of two models over the first 20, 40, ... events of users."""
    return decoding.distance_curve(PLAIN, OTHER, symbols(spark, d), 20).select("items", "n", F.round("distance", 6).alias("distance"))


def switching_joint_logp(spark, d):
    """Log probability of each user's events and the path of their codes modulo 3, under a model with two classes."""
    s = with_companions(spark, d).withColumn("path", F.transform("obs", lambda x: x % 3))
    return decoding.joint_log_likelihood(s, SWITCHING, "path", "high").select("seq_id", F.round("logp", 4).alias("logp"))


def weighted_logp(spark, d):
    """Log-likelihood of all users' values, weighted by the users' number of events, impossible ones at a penalty."""
    s = reals(spark, d).withColumn("weight", F.size("obs").cast("double"))
    return decoding.total_log_likelihood(s, NORMAL, penalty=-500.0).select(F.round("logp", 1).alias("logp"), "n")


def admissible(spark, d):
    """Whether all events of a user are of the first four kinds."""
    return symbols(spark, d).select("seq_id", folds.admissible(F.col("obs"), 4).alias("ok"))


def best_model(spark, d):
    return decoding.best_model(symbols(spark, d), [PLAIN, OTHER]).select("seq_id", "model_id", F.round("logp", 4).alias("logp"))


def ranked(spark, d):
    """The 20 likeliest users."""
    return symbols(spark, d).select("seq_id", F.round(folds.log_likelihood(PLAIN, F.col("obs")), 4).alias("logp")).orderBy(F.desc("logp"), "seq_id").limit(20)


def set_logp(spark, d):
    return decoding.total_log_likelihood(symbols(spark, d), PLAIN).select(F.round("logp", 2).alias("logp"), "n")


def mixture_logp(spark, d):
    return training.responsibilities(symbols(spark, d), [PLAIN, OTHER], [0.3, 0.7]).agg(F.round(F.sum("ll"), 2).alias("logp"))


def mixture_decode(spark, d):
    m = training.mixture_decode(symbols(spark, d), [PLAIN, OTHER], [0.5, 0.5], 0.3)
    return m.select("seq_id", "model_id", F.round("entropy", 5).alias("entropy"))


def log_odds(spark, d):
    s = symbols(spark, d).withColumn("own", (F.col("seq_id") % 2).cast("int"))
    return decoding.log_odds(s, [PLAIN, OTHER], "own").select("seq_id", F.round("odds", 4).alias("odds"), F.round("gain", 6).alias("gain"))


def confusion(spark, d):
    return decoding.confusion(symbols(spark, d).withColumn("own", (F.col("seq_id") % 2).cast("int")), [PLAIN, OTHER], "own")


def mean_sequence(spark, d):
    return sequences.mean_sequence(reals(spark, d)).select("t", F.round("mean", 4).alias("mean"))


def scatter_matrix(spark, d):
    return sequences.scatter_matrix(reals(spark, d)).select("k", "l", F.round("value", 2).alias("value"))


def scatter_matrix_whole(spark, d):
    """The same as :func:`scatter_matrix`, under its earlier name."""
    return scatter_matrix(spark, d)


def extremes(spark, d):
    return sequences.extremes(symbols(spark, d)).select("n", "longest", "items", "least", "most")


def background_estimate(spark, d):
    return sequences.background_estimate(symbols(spark, d), 5, 1).select("history", "symbol", F.round("p", 8).alias("p"))


def pair_counts(spark, d):
    s = symbols(spark, d)
    y = s.select((F.col("seq_id") - 1).alias("seq_id"), F.col("obs").alias("y"))
    return sequences.pair_counts(s.join(y, "seq_id").select(F.col("obs").alias("x"), "y"))


def pair_counts_whole(spark, d):
    """The same as :func:`pair_counts`, under its earlier name."""
    return pair_counts(spark, d)


def subset(spark, d):
    return sequences.subset(symbols(spark, d), [7, 3, 7]).select("pos", "seq_id", _text("obs").alias("obs"))


def merge(spark, d):
    s = symbols(spark, d)
    return sequences.merge(s, s).groupBy("seq_id").agg(F.count("*").alias("n"), F.sum(F.size("obs")).alias("items"))


def all_words(spark, d):
    return sequences.all_words(spark, 4, 3).select("seq_id", _text("obs").alias("obs"))


def order_statuses(spark, d):
    """Statuses of each customer's orders in order of date."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    return sequences.build(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus").select("seq_id", F.array_join("obs", "").alias("obs"))


def likeliest_labels(spark, d):
    s = labelling.label(symbols(spark, d), PLAIN, 4)
    return s.select("seq_id", F.array_join("labels", "").alias("labels"), F.round("logp", 4).alias("logp"))


def pair_alignment(spark, d):
    """Each user's events aligned with those of the next user."""
    s = symbols(spark, d)
    y = s.select((F.col("seq_id") - 1).alias("seq_id"), F.col("obs").alias("y"))
    both = s.join(y, "seq_id").select(F.col("seq_id").alias("pair_id"), F.col("obs").alias("x"), "y")
    return pairs.align_pairs(both, _PAIR).select("pair_id", _text("path").alias("path"), F.round("logp", 4).alias("logp"))


def pair_scores(spark, d):
    """Log probability of each user's events aligned with those of the next user."""
    s = symbols(spark, d)
    y = s.select((F.col("seq_id") - 1).alias("seq_id"), F.col("obs").alias("y"))
    both = s.join(y, "seq_id").select(F.col("seq_id").alias("pair_id"), F.col("obs").alias("x"), "y")
    return pairs.align_pairs(both, _PAIR, most_cells=8000).select("pair_id", F.round("logp", 4).alias("logp"))


def pair_alignment_linear(spark, d):
    """Statuses of the orders of 100 customers, in order of date, aligned with the events of 15 users, in linear space."""
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("block", F.expr("o_custkey div 100"))
    x = sequences.build(o, "block", ["o_orderdate", "o_orderkey"], "o_orderstatus").select(F.col("seq_id").alias("pair_id"), folds.encode(F.col("obs"), ("F", "O", "P")).alias("x"))
    e = events(spark, d).withColumn("block", F.expr("user_id div 15"))
    y = sequences.build(e, "block", ["ts", "event_id"], "event_type").select(F.col("seq_id").alias("pair_id"), folds.encode(F.col("obs"), EVENTS).alias("y"))
    return pairs.align_pairs(x.join(y, "pair_id"), _LONG_PAIR, most_cells=60_000).select("pair_id", F.size("path").alias("steps"), F.round("logp", 4).alias("logp"))


def decoded_steps(spark, d):
    """The likeliest state of each event, by the table function."""
    registry.register(spark, "events_model", PLAIN)
    return spark.sql("SELECT s.seq_id, p.t, p.state FROM {seqs} s, LATERAL events_model_decode(s.obs) p", seqs=symbols(spark, d))


def outlier_logp(spark, d):
    """Log-likelihood of values of which the largest are moved far out of all states."""
    far = F.transform("obs", lambda x: F.when(x > 480, x + 260).otherwise(x))
    return decoding.decode(reals(spark, d).withColumn("obs", far), NORMAL, ["logp"]).select("seq_id", F.round("logp", 4).alias("logp"))


def penalised_logp(spark, d):
    """Log-likelihood of all users' first values, those over 300 at a penalty."""
    s = reals(spark, d).select("seq_id", F.slice("obs", 1, 1).alias("obs"))
    return decoding.total_log_likelihood(s, BOUNDED, penalty=-50.0).select(F.round("logp", 4).alias("logp"), "n")


def _event_pairs(spark, d):
    s = symbols(spark, d)
    y = s.select((F.col("seq_id") - 1).alias("seq_id"), F.col("obs").alias("y"))
    return s.join(y, "seq_id").select(F.col("seq_id").alias("pair_id"), F.col("obs").alias("x"), "y")


def pair_scores_end(spark, d):
    """:func:`pair_scores` of alignments that end with an item of the first user alone, as a segment."""
    whole = F.struct(F.lit(0).alias("u0"), F.lit(0).alias("v0"), F.size("x").alias("u1"), F.size("y").alias("v1"), F.lit(None).cast("int").alias("before"), F.lit(1).alias("end"))
    return pairs.align_pairs(_event_pairs(spark, d).withColumn("segment", whole), _PAIR, "segment").select("pair_id", F.round("logp", 4).alias("logp"))


def pair_path_logp(spark, d):
    """Log probability of the plain path: items side by side, then what is left of the longer sequence."""
    n, m = F.size("x"), F.size("y")
    path = F.concat(F.array_repeat(F.lit(0), F.least(n, m)), F.array_repeat(F.lit(1), F.greatest(n - m, F.lit(0))), F.array_repeat(F.lit(2), F.greatest(m - n, F.lit(0))))
    return pairs.score_paths(_event_pairs(spark, d).withColumn("path", path), _PAIR, "path").select("pair_id", F.round("logp", 4).alias("logp"))


def step_scales(spark, d):
    """The chance of each event given those before it."""
    s = decoding.decode(symbols(spark, d), PLAIN, ["scale"]).select("seq_id", F.posexplode("scale").alias("t", "scale"))
    return s.select("seq_id", "t", F.round("scale", 8).alias("scale"))


def scaled_betas(spark, d):
    """Backward variables of the first ten events, scaled by the chances of the events behind them."""
    s = decoding.decode(symbols(spark, d), PLAIN, ["beta"]).select("seq_id", F.posexplode("beta").alias("t", "b")).where("t < 10")
    return s.select("seq_id", "t", F.posexplode("b").alias("state", "beta")).select("seq_id", "t", "state", F.round("beta", 6).alias("beta"))


def labelled_em_step(spark, d):
    """Expected counts of one training step where the sign of a value binds the states."""
    s = training.statistics(with_companions(spark, d), [PLAIN], restrict="high")
    b = F.col("stat").startswith("b")
    return s.where("stat <> 'logp'").select(F.when(b, "b").otherwise(F.col("stat")).alias("stat"), F.when(b, F.substring("stat", 2, 9).cast("int")).otherwise(F.col("i")).alias("i"), "j", F.round("value", 3).alias("value"))


def tied_step(spark, d):
    """Emissions after one training step of a model of which two states share them."""
    return _parameters(spark, [training.baum_welch(symbols(spark, d), TIED, 1).model]).where("stat = 'b'")


def background_logp(spark, d):
    """Log-likelihood where a background takes a share of two states' emissions."""
    model = PLAIN.copy()
    model.backgrounds = {"all": np.array(BACKGROUND)}
    return decoding.decode(symbols(spark, d), model.with_background({0: ("all", 0.25), 2: ("all", 0.5)}), ["logp"]).select("seq_id", F.round("logp", 4).alias("logp"))


def class_logp(spark, d):
    """Log-likelihood under the second class of a model with two."""
    return decoding.decode(symbols(spark, d), SWITCHING.of_class(1), ["logp"]).select("seq_id", F.round("logp", 4).alias("logp"))


def duration_logp(spark, d):
    """Log-likelihood where the first state lasts two events at least."""
    return decoding.decode(symbols(spark, d), PLAIN.with_duration(0, 2), ["logp"]).select("seq_id", F.round("logp", 4).alias("logp"))


def tail_logp(spark, d):
    """Log-likelihood of values under normals cut from below and from above."""
    return decoding.decode(reals(spark, d), TAILS, ["logp"]).select("seq_id", F.round("logp", 4).alias("logp"))


def bivariate_logp(spark, d):
    """Log-likelihood of each value together with the one before it, by normals of two dimensions."""
    s = reals(spark, d)
    both = F.transform("obs", lambda x, t: F.array(x, F.when(t > 0, F.get("obs", t - 1)).otherwise(F.lit(0.0))))
    return decoding.decode(s.select("seq_id", both.alias("obs")), BIVARIATE, ["logp"]).select("seq_id", F.round("logp", 4).alias("logp"))


def integer_values(spark, d):
    """Values rounded to whole numbers."""
    return sequences.to_long(sequences.to_integers(reals(spark, d))).groupBy(F.col("x").alias("value")).agg(F.count("*").alias("n"))


def weighted_extremes(spark, d):
    s = symbols(spark, d).withColumn("weight", F.size("obs") / 4)
    return sequences.extremes(s).select("n", "total_weight", "longest")


def registered_logp(spark, d):
    """Scores and path lengths by the SQL functions of a registered model."""
    registry.register(spark, "by_name", PLAIN)
    q = "SELECT seq_id, round(by_name_logp(obs), 4) AS logp, size(by_name_path(obs)) AS steps, round(by_name_posterior(obs)[0][0], 6) AS first FROM {seqs}"
    return spark.sql(q, seqs=symbols(spark, d))


def one_sequence(spark, d):
    """The events of user 11."""
    return sequences.to_long(symbols(spark, d).where("seq_id = 11"))


def _parameters(spark: SparkSession, models: list[Hmm]) -> DataFrame:
    rows = [(k, "pi", 0, j, float(v)) for k, m in enumerate(models) for j, v in enumerate(m.pi)]
    rows += [(k, "a", i, j, float(v)) for k, m in enumerate(models) for (i, j), v in np.ndenumerate(m.a[0])]
    rows += [(k, "b", i, j, float(v)) for k, m in enumerate(models) if isinstance(m, DiscreteHmm) for i, b in enumerate(m.b) for j, v in enumerate(b)]
    return spark.createDataFrame(rows, "model_id int, stat string, i int, j int, value double").withColumn("value", F.round("value", 6))


def baum_welch(spark, d):
    return _parameters(spark, [training.baum_welch(symbols(spark, d), PLAIN, 3).model])


def hard_clusters(spark, d):
    return training.cluster(symbols(spark, d), [PLAIN, OTHER], rounds=3)[1]


def soft_mixture(spark, d):
    return _parameters(spark, training.mixture(symbols(spark, d), [PLAIN, OTHER], rounds=2)[0])


def gradient_search(spark, d):
    return _parameters(spark, [training.gradient_search(with_companions(spark, d), PLAIN, "high", steps=2).model])


def discriminative(spark, d):
    return _parameters(spark, training.discriminative(symbols(spark, d).withColumn("own", (F.col("seq_id") % 2).cast("int")), [PLAIN, OTHER], "own", steps=2)[0])


def discriminative_closed(spark, d):
    return _parameters(spark, training.discriminative(symbols(spark, d).withColumn("own", (F.col("seq_id") % 2).cast("int")), [PLAIN, OTHER], "own", steps=2, closed=True)[0])


def settled_clusters(spark, d):
    """Hard clusters by likelihood and share of members; models whose members stay are left alone."""
    return training.cluster(symbols(spark, d), [PLAIN, OTHER], rounds=3, priors=True, settle=True)[1]


def mixture_starts(spark, d):
    """What a soft mixture reaches in two rounds from several starts."""
    report = training.best_mixture(symbols(spark, d), [PLAIN, OTHER], [("models", 0), ("random", 1), ("hard", 1), ("spread", 1)], rounds=2)[2]
    return spark.createDataFrame(report, "start string, seed int, logp double").withColumn("logp", F.round("logp", 2))


def sampled(spark, d):
    return sampling.sample(spark, PLAIN, 200, 30, seed=3).select("seq_id", _text("obs").alias("obs"), _text("states").alias("states"))


def extended(spark, d):
    return sampling.extend(symbols(spark, d), PLAIN, 5, seed=3).select("seq_id", _text("next").alias("next"))


def gibbs_paths(spark, d):
    return sampling.gibbs(symbols(spark, d), PLAIN, sweeps=2, seed=3)[1].select("seq_id", _text("path").alias("path"))


def gibbs_tuples(spark, d):
    """:func:`gibbs_paths`, drawn by pairs of symbols."""
    return sampling.gibbs(symbols(spark, d), PLAIN, sweeps=2, seed=3, width=2)[1].select("seq_id", _text("path").alias("path"))


def gibbs_runs(spark, d):
    """States of all values, drawn by runs of like values."""
    prior = sampling.NormalPrior(m0=200.0, k0=0.01, a0=1.0, b0=1000.0)
    return sampling.gibbs_runs(reals(spark, d), NORMAL, 60.0, sweeps=2, priors=prior, seed=3)[1].select("seq_id", _text("path").alias("path"))


def gibbs_mixture(spark, d):
    """States of all values under a model with mixtures of two normals in each state."""
    two = ContinuousHmm(pi=NORMAL.pi, a=NORMAL.a, components=[[Component("normal", 0.5, c[0].mean - 30, c[0].var), Component("normal", 0.5, c[0].mean + 30, c[0].var)] for c in NORMAL.components])
    return sampling.gibbs_normal(reals(spark, d), two, sweeps=2, m0=200.0, b0=1000.0, seed=3)[1].select("seq_id", _text("path").alias("path"))


def value_runs(spark, d):
    """Runs of like values with their means and the roots of their squared deviations."""
    s = sampling.compressed(reals(spark, d), 60.0).select("seq_id", F.posexplode(F.arrays_zip("n", "mean", "spread")).alias("run", "r"))
    return s.select("seq_id", "run", F.col("r.n").alias("n"), F.round("r.mean", 6).alias("mean"), F.round(F.sqrt("r.spread"), 5).alias("spread"))


def value_blocks(spark, d):
    return sampling.blocks_of(reals(spark, d), 150.0).select("seq_id", "block", "start", "n", F.round("mean", 8).alias("mean"))


_ALL = (
    seq_build, symbol_counts, bigram_counts, forward_logp, forward_logp_arrow, filtered_states, posterior_at, viterbi_path, viterbi_labels, joint_logp, normal_logp, mixed_logp, normal_viterbi, labelled_logp,
    switching_logp, switching_viterbi, order1_logp, silent_logp, em_step, normal_em_step, bayes_classify, class_trajectory, model_distance, weighted_logp, admissible, best_model, ranked, set_logp, mixture_logp, mixture_decode, log_odds, confusion, mean_sequence, scatter_matrix, scatter_matrix_whole,
    extremes, background_estimate, pair_counts, pair_counts_whole, subset, merge, all_words, order_statuses, likeliest_labels, pair_alignment, baum_welch, hard_clusters, soft_mixture, gradient_search, discriminative, sampled, extended, gibbs_paths, value_blocks,
    pair_scores, pair_alignment_linear, decoded_steps, outlier_logp, penalised_logp, gibbs_tuples, gibbs_runs, gibbs_mixture, value_runs, discriminative_closed, settled_clusters, mixture_starts,
    distance_curve, switching_joint_logp, pair_scores_end, pair_path_logp, step_scales, scaled_betas, labelled_em_step, tied_step, background_logp, class_logp, duration_logp, tail_logp, bivariate_logp, integer_values, weighted_extremes, registered_logp, one_sequence,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
