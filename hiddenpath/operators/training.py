"""Training: every iteration is one Spark job that adds up expected counts, and a small update on the driver.

Tasks add the statistics of their own sequences and emit one row per figure; Spark sums them by figure. What
reaches the driver has the size of the models, whatever the number of sequences.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiddenpath.functions import chain
from hiddenpath.functions.folds import entropy, log_sum_exp, softmax
from hiddenpath.model import EPS, ContinuousHmm, DiscreteHmm, Hmm
from hiddenpath.operators.decoding import _pick, known_classes, score_all

MAX_STEPS, TOLERANCE, PENALTY, LEAST_VARIANCE = 500, 1e-4, -500.0, 1e-4
_SCHEMA = "model_id int, stat string, i int, j int, value double"


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` persisted for a while; what the caller has persisted stays so."""
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        yield df
        return
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


class _Sums:
    """Statistics of one model: arrays by name."""

    def __init__(self, model: Hmm) -> None:
        self.model = model
        self.of: dict[str, np.ndarray] = {"pi": np.zeros(model.n), "a": np.zeros((model.n, len(model.a) * model.n)), "logp": np.zeros(3)}
        if isinstance(model, DiscreteHmm):
            self.of |= {f"b{i}": np.zeros(len(model.b[i])) for i in range(model.n)}
        else:
            d = model.dim
            self.of |= {f"c{i}": np.zeros((len(c), 1 + d + d * d)) for i, c in enumerate(model.components)}

    def add(self, x: np.ndarray, n: np.ndarray, w: np.ndarray, classes: np.ndarray | None, mask: np.ndarray | None) -> None:
        m = self.model
        e = chain.emissions(m, x)
        if mask is not None:
            e = e * mask
        alpha, scale, logp = chain.forward(m, e, n, classes)
        ok = np.isfinite(logp) & (n > 0)
        self.of["logp"] += [(w * np.where(np.isfinite(logp), logp, PENALTY)).sum(), w.sum(), (w * ~np.isfinite(logp)).sum()]
        w = np.where(ok, w, 0.0)
        if not w.any():
            return
        beta = chain.backward(m, e, n, scale, classes)
        gamma, trans = chain.expected(m, e, n, alpha, beta, scale, w, classes)
        self.of["pi"] += gamma[:, 0].sum(0)
        self.of["a"] += trans.transpose(1, 0, 2).reshape(m.n, -1)
        inside = np.arange(x.shape[1]) < n[:, None]
        if isinstance(m, DiscreteHmm):
            for i in range(m.n):
                c = chain.codes(m, x, i)
                use = inside & (c >= 0)
                self.of[f"b{i}"] += np.bincount(c[use], gamma[:, :, i][use], len(m.b[i]))
            return
        seen = inside & ~(np.isnan(x) if x.ndim == 2 else np.isnan(x).any(2))
        v = x[seen].reshape(seen.sum(), -1)
        for i in range(m.n):
            total = m.density(i, x[seen])
            for k, c in enumerate(m.components[i]):
                r = gamma[:, :, i][seen] * np.divide(c.weight * c.density(x[seen]), total, out=np.zeros_like(total), where=total > 0)
                off = v - np.atleast_1d(c.mean)
                self.of[f"c{i}"][k] += np.concatenate([[r.sum()], r @ v, ((off * r[:, None]).T @ off).reshape(-1)])


def _collect(batches: Iterator[pa.RecordBatch], models: list[Hmm], weights: str | None, classes: str | None, restrict: str | None, held: list[bool] | None) -> Iterator[pa.RecordBatch]:
    sums = [_Sums(m) for m in models]
    for batch in batches:
        obs = chain.ragged(batch.column("obs"))
        rows = np.diff(obs[1])
        shares = np.ones((len(rows), len(models)))
        if weights:
            w = chain.ragged(batch.column(weights))[0] if pa.types.is_list(batch.column(weights).type) else np.asarray(batch.column(weights).cast(pa.float64()))
            shares = np.broadcast_to(w.reshape(len(rows), -1), shares.shape)
        cls = chain.ragged(batch.column(classes))[0] if classes else None
        lab = chain.ragged(batch.column(restrict))[0] if restrict else None
        for s, w, bound in zip(sums, shares.T, held or [True] * len(sums), strict=True):
            for at, n, x in chain.padded(*obs, s.model.n):
                if not w[at].any():
                    continue
                c = None if cls is None else np.nan_to_num(_pick(cls, obs[1], at, n)).astype(np.int64)
                mask = None if lab is None or not bound else _pick(lab, obs[1], at, n)[:, :, None] == np.array([float(v) for v in s.model.labels])
                s.add(x, n, w[at], c, mask)
    out = [(k, name, i, j, v) for k, s in enumerate(sums) for name, x in s.of.items() for (i, j), v in np.ndenumerate(np.atleast_2d(x)) if v]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["model_id", "stat", "i", "j", "value"])


def statistics(seqs: DataFrame, models: list[Hmm], weights: str | None = None, classes: str | None = None, restrict: str | None = None, held: list[bool] | None = None) -> DataFrame:
    """Expected counts of all sequences: ``model_id, stat, i, j, value``.

    ``weights`` names a column of a weight per sequence, or of an array of a weight per model. Statistics: ``pi`` (j: state),
    ``a`` (i: source, j: class * n + target), ``b<state>`` (j: table entry), ``c<state>`` (i: component, j: responsibility, sums, second moments
    about the old mean), ``logp`` (j 0: log-likelihood, an impossible sequence as PENALTY; 1: weight; 2: impossible weight).
    ``held`` tells the models that the labels of ``restrict`` bind; without it they bind all.
    """
    for m in models:
        known_classes(m, classes is not None)
    names = ["obs", *[c for c in (weights, classes, restrict) if c]]
    parts = seqs.select(*names).mapInArrow(partial(_collect, models=models, weights=weights, classes=classes, restrict=restrict, held=held), _SCHEMA)
    return parts.groupBy("model_id", "stat", "i", "j").agg(F.sum("value").alias("value"))


def _gathered(models: list[Hmm], stats: DataFrame) -> list[_Sums]:
    sums = [_Sums(m) for m in models]
    for k, name, i, j, v in stats.collect():
        x = sums[k].of[name]
        x[(i, j) if x.ndim == 2 else j] = v
    return sums


def _ratio(part: np.ndarray, floor: float = EPS) -> np.ndarray:
    total = part.sum(-1, keepdims=True)
    return np.divide(part, total, out=np.zeros_like(part), where=total >= floor)


def updated(s: _Sums) -> Hmm:
    """The model that maximises the expected log-likelihood under the gathered statistics."""
    m, new = s.model, s.model.copy()
    if not s.of["pi"].any():
        return new
    new.pi = _ratio(s.of["pi"])
    new.a = _ratio(s.of["a"].reshape(m.n, len(m.a), m.n).transpose(1, 0, 2))
    if isinstance(m, DiscreteHmm):
        for i in range(m.n):
            if i not in m.fixed:
                got = s.of[f"b{i}"].reshape(-1, m.m)
                new.b[i] = np.where(got.sum(1, keepdims=True) >= EPS, _ratio(got), m.b[i].reshape(-1, m.m)).reshape(-1)
        return new.tied() if m.ties else new
    for i in range(m.n):
        if i not in m.fixed:
            _update_components(m, new, i, s.of[f"c{i}"])
    return new


def _update_components(m: ContinuousHmm, new: ContinuousHmm, i: int, got: np.ndarray) -> None:
    d, comps = m.dim, new.components[i]
    free = [k for k, c in enumerate(comps) if not c.fixed]
    rest = 1 - sum(c.weight for c in comps if c.fixed)
    total = sum(got[k, 0] for k in free)
    for k in free:
        c, r = comps[k], got[k, 0]
        if total >= EPS:
            c.weight = rest * r / total
        if r < EPS or c.kind == "uniform":
            continue
        second = (got[k, 1 + d :] / r).reshape(d, d)  # about the old mean
        if c.kind == "multinormal":
            c.mean = got[k, 1 : 1 + d] / r
            c.var = _positive(second)
        elif c.kind == "normal":
            c.mean, c.var = float(got[k, 1] / r), max(LEAST_VARIANCE, float(second[0, 0]))
        else:
            _fit_tail(c, float(got[k, 1] / r), float(second[0, 0]) - (float(got[k, 1] / r) - float(m.components[i][k].mean)) ** 2)


def _positive(cov: np.ndarray) -> np.ndarray:
    """The covariance with variances of LEAST_VARIANCE at least; its own values stay where it is positive definite."""
    cov = (cov + cov.T) / 2
    np.fill_diagonal(cov, np.maximum(np.diag(cov), LEAST_VARIANCE))
    try:
        np.linalg.cholesky(cov)
        return cov
    except np.linalg.LinAlgError:
        size, axes = np.linalg.eigh(cov)
        return (axes * np.maximum(size, LEAST_VARIANCE)) @ axes.T


def bracketed_root(f: Callable[[float], float], lo: float, hi: float, tolerance: float = 1e-13, most: int = 200) -> float:
    """A root of ``f`` between two places where its signs differ.

    The next place comes from the inverse parabola through the last three, or the secant through two; where that leaves
    the bracket or shrinks it too slowly, the bracket is halved.
    """
    a, b, fa, fb = lo, hi, f(lo), f(hi)
    if fa == 0 or fb == 0:
        return a if fa == 0 else b
    if (fa > 0) == (fb > 0):
        raise ValueError("the signs at both ends are the same")
    c, fc, wide = a, fa, abs(b - a)
    for _ in range(most):
        if abs(fa) < abs(fb):
            a, b, fa, fb = b, a, fb, fa
        if fb == 0 or abs(b - a) <= tolerance * max(1.0, abs(b)):
            break
        r, s, t = fb / fa, fb / fc, fc / fa  # ratios, as products of small values would vanish
        if fc not in (fa, fb) and 1 not in (r, s, t):
            x = b + s * (t * (r - t) * (c - b) - (1 - r) * (b - a)) / ((t - 1) * (r - 1) * (s - 1))
        else:
            x = b - fb * ((b - a) / (fb - fa)) if fb != fa else b
        inside = min(a, b) < x < max(a, b)
        if not inside or abs(b - a) > 0.5 * wide:
            x = (a + b) / 2
        wide = abs(b - a)
        c, fc, fx = b, fb, f(x)
        if (fx > 0) == (fb > 0):
            b, fb = x, fx
        else:
            a, fa = b, fb
            b, fb = x, fx
    return b


def _excess(z: float) -> float:
    """Hazard of the standard normal at ``z``, less ``z``: a continued fraction far out, where the difference would cancel."""
    if z < 5:
        return math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (0.5 * math.erfc(z / math.sqrt(2))) - z
    x = z
    for k in range(150, 1, -1):
        x = z + k / x
    return 1 / x


def tail_moments(z: float) -> tuple[float, float]:
    """Mean distance from the cut and variance of a standard normal cut at ``z``, above it."""
    d = _excess(z)
    return d, 1 - (d + z) * d


#: Cuts that a fit looks between, in standard deviations: below, a cut no longer shows; above, a tail is exponential.
NEAREST_CUT, FARTHEST_CUT = -38.0, 100.0


def _fit_tail(c, mean: float, var: float) -> None:
    """Location and variance of a truncated normal whose mean and variance are as observed.

    The variance over the squared distance of mean and cut rises with the cut's place, from 0 to the 1 of an exponential
    tail, so one root gives the place and with it both. A ratio that no cut has gets the farthest.
    """
    cut, sign = (c.lo, 1.0) if c.kind == "normal_right" else (c.hi, -1.0)
    far = sign * (mean - cut)
    if far <= 0 or var <= 0:
        return  # all at the cut
    ratio = var / far**2

    def miss(z: float) -> float:
        d, v = tail_moments(z)
        return math.log(v) - 2 * math.log(d) - math.log(ratio)

    z = -1 / math.sqrt(ratio) if miss(NEAREST_CUT) >= 0 else FARTHEST_CUT if miss(FARTHEST_CUT) <= 0 else bracketed_root(miss, NEAREST_CUT, FARTHEST_CUT)
    sd = far / _excess(z) if z > NEAREST_CUT else math.sqrt(var)
    c.mean, c.var = cut - sign * z * sd, max(LEAST_VARIANCE, sd * sd)


@dataclass
class Trained:
    model: Hmm
    #: Log-likelihood before each update.
    trace: list[float]


def baum_welch(seqs: DataFrame, model: Hmm, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE, weights: str | None = None, classes: str | None = None, restrict: str | None = None) -> Trained:
    """Maximum-likelihood training of a discrete or continuous model, from ``obs`` of ``seqs``.

    Stops when the gain is under ``tolerance`` times the log-likelihood, or after ``max_steps`` updates. Impossible sequences
    count PENALTY and give no counts. ``restrict`` trains on labelled positions. No sequences: the model as it is.
    """
    if model.silent:
        raise ValueError("models with silent states can't be trained")
    known_classes(model, classes is not None)
    trace: list[float] = []
    with kept(seqs):
        for _ in range(max_steps):
            s = _gathered([model], statistics(seqs, [model], weights, classes, restrict))[0]
            if not s.of["logp"][1]:
                break
            trace.append(float(s.of["logp"][0]))
            model = updated(s)
            if len(trace) > 1 and abs(trace[-1] - trace[-2]) < abs(tolerance * trace[-1]):
                break
    return Trained(model, trace)


def _same(x: Hmm, y: Hmm) -> bool:
    """Whether two models of one structure have equal parameters."""
    if not (np.array_equal(x.pi, y.pi) and np.array_equal(x.a, y.a)):
        return False
    if isinstance(x, DiscreteHmm):
        return all(np.array_equal(p, q) for p, q in zip(x.b, y.b, strict=True))
    pairs = [(p, q) for i, j in zip(x.components, y.components, strict=True) for p, q in zip(i, j, strict=True)]
    return all(p.weight == q.weight and np.array_equal(p.mean, q.mean) and np.array_equal(p.var, q.var) for p, q in pairs)


def cluster(seqs: DataFrame, models: list[Hmm], rounds: int = 20, inner: int = 1, priors: bool = False, settle: bool = False) -> tuple[list[Hmm], DataFrame]:
    """Hard clustering: each sequence to its best model, and models retrained on their members, until no one moves.

    Best is the likeliest, or with ``priors`` the one of the largest log-likelihood plus log prior, the share of members. The scores of
    all models are kept; a round computes those again whose models changed. One job adds up all statistics. With ``settle``, a
    model whose members are those of the round before is left as it is, so late rounds touch few models; without, all
    are trained on. Returns the models and ``seq_id, model_id``. A sequence
    that no model can emit goes to seq_id's hash modulo the models. A model without members stays as it is.
    """
    models = [m.copy() for m in models]
    before: dict | None = None
    scored = score_all(seqs.select("seq_id", "obs"), models).persist()
    try:
        for turn in range(rounds):
            # assigned once: the counts and the statistics read what is kept
            with kept(_assigned(scored, models, priors)) as assigned:
                now = {r["model_id"]: (r["n"], r["h"]) for r in assigned.groupBy("model_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64("seq_id").cast("decimal(38,0)")).alias("h")).collect()}
                if now == before:
                    break
                dirty = [k for k in range(len(models)) if k in now and not (settle and before is not None and before.get(k) == now[k])]
                before = now
                hot = assigned.where(F.col("model_id").isin(dirty)).withColumn("_w", F.array(*[(F.col("model_id") == k).cast("double") for k in dirty]))
                old = list(models)
                for _ in range(inner if dirty else 0):
                    # members stay as they were assigned while models are refined
                    for k, s in zip(dirty, _gathered([models[k] for k in dirty], statistics(hot, [models[k] for k in dirty], "_w")), strict=True):
                        models[k] = updated(s)
            total = sum(n for n, _ in now.values())
            for k, m in enumerate(models):
                m.prior = now.get(k, (0, 0))[0] / total
            changed = [k for k in range(len(models)) if not _same(old[k], models[k])]
            if changed:
                scored, last = score_all(scored, models, only=changed).persist(), scored
                scored.count()
                last.unpersist()
    finally:
        scored.unpersist()
    return models, _assigned(score_all(seqs.select("seq_id", "obs"), models), models, priors).select("seq_id", "model_id")


def _assigned(scored: DataFrame, models: list[Hmm], priors: bool) -> DataFrame:
    shift = F.array(*[F.lit(float(np.log(m.prior)) if priors and m.prior else 0.0) for m in models])
    s = scored.withColumn("s", F.transform("scores", lambda v, k: v + F.get(shift, k)))
    best = F.when(F.array_max("s") == float("-inf"), F.pmod(F.xxhash64("seq_id"), F.lit(len(models))).cast("int")).otherwise(F.array_position("s", F.array_max("s")).cast("int") - 1)
    return s.select("seq_id", "obs", best.alias("model_id"))


def responsibilities(seqs: DataFrame, models: list[Hmm], priors: list[float]) -> DataFrame:
    """``seq_id, obs, p`` (share of each model) and ``ll`` (log-likelihood under the mixture)."""
    shift = F.array(*[F.lit(float(np.log(p)) if p > 0 else float("-inf")) for p in priors])
    s = score_all(seqs.select("seq_id", "obs"), models).withColumn("j", F.transform("scores", lambda v, k: v + F.get(shift, k)))
    return s.select("seq_id", "obs", F.when(F.array_max("j") == float("-inf"), F.transform("j", lambda v: F.lit(0.0))).otherwise(softmax(F.col("j"))).alias("p"), log_sum_exp(F.col("j")).alias("ll"))


def mixture(seqs: DataFrame, models: list[Hmm], priors: list[float] | None = None, rounds: int = 75, tolerance: float = 1e-3, inner: int = 1, start: str = "models", seed: int = 0) -> tuple[list[Hmm], list[float], list[float]]:
    """Soft mixture of models by EM: models, priors and the log-likelihood before each round.

    ``start``: ``models`` takes them as they are; ``random`` trains them a step on random shares, ``hard`` on the sequences
    that each is likeliest for, ``spread`` each on one sequence, chosen with the chance of its distance from those chosen before.
    Choices depend on ``seed`` and ids alone.
    """
    priors = priors or [1 / len(models)] * len(models)
    trace: list[float] = []
    with kept(seqs):
        models = _started(seqs, models, priors, start, seed)
        for _ in range(rounds):
            with kept(responsibilities(seqs, models, priors)) as shares:
                for _ in range(inner):
                    # the shares keep the models they were computed with
                    sums = _gathered(models, statistics(shares, models, "p"))
                    models = [updated(s) for s in sums]
                fit = shares.agg(F.sum(F.when(F.col("ll") > float("-inf"), F.col("ll")).otherwise(PENALTY)), F.count("*")).first()
            if not fit[1]:
                break
            trace.append(fit[0])
            weight = np.array([s.of["logp"][1] for s in sums])
            priors = (weight / max(weight.sum(), EPS)).tolist()
            if len(trace) > 1 and abs(trace[-1] - trace[-2]) <= tolerance * abs(trace[-2]):
                break
    return models, priors, trace


STARTS = ("models", "random", "hard", "spread")


def _uniform(seed: int, *more: int) -> Column:
    """A number over 0 and up to 1 for each sequence, by a hash of its id."""
    return (F.pmod(F.xxhash64("seq_id", *[F.lit(k) for k in (seed, *more)]), F.lit(1 << 40)) + 1) / float(1 << 40)


def _started(seqs: DataFrame, models: list[Hmm], priors: list[float], start: str, seed: int) -> list[Hmm]:
    if start not in STARTS:
        raise ValueError(f"a mixture starts by one of {', '.join(STARTS)}")
    count = len(models)
    if start == "models":
        return models
    if start == "spread":
        out: list[Hmm] = []
        for k in range(count):
            known = score_all(seqs.select("seq_id", "obs"), out) if out else seqs.select("seq_id", "obs")
            # how badly the chosen ones explain an item; the smallest of -ln(u) / distance is a draw with the chances of the distances
            per_item = F.array_max("scores") / F.greatest(F.size("obs"), F.lit(1)) if out else F.lit(-1.0)
            far = F.when(per_item == float("-inf"), -PENALTY).otherwise(F.greatest(-per_item, F.lit(EPS)))
            drawn = known.where("size(obs) > 0").select("seq_id", "obs", (-F.ln(_uniform(seed, k)) / far).alias("key")).orderBy("key", "seq_id").limit(1)
            out += [updated(s) for s in _gathered([models[k]], statistics(drawn, [models[k]]))]
        return out
    if start == "random":
        raw = F.array(*[-F.ln(_uniform(seed, k)) for k in range(count)])  # scaled, they are uniform over all shares
        total = F.aggregate("p", F.lit(0.0), lambda x, y: x + y)
        shares = seqs.select("seq_id", "obs", raw.alias("p")).select("obs", F.transform("p", lambda v: v / total).alias("p"))
    else:
        shift = F.array(*[F.lit(float(np.log(p)) if p > 0 else float("-inf")) for p in priors])
        j = score_all(seqs.select("seq_id", "obs"), models).select("obs", F.transform("scores", lambda v, k: v + F.get(shift, k)).alias("j"))
        best = F.array_position("j", F.array_max("j")) - 1
        shares = j.select("obs", F.array(*[(best == k).cast("double") for k in range(count)]).alias("p"))
    return [updated(s) for s in _gathered(models, statistics(shares, models, "p"))]


def best_mixture(seqs: DataFrame, models: list[Hmm], tries: list[tuple[str, int]], **how) -> tuple[list[Hmm], list[float], list[tuple[str, int, float]]]:
    """The best of several starts ``(start, seed)``: its models and priors, and each try's last log-likelihood."""
    best, report = None, []
    with kept(seqs):
        for start, seed in tries:
            got = mixture(seqs, models, start=start, seed=seed, **how)
            report.append((start, seed, got[2][-1] if got[2] else float("-inf")))
            if best is None or report[-1][2] > best[0]:
                best = (report[-1][2], got)
    return best[1][0], best[1][1], report


def mixture_decode(seqs: DataFrame, models: list[Hmm], priors: list[float], most_entropy: float) -> DataFrame:
    """``seq_id, model_id, entropy``: the likeliest model, null where the shares' entropy is over the bound."""
    s = responsibilities(seqs, models, priors).select("seq_id", "p", entropy(F.col("p")).alias("entropy"))
    return s.select("seq_id", F.when(F.col("entropy") <= most_entropy, F.array_position("p", F.array_max("p")).cast("int") - 1).alias("model_id"), "entropy")


def _blend(old: Hmm, free: _Sums, held: _Sums, rate: float) -> Hmm:
    """Parameters moved along the difference of two expected counts, kept positive where they were, rows scaled."""
    new = old.copy()
    span = max(1.0, float(sum(np.abs(x).sum() for name, x in held.of.items() if name[0] == "a")))

    def moved(p: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        out = np.where(p > 0, np.maximum(p * np.exp(rate * (up - down) / span / np.maximum(p, 1e-3)), 1e-12), 0.0)
        return out * np.divide(p.sum(-1, keepdims=True), out.sum(-1, keepdims=True), out=np.zeros_like(out.sum(-1, keepdims=True)), where=out.sum(-1, keepdims=True) > 0)

    n = old.n
    new.pi = moved(old.pi, held.of["pi"], free.of["pi"])
    new.a = moved(old.a, *(x.of["a"].reshape(n, len(old.a), n).transpose(1, 0, 2) for x in (held, free)))
    if isinstance(old, DiscreteHmm):
        for i in range(n):
            if i not in old.fixed:
                new.b[i] = moved(old.b[i].reshape(-1, old.m), held.of[f"b{i}"].reshape(-1, old.m), free.of[f"b{i}"].reshape(-1, old.m)).reshape(-1)
    return new


def _pushed(old: Hmm, held: _Sums, free: _Sums, damping: float) -> Hmm:
    """Parameters that solve each row's linear system of weighted counts, held less free, with a bound of trust.

    A row becomes (held - free + D * row) / (sum(held - free) + D). D is ``damping`` times the least that keeps every entry and the
    denominator positive: without competitors it is the closed form of maximum likelihood, a large D stays near the old row.
    """
    new = old.copy()

    def solved(p: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        gain = np.where(p > 0, up - down, 0.0)
        least = np.max(np.where(p > 0, -gain / np.where(p > 0, p, 1.0), 0.0), -1, keepdims=True)
        bound = damping * np.maximum(np.maximum(least, -gain.sum(-1, keepdims=True)), 1e-9 + 1e-3 * np.abs(gain).sum(-1, keepdims=True))
        return np.where(gain.any(-1, keepdims=True), (gain + bound * p) / (gain.sum(-1, keepdims=True) + bound), p)

    n = old.n
    new.pi = solved(old.pi, held.of["pi"], free.of["pi"])
    new.a = solved(old.a, *(x.of["a"].reshape(n, len(old.a), n).transpose(1, 0, 2) for x in (held, free)))
    if isinstance(old, DiscreteHmm):
        for i in range(n):
            if i not in old.fixed:
                new.b[i] = solved(old.b[i].reshape(-1, old.m), held.of[f"b{i}"].reshape(-1, old.m), free.of[f"b{i}"].reshape(-1, old.m)).reshape(-1)
    return new


def gradient_search(seqs: DataFrame, model: DiscreteHmm, labels: str, steps: int = 20, rate: float = 1.0) -> Trained:
    """Conditional likelihood of labellings: climbs sum(labelled logp - logp) over all sequences at once.

    The gradient is the difference of expected counts with and without the labels, added up in one pass. A step that lowers the sum is
    taken back and the rate halved; a gain raises it a little. The trace never falls.
    """
    def both(m: DiscreteHmm) -> tuple[_Sums, _Sums, float]:
        held, free = _gathered([m, m], statistics(seqs, [m, m], restrict=labels, held=[True, False]))
        return held, free, float(held.of["logp"][0] - free.of["logp"][0])

    with kept(seqs):
        held, free, value = both(model)
        trace = [value]
        for _ in range(steps):
            new = _blend(model, free, held, rate)
            h, f, v = both(new)
            if v > value:
                gain, model, held, free, value, rate = v - value, new, h, f, v, rate * 1.2
                trace.append(v)
                if gain < TOLERANCE * abs(v):
                    break
            else:
                rate /= 2
                if rate < 1e-4:
                    break
    return Trained(model, trace)


def _discriminated(seqs: DataFrame, models: list[Hmm], label: str) -> DataFrame:
    """``obs``, ``s`` (the logistic log odds of the own model) and ``w``: the slope s (1 - s) for the own model, then the
    competitors' shares of it; a number for each model twice over."""
    shift = F.array(*[F.lit(float(np.log(1 / len(models) if not m.prior else m.prior))) for m in models])
    j = score_all(seqs.select("obs", F.col(label).alias("_own")), models).withColumn("j", F.transform("scores", lambda v, k: v + F.get(shift, k)))
    j = j.withColumn("rest", log_sum_exp(F.filter(F.transform("j", lambda v, k: F.when(k != F.col("_own"), v)), lambda v: v.isNotNull())))
    j = j.withColumn("s", 1 / (1 + F.exp(F.col("rest") - F.get("j", F.col("_own")))))
    slope = F.col("s") * (1 - F.col("s"))
    own = F.transform("j", lambda v, k: F.when(k == F.col("_own"), slope).otherwise(0.0))
    other = F.transform("j", lambda v, k: F.when(k != F.col("_own"), slope * F.exp(v - F.col("rest"))).otherwise(0.0))
    return j.select("obs", "s", F.concat(own, other).alias("w"))


def discriminative(seqs: DataFrame, models: list[Hmm], label: str, steps: int = 10, rate: float = 1.0, closed: bool = False) -> tuple[list[Hmm], list[float]]:
    """Models trained to tell their own sequences from the others': climbs the sum of the logistic log odds.

    ``label`` names the column with the own model's number. A step scores all sequences once, and adds up the counts of own sequences with
    the weight s (1 - s) and of the others with the competitors' share of it in one pass over what it kept. ``closed`` takes
    the solution of each row's linear system of those counts (discrete models) instead of a step along the gradient; a step that
    doesn't gain is taken back, and trusted less. The trace never falls.
    """
    if closed and not all(isinstance(m, DiscreteHmm) for m in models):
        raise ValueError("the closed form is for discrete models")
    count, damping = len(models), 2.0
    with kept(seqs):
        now = _discriminated(seqs, models, label).persist()
        try:
            value = now.agg(F.sum("s")).first()[0] or 0.0
            trace, counts = [value], None
            for _ in range(steps):
                if counts is None:
                    counts = _gathered([*models, *models], statistics(now, [*models, *models], "w"))
                up, down = counts[:count], counts[count:]
                new = [_pushed(m, u, d, damping) if closed else _blend(m, d, u, rate) for m, u, d in zip(models, up, down, strict=True)]
                tried = _discriminated(seqs, new, label).persist()
                v = tried.agg(F.sum("s")).first()[0] or 0.0
                if v > value:
                    now.unpersist()
                    models, now, value, counts, rate, damping = new, tried, v, None, rate * 1.2, max(2.0, damping / 2)
                    trace.append(v)
                else:
                    tried.unpersist()
                    rate, damping = rate / 2, damping * 4
                    if rate < 1e-3 or damping > 1e6:
                        break
        finally:
            now.unpersist()
    return models, trace
