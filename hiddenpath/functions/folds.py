"""Column expressions: recursions of small models, densities and symbol maps, all inside the JVM.

A fold over an array column carries a struct; the model's numbers are literals of the plan. Meant for models of a few
states (the expression has n squared terms); :mod:`hiddenpath.operators.decoding` does larger ones.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiddenpath.model import EPS, ContinuousHmm, DiscreteHmm


def encode(obs: Column, alphabet: tuple) -> Column:
    """Positions of symbols in ``alphabet``; unknown symbols and nulls become null."""
    return F.transform(obs, lambda x: F.nullif(F.array_position(F.array(*[F.lit(s) for s in alphabet]), x), F.lit(0)).cast("int") - 1)


def decode(obs: Column, alphabet: tuple) -> Column:
    """Symbols at positions; -1 is the gap ``-``, other unknown positions are null."""
    letters = F.array(*[F.lit(s).cast("string") for s in alphabet])
    return F.transform(obs, lambda i: F.when(i == -1, "-").otherwise(F.get(letters, i)))


def admissible(obs: Column, size: int) -> Column:
    """Whether all positions are in 0 to ``size`` - 1."""
    return F.forall(obs, lambda i: F.coalesce((i >= 0) & (i < size), F.lit(False)))


def normal_density(x: Column, mean: float, var: float) -> Column:
    return F.exp(-F.pow(x - mean, 2) / (2 * var)) / math.sqrt(2 * math.pi * var)


def state_density(x: Column, model: ContinuousHmm, state: int) -> Column:
    """Density of a state of normal and uniform components."""
    total: Column = F.lit(0.0)
    for c in model.components[state]:
        if c.kind == "uniform":
            total = total + F.when((x >= c.lo) & (x <= c.hi), c.weight / (c.hi - c.lo)).otherwise(0.0)
        elif c.kind == "normal":
            total = total + c.weight * normal_density(x, c.mean, c.var)
        else:
            raise ValueError(f"{c.kind} has no column form")
    return total


def _likelihoods(model: DiscreteHmm | ContinuousHmm, x: Column) -> list[Column]:
    """As in the Arrow operators: a null item has likelihood 1 in every state, a code outside the alphabet 0."""
    if len(model.a) > 1:
        raise ValueError(f"a model of {len(model.a)} transition classes needs the Arrow operators and a column of classes")
    if isinstance(model, ContinuousHmm):
        return [F.coalesce(state_density(x, model, i), F.lit(1.0)) for i in range(model.n)]
    if model.silent or any(model.order(i) for i in range(model.n)):
        raise ValueError("silent and higher-order states need the Arrow operators")
    tables = [F.array(*[F.lit(float(p) if p >= EPS else 0.0) for p in model.b[i]]) for i in range(model.n)]
    return [F.when(x.isNull(), 1.0).otherwise(F.coalesce(F.get(b, x), F.lit(0.0))) for b in tables]


def filtered(model: DiscreteHmm | ContinuousHmm, obs: Column) -> Column:
    """Struct ``alpha`` (state probabilities after the last observation) and ``logp``; null logp: impossible."""
    zero = F.struct(F.array(*[F.lit(float(p)) for p in model.pi]).alias("alpha"), F.lit(0.0).alias("logp"), F.lit(True).alias("first"))

    least = EPS if isinstance(model, DiscreteHmm) else sys.float_info.min

    def step(acc: Column, x: Column) -> Column:
        e = _likelihoods(model, x)
        moved = [sum((acc.alpha[i] * float(model.a[0][i, j]) for i in range(model.n) if model.a[0][i, j] > 0), F.lit(0.0)) for j in range(model.n)]
        raw = F.array(*[F.when(acc.first, acc.alpha[j]).otherwise(moved[j]) * e[j] for j in range(model.n)])
        # a transform over one element names the unscaled vector, and another its sum, null where that is too small
        total = F.transform(F.array(raw), lambda r: F.struct(r.alias("r"), F.aggregate(r, F.lit(0.0), lambda p, q: p + q).alias("s")))
        named = F.transform(total, lambda v: F.struct(v.r.alias("r"), F.when(v.s >= least, v.s).alias("s")))
        out = F.transform(named, lambda v: F.struct(F.transform(v.r, lambda y: F.try_divide(y, v.s)).alias("alpha"), (acc.logp + F.ln(v.s)).alias("logp"), F.lit(False).alias("first")))
        return out[0]

    return F.aggregate(obs, zero, step)


def log_likelihood(model: DiscreteHmm | ContinuousHmm, obs: Column) -> Column:
    """Forward log-likelihood of an encoded sequence; -Infinity if impossible, null for a null sequence."""
    return F.when(obs.isNotNull(), F.coalesce(filtered(model, obs).logp, F.lit(float("-inf"))))


def joint_log_likelihood(model: DiscreteHmm | ContinuousHmm, obs: Column, path: Column) -> Column:
    """Log probability of a sequence together with a path of as many states."""
    rows = F.array(*[F.array(*[F.lit(float(p)) for p in r]) for r in model.a[0]])
    start = F.array(*[F.lit(float(p)) for p in model.pi])

    def one(o: Column, q: Column, t: Column) -> Column:
        moved = F.when(t == 0, F.get(start, q)).otherwise(F.get(F.get(rows, F.get(path, t - 1)), q))
        return F.ln(moved) + F.ln(F.get(F.array(*_likelihoods(model, o)), q))

    both = F.transform(obs, lambda o, t: one(o, F.get(path, t), t))
    total = F.aggregate(F.transform(both, lambda v: F.coalesce(v, F.lit(float("-inf")))), F.lit(0.0), lambda x, y: x + y)
    return F.when(F.size(obs) == F.size(path), total)


def log_sum_exp(values: Column) -> Column:
    """ln(sum(exp(v))) of an array; -Infinity of an empty one."""
    top = F.array_max(values)
    total = F.aggregate(F.transform(values, lambda v: F.exp(v - top)), F.lit(0.0), lambda x, y: x + y)
    return F.when((F.size(values) == 0) | (top == float("-inf")), float("-inf")).otherwise(top + F.ln(total))


def softmax(values: Column) -> Column:
    total = log_sum_exp(values)
    return F.transform(values, lambda v: F.exp(v - total))


def entropy(p: Column) -> Column:
    """Natural entropy of an array of probabilities."""
    return -F.aggregate(F.transform(p, lambda v: F.when(v > 0, v * F.ln(v)).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)
