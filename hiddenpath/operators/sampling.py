"""Sampling: sequences from models, continuations, and Gibbs draws of paths and parameters.

Randomness is keyed by seed and sequence, so results don't depend on how rows are spread over tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hiddenpath.functions import chain
from hiddenpath.model import EPS, Component, ContinuousHmm, DiscreteHmm, Hmm
from hiddenpath.operators.decoding import _pick, _whole, known_classes
from hiddenpath.operators.training import kept

#: The class of the step after some emissions.
Rule = Callable[[list], int]


def generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([k % 2**63 for k in key])))


def key_of(value: object, content: bytes) -> int:
    """The key of a row: a whole number itself, a hash of another id, and of a row without id its content's."""
    if isinstance(value, int):
        return value
    return int.from_bytes(hashlib.blake2b(content if value is None else str(value).encode(), digest_size=8).digest(), "little")


def _keys(batch: pa.RecordBatch, values: np.ndarray, at: np.ndarray) -> list[int]:
    return [key_of(v, b"" if v is not None else values[a:b].tobytes()) for v, a, b in zip(batch.column("seq_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _chosen(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One index for each row of unscaled chances ``p``, by the uniform ``u``."""
    total = np.cumsum(p, 1)
    return np.minimum((total <= (u * total[:, -1])[:, None]).sum(1), p.shape[1] - 1)


def _uniforms(rows: list[int], n: np.ndarray, *key: int) -> np.ndarray:
    """Row keys to uniforms, as many as steps."""
    out = np.zeros((len(rows), int(n[0]) if len(n) else 0))
    for k, r in enumerate(rows):
        out[k, : n[k]] = generator(*key, r).random(int(n[k]))
    return out


def _pick_one(rng: np.random.Generator, p: np.ndarray) -> int:
    return int(min(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), "right"), len(p) - 1))


def _emit(rng: np.random.Generator, model: Hmm, state: int, past: list) -> float | int | list:
    if isinstance(model, DiscreteHmm):
        order = model.order(state)
        back = past[len(past) - order :] if order else []
        row = 0
        for s in back:
            row = row * model.m + int(s)
        return _pick_one(rng, model.b[state][row * model.m : (row + 1) * model.m])
    c: Component = model.components[state][_pick_one(rng, np.array([c.weight for c in model.components[state]]))]
    if c.kind == "uniform":
        return float(rng.uniform(c.lo, c.hi))
    if c.kind == "multinormal":
        return (np.asarray(c.mean) + np.linalg.cholesky(np.asarray(c.var)) @ rng.standard_normal(len(c.mean))).tolist()
    sd = math.sqrt(c.var)
    if c.kind == "normal":
        return float(rng.normal(c.mean, sd))
    while True:  # a tail: draw until inside, in steps of many
        x = rng.normal(c.mean, sd, 64)
        x = x[x >= c.lo] if c.kind == "normal_right" else x[x <= c.hi]
        if len(x):
            return float(x[0])


def walk(rng: np.random.Generator, model: Hmm, length: int, start: np.ndarray | None = None, past: list | None = None, rule: Rule | None = None) -> tuple[list, list[int]]:
    """``length`` emissions and the states passed, silent ones too; shorter where the model ends. ``rule`` gives the
    class of the step after the emissions so far, those of ``past`` included."""
    known_classes(model, rule is not None, "a rule")
    silent = set(model.silent)
    usable = np.array([not isinstance(model, DiscreteHmm) or i in silent or model.order(i) == 0 for i in range(model.n)])
    obs, states, p = list(past or []), [], model.pi if start is None else start
    base = len(obs)
    while len(obs) < base + length:
        ready = np.where(usable | np.array([i in silent or not isinstance(model, DiscreteHmm) or model.order(i) <= len(obs) for i in range(model.n)]), p, 0)
        if not ready.sum() > 0:
            break
        state = _pick_one(rng, ready)
        states.append(state)
        if state not in silent:
            obs.append(_emit(rng, model, state, obs))
        p = model.a[rule(obs) if rule and obs else 0][state]
    return obs[base:], states


def walks(model: DiscreteHmm, rngs: list[np.random.Generator], length: int) -> list[tuple[list, list[int]]]:
    """What :func:`walk` gives for each generator, all rows side by side; for models of order 0 without silent states."""
    u = np.array([rng.random(2 * length) for rng in rngs]).reshape(len(rngs), length, 2)
    table, chance = np.stack(model.b), np.tile(model.pi, (len(rngs), 1))
    obs, states = (np.zeros((len(rngs), length), np.int32) for _ in range(2))
    count, going = np.zeros(len(rngs), np.int64), np.ones(len(rngs), bool)
    for t in range(length):
        going = going & (chance.sum(1) > 0)
        if not going.any():
            break
        states[going, t] = _chosen(chance[going], u[going, t, 0])
        obs[going, t] = _chosen(table[states[going, t]], u[going, t, 1])
        count[going] = t + 1
        chance = model.a[0][states[:, t]]
    return [(o[:n].tolist(), s[:n].tolist()) for o, s, n in zip(obs, states, count, strict=True)]


#: Uniforms that a block of side-by-side walks holds.
WALK_CELLS = 2_000_000


def _sample(batches: Iterator[pa.RecordBatch], model: Hmm, length: int, seed: int, kind: pa.DataType, rule: Rule | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_pylist()
        if rule is None and isinstance(model, DiscreteHmm) and not model.silent and not any(model.order(i) for i in range(model.n)):
            rows = max(1, WALK_CELLS // max(2 * length, 1))
            got = [x for k in range(0, len(ids), rows) for x in walks(model, [generator(seed, i) for i in ids[k : k + rows]], length)]
        else:
            got = [walk(generator(seed, i), model, length, rule=rule) for i in ids]
        labels = [[str(model.labels[q]) for q in s] if model.labels else None for _, s in got]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([o for o, _ in got], pa.list_(kind)), pa.array([s for _, s in got], pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.string()))], names=["seq_id", "obs", "states", "state_labels"])


def sample(spark: SparkSession, model: Hmm, count: int, length: int, seed: int = 0, rule: Rule | None = None) -> DataFrame:
    """``count`` sequences of ``length`` emissions: ``seq_id, obs, states, state_labels`` (null without labels).

    A model with several transition classes needs a ``rule`` from the emissions so far to the class of the next step.
    """
    known_classes(model, rule is not None, "a rule")
    kind, sql = (pa.int32(), "int") if isinstance(model, DiscreteHmm) else (pa.float64(), "double") if model.dim == 1 else (pa.list_(pa.float64()), "array<double>")
    return spark.range(count).mapInArrow(partial(_sample, model=model, length=length, seed=seed, kind=kind, rule=rule), f"seq_id long, obs array<{sql}>, states array<int>, state_labels array<string>")


def _extend(batches: Iterator[pa.RecordBatch], model: Hmm, length: int, seed: int, kind: pa.DataType, rule: Rule | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        obs = chain.ragged(batch.column("obs"))
        more: list = [None] * batch.num_rows
        keys, raw = _keys(batch, *obs), batch.column("obs").to_pylist()
        for at, n, x in chain.padded(*obs, model.n):
            c = None
            if rule:
                c = np.zeros(x.shape[:2], np.int64)
                for k, r in enumerate(at.tolist()):
                    seen: list = []
                    for t, item in enumerate(raw[r] or []):
                        seen.append(item)
                        c[k, t] = rule(seen)
            alpha, _, logp = chain.forward(model, chain.emissions(model, x), n, c)
            for k, r in enumerate(at.tolist()):
                if raw[r] is not None and np.isfinite(logp[k]):
                    start = model.pi if not n[k] else alpha[k, n[k] - 1] @ model.a[0 if c is None else c[k, n[k] - 1]]
                    more[r] = walk(generator(seed, keys[r]), model, length, start, raw[r], rule)[0]
        yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array(more, pa.list_(kind))], names=["seq_id", "next"])


def extend(seqs: DataFrame, model: Hmm, length: int, seed: int = 0, rule: Rule | None = None) -> DataFrame:
    """``seq_id, next``: ``length`` further items sampled given each sequence; null where the model can't emit it.

    Ids may be numbers or texts; rows without id are drawn by their content, wherever they are.

    ``rule`` as in :func:`sample`; it gives the classes inside the sequence too.
    """
    known_classes(model, rule is not None, "a rule")
    kind, sql = (pa.int32(), "int") if isinstance(model, DiscreteHmm) else (pa.float64(), "double")
    name = seqs.schema["seq_id"].dataType.simpleString()
    return seqs.select("seq_id", "obs").mapInArrow(partial(_extend, model=model, length=length, seed=seed, kind=kind, rule=rule), f"seq_id {name}, next array<{sql}>")


def _backward_draws(alpha: np.ndarray, a: np.ndarray, n: np.ndarray, u: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    """Paths of all rows of a block, side by side from the last step to the first."""
    path = np.zeros(u.shape, np.int32)
    for t in range(u.shape[1] - 1, -1, -1):
        k, more = int((n > t).sum()), int((n > t + 1).sum())
        p = alpha[:k, t].copy()
        if more:
            p[:more] *= a[0][:, path[:more, t + 1]].T if classes is None else a[classes[:more, t], :, path[:more, t + 1]]
        path[:k, t] = _chosen(p, u[:k, t])
    return path


def _draw(batches: Iterator[pa.RecordBatch], model: Hmm, seed: int, sweep: int, classes: str | None, parts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        obs = chain.ragged(batch.column("obs"))
        keys, known = _keys(batch, *obs), batch.column("obs").is_valid().to_pylist()
        paths: list = [None] * batch.num_rows
        drawn: list = [None] * batch.num_rows
        cls = _whole(batch, classes, obs) if classes else None
        for at, n, x in chain.padded(*obs, model.n):
            c = None if cls is None else np.nan_to_num(_pick(cls, obs[1], at, n)).astype(np.int64)
            alpha, _, logp = chain.forward(model, chain.emissions(model, x), n, c)
            rows = [keys[r] for r in at.tolist()]
            path = _backward_draws(alpha, model.a, n, _uniforms(rows, n, seed, sweep), c)
            of = _components_of(model, x, path, _uniforms(rows, n, seed, sweep, 1)) if parts else None
            for k, r in enumerate(at.tolist()):
                if known[r] and np.isfinite(logp[k]):
                    paths[r] = path[k, : n[k]]
                    drawn[r] = of[k, : n[k]] if parts else None
        more = [pa.array(drawn, pa.list_(pa.int32()))] if parts else []
        yield pa.RecordBatch.from_arrays([batch.column("seq_id"), batch.column("obs"), pa.array(paths, pa.list_(pa.int32())), *more], names=["seq_id", "obs", "path", "part"][: 3 + parts])


def _components_of(model: ContinuousHmm, x: np.ndarray, path: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The component that each item of a state comes from, drawn by weight times density; the first for missing items."""
    out = np.zeros(path.shape, np.int32)
    for i, comps in enumerate(model.components):
        here = (path == i) & ~np.isnan(x)
        if len(comps) > 1 and here.any():
            out[here] = _chosen(np.stack([c.weight * c.density(x[here]) for c in comps], 1), u[here])
    return out


def sample_paths(seqs: DataFrame, model: Hmm, seed: int = 0, sweep: int = 0, classes: str | None = None, parts: bool = False) -> DataFrame:
    """``seq_id, obs, path``: a path of each sequence from its posterior (forward filter, backward sampling).

    ``classes`` names a column with the class of the step after each item, as in ``decode``; a model with several needs it. ``parts`` adds
    ``part``, a density's component for each item. Null and impossible sequences have a null path. Ids may be numbers or texts; rows without
    id are drawn by their content.
    """
    known_classes(model, classes is not None, "a column of classes")
    if model.silent:
        raise ValueError("paths are drawn for models without silent states")
    s = seqs.select("seq_id", "obs")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema) + ", path array<int>" + (", part array<int>" if parts else "")
    s = seqs.select("seq_id", "obs", *([classes] if classes else []))
    return s.mapInArrow(partial(_draw, model=model, seed=seed, sweep=sweep, classes=classes, parts=parts), schema)


class _Products:
    """Forward steps over tuples of symbols: products of step matrices by tuple, kept for the life of a task.

    Symbols are codes, then a missing one, one that no state emits, and the filler of an incomplete last tuple, which changes nothing.
    """

    def __init__(self, model: DiscreteHmm, width: int) -> None:
        self.width, n, m = width, model.n, model.m
        b = np.stack([*np.where(np.array(model.b) < EPS, 0.0, model.b).T, np.ones(n), np.zeros(n)])
        self.steps = np.concatenate([model.a[0][None] * b[:, None, :], np.eye(n)[None]])
        self.filler, self.known, self.of = m + 2, {}, np.zeros((0, width + 1, n, n))

    def prefixes(self, tuples: np.ndarray) -> np.ndarray:
        """Place of each tuple's products in ``of``, which has those of its first 0, 1, ... symbols."""
        code = np.zeros(tuples.shape[:-1], np.int64)
        for k in range(self.width):
            code = code * (self.filler + 1) + tuples[..., k]
        distinct, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        flat, new = tuples.reshape(-1, self.width), []
        for c, at in zip(distinct.tolist(), first.tolist(), strict=True):
            if c not in self.known:
                self.known[c] = len(self.known)
                parts = [np.eye(len(self.steps[0]))]
                for symbol in flat[at]:
                    parts.append(parts[-1] @ self.steps[symbol])
                new.append(parts)
        if new:
            self.of = np.concatenate([self.of, np.array(new)])
        return np.array([self.known[c] for c in distinct.tolist()], np.int64)[inverse].reshape(code.shape)


def _draw_tuples(batches: Iterator[pa.RecordBatch], model: DiscreteHmm, seed: int, sweep: int, width: int) -> Iterator[pa.RecordBatch]:
    products, m = _Products(model, width), model.m
    for batch in batches:
        obs = chain.ragged(batch.column("obs"))
        keys, given = _keys(batch, *obs), batch.column("obs").is_valid().to_pylist()
        paths: list = [None] * batch.num_rows
        for at, n, x in chain.padded(*obs, model.n):
            rows, length = x.shape
            if not length:
                for r in at.tolist():
                    paths[r] = np.zeros(0, np.int32) if given[r] else None
                continue
            sym = np.where(np.isnan(x), m, np.where((x >= 0) & (x < m), x, m + 1)).astype(np.int64)
            sym[np.arange(length) >= n[:, None]] = products.filler
            b0 = np.stack([*np.where(np.array(model.b) < EPS, 0.0, model.b).T, np.ones(model.n), np.zeros(model.n)])
            count = -(-(length - 1) // width)
            tuples = np.full((rows, count * width), products.filler)
            tuples[:, : length - 1] = sym[:, 1:]
            tuples = tuples.reshape(rows, count, width)
            at_tuple = np.zeros((rows, count, model.n))  # scaled forward values before each tuple
            now = model.pi * b0[np.minimum(sym[:, 0], m + 1)]
            dead = np.zeros(rows, bool)
            place = products.prefixes(tuples) if count else np.zeros((rows, 0), np.int64)
            for k in range(count + 1):
                total = now.sum(1)
                dead |= total <= 0
                now = now / np.where(total > 0, total, 1.0)[:, None]
                if k < count:
                    at_tuple[:, k] = now
                    now = np.einsum("bi,bij->bj", now, products.of[place[:, k], width])
            u, path = _uniforms([keys[r] for r in at.tolist()], n, seed, sweep), np.zeros((rows, length), np.int32)
            for t in range(length - 1, -1, -1):
                alive, more = int((n > t).sum()), int((n > t + 1).sum())
                if not t:
                    first = model.pi * b0[np.minimum(sym[:alive, 0], m + 1)]
                    p = first
                else:
                    k, inside = divmod(t - 1, width)
                    p = np.einsum("bi,bij->bj", at_tuple[:alive, k], products.of[place[:alive, k], inside + 1])
                p[:more] *= model.a[0][:, path[:more, t + 1]].T if more else 1.0
                path[:alive, t] = _chosen(p, u[:alive, t])
            for k, r in enumerate(at.tolist()):
                paths[r] = path[k, : n[k]] if given[r] and not dead[k] else None
        yield pa.RecordBatch.from_arrays([batch.column("seq_id"), batch.column("obs"), pa.array(paths, pa.list_(pa.int32()))], names=["seq_id", "obs", "path"])


def sample_paths_by_tuples(seqs: DataFrame, model: DiscreteHmm, width: int, seed: int = 0, sweep: int = 0) -> DataFrame:
    """:func:`sample_paths` of a discrete model, by tuples of ``width`` symbols: the same draws for the same seed, up to rounding.

    A step of the forward pass takes a whole tuple, by the product of its step matrices, which equal tuples share; states
    are drawn last tuple first, those inside a tuple from its first symbols' products.
    """
    known_classes(model, False, "sampling by items")
    if model.silent or any(model.order(i) for i in range(model.n)):
        raise ValueError("tuples are for models of order 0 without silent states")
    if width < 1 or (model.m + 3) ** width >= 2**62:
        raise ValueError("tuples must have a code of 62 bits")
    s = seqs.select("seq_id", "obs")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema) + ", path array<int>"
    return s.mapInArrow(partial(_draw_tuples, model=model, seed=seed, sweep=sweep, width=width), schema)


def tuple_width(length: int) -> int:
    """Symbols of a tuple for sequences of ``length`` items: half the logarithm of its root, 2 at least."""
    return max(2, math.ceil(0.25 * math.log(max(length, 1))))


def gibbs(seqs: DataFrame, model: DiscreteHmm, sweeps: int = 20, prior: float = 1.0, seed: int = 0, width: int | None = None) -> tuple[DiscreteHmm, DataFrame]:
    """Gibbs sampling of a discrete model with symmetric Dirichlet priors: the last model, and paths drawn from it.

    With ``width``, paths are drawn by tuples of so many symbols (:func:`tuple_width` names one for a length). A sweep samples all paths, counts them in one aggregation, and draws new rows on the driver. Sequences are read once in a
    sweep; persist them before if that is dear. Models of higher order, with silent states or several classes raise an error.
    """
    if any(model.order(i) for i in range(model.n) if i not in model.silent):
        raise ValueError("Gibbs sampling is for models of order 0")
    model = model.copy()

    def draw(sweep: int) -> DataFrame:
        return sample_paths_by_tuples(seqs, model, width, seed, sweep) if width else sample_paths(seqs, model, seed, sweep)

    for sweep in range(sweeps):
        cells = draw(sweep).where("path is not null").select("path", "obs", F.posexplode("path").alias("t", "q"))
        steps = cells.select(F.when(F.col("t") > 0, F.get("path", F.col("t") - 1)).otherwise(-1).alias("src"), F.col("q").alias("dst"), F.get("obs", "t").alias("sym"))
        pi, a, b = np.full(model.n, prior), np.full((model.n, model.n), prior), np.full((model.n, model.m), prior)
        for src, dst, sym, n in steps.groupBy("src", "dst", "sym").agg(F.count("*").alias("n")).collect():
            if src < 0:
                pi[dst] += n
            else:
                a[src, dst] += n
            if sym is not None:
                b[dst, sym] += n
        rng = generator(seed, sweep, 7)
        model.pi = rng.dirichlet(pi)
        model.a = np.stack([rng.dirichlet(r) for r in a])[None]
        model.b = [rng.dirichlet(r) if i not in model.fixed else model.b[i] for i, r in enumerate(b)]
    return model, draw(sweeps).select("seq_id", "path")


@dataclass
class NormalPrior:
    """Normal-gamma priors of means and precisions, and the Dirichlet weight of rows and component shares."""

    m0: float = 0.0
    k0: float = 0.01
    a0: float = 1.0
    b0: float = 1.0
    rows: float = 1.0

    def draw(self, rng: np.random.Generator, n: float, s: float, ss: float) -> tuple[float, float]:
        """A mean and a variance given ``n`` items, their sum and their sum of squares."""
        bar = s / n if n else 0.0
        kn, an = self.k0 + n, self.a0 + n / 2
        bn = self.b0 + max(0.0, ss - n * bar * bar) / 2 + n * self.k0 * (bar - self.m0) ** 2 / (2 * kn)
        tau = rng.gamma(an, 1 / bn)
        return float(rng.normal((self.k0 * self.m0 + n * bar) / kn, 1 / math.sqrt(kn * tau))), 1 / tau


def _redrawn(model: ContinuousHmm, prior: NormalPrior, rng: np.random.Generator, pi: np.ndarray, a: np.ndarray, sums: list[np.ndarray]) -> ContinuousHmm:
    """Parameters given counts of starts and steps, and by state and component the items' number, sum and sum of squares."""
    out = model.copy()
    out.pi, out.a = rng.dirichlet(pi + prior.rows), np.stack([rng.dirichlet(r + prior.rows) for r in a])[None]
    for i, rows in enumerate(sums):
        if i in model.fixed:
            continue
        weights = rng.dirichlet(rows[:, 0] + prior.rows) if len(rows) > 1 else [1.0]
        for k, row in enumerate(rows):
            mean, var = prior.draw(rng, *row)
            out.components[i][k] = Component("normal", float(weights[k]), mean, var)
    return out


def gibbs_normal(seqs: DataFrame, model: ContinuousHmm, sweeps: int = 20, m0: float = 0.0, k0: float = 0.01, a0: float = 1.0, b0: float = 1.0, prior: float = 1.0, seed: int = 0) -> tuple[ContinuousHmm, DataFrame]:
    """Gibbs sampling of a model of normals, or of mixtures of them, with normal-gamma priors; all sequences are pooled in every sweep.

    Beside a state, an item of a mixture gets a component; shares have the Dirichlet prior of the rows. States in ``fixed`` keep their densities.
    """
    known_classes(model, False, "a model of one class")
    if any(c.kind != "normal" for comps in model.components for c in comps):
        raise ValueError("Gibbs sampling is for normals and mixtures of normals")
    model, priors = model.copy(), NormalPrior(m0, k0, a0, b0, prior)
    for sweep in range(sweeps):
        drawn = sample_paths(seqs, model, seed, sweep, parts=True).where("path is not null")
        cells = drawn.select("path", "part", "obs", F.posexplode("path").alias("t", "q"))
        x = F.get("obs", "t")
        at = F.when(F.col("t") > 0, F.get("path", F.col("t") - 1)).otherwise(-1)
        rows = cells.groupBy(at.alias("src"), F.col("q").alias("dst"), F.get("part", "t").alias("part")).agg(F.count("*").alias("n"), F.count(x).alias("k"), F.sum(x).alias("s"), F.sum(x * x).alias("ss")).collect()
        pi, a, sums = np.zeros(model.n), np.zeros((model.n, model.n)), [np.zeros((len(c), 3)) for c in model.components]
        for src, dst, part, n, k, s, ss in sorted(rows):
            if src < 0:
                pi[dst] += n
            else:
                a[src, dst] += n
            sums[dst][part] += [k, s or 0.0, ss or 0.0]
        model = _redrawn(model, priors, generator(seed, sweep, 11), pi, a, sums)
    return model, sample_paths(seqs, model, seed, sweeps).select("seq_id", "path")


def blocks_of(seqs: DataFrame, delta: float) -> DataFrame:
    """Runs of neighbouring items that differ by less than ``delta`` from the item before: ``seq_id, block, start, n, mean, var``."""
    w = Window.partitionBy("seq_id").orderBy("t")
    items = seqs.select("seq_id", F.posexplode("obs").alias("t", "x"))
    marked = items.withColumn("new", F.coalesce(F.abs(F.col("x") - F.lag("x").over(w)) >= delta, F.lit(False)).cast("int")).withColumn("block", F.sum("new").over(w))
    return marked.groupBy("seq_id", "block").agg(F.min("t").alias("start"), F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def _cut(batches: Iterator[pa.RecordBatch], delta: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("obs")
        x, at = chain.ragged(column)
        first = np.zeros(len(x), bool)
        first[at[:-1][np.diff(at) > 0]] = True
        with np.errstate(invalid="ignore"):
            first[1:] |= np.abs(x[1:] - x[:-1]) >= delta
        begin = np.flatnonzero(first)
        known = ~np.isnan(x)
        if len(begin):
            n, k = np.diff(np.append(begin, len(x))), np.add.reduceat(known.astype(np.int64), begin)
            mean = np.add.reduceat(np.where(known, x, 0.0), begin) / np.maximum(k, 1)
            off = np.where(known, x, 0.0) - np.repeat(mean, n)
            spread = np.add.reduceat(np.where(known, off * off, 0.0), begin)
        else:
            n = k = np.zeros(0, np.int64)
            mean = spread = np.zeros(0)
        offsets = pa.array(np.searchsorted(begin, at).astype(np.int32), mask=np.append(~column.is_valid().to_numpy(zero_copy_only=False), False))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (n, k, mean, spread)]
        yield pa.RecordBatch.from_arrays([batch.column("seq_id"), *lists], names=["seq_id", "n", "k", "mean", "spread"])


def compressed(seqs: DataFrame, delta: float) -> DataFrame:
    """``seq_id, n, k, mean, spread``: by run of neighbouring items that differ by less than ``delta`` from the item before, its
    items, those that aren't null, their mean and their squared deviations from it. Null sequences stay null.

    A null item ends no run and differs from none.
    """
    kind = seqs.schema["seq_id"].dataType.simpleString()
    return seqs.select("seq_id", F.col("obs").cast("array<double>").alias("obs")).mapInArrow(partial(_cut, delta=delta), f"seq_id {kind}, n array<long>, k array<long>, mean array<double>, spread array<double>")


def _draw_runs(batches: Iterator[pa.RecordBatch], model: ContinuousHmm, seed: int, sweep: int) -> Iterator[pa.RecordBatch]:
    mu, var = (np.array([getattr(c[0], f) for c in model.components], float) for f in ("mean", "var"))
    with np.errstate(divide="ignore"):
        stay = np.log(np.diag(model.a[0]))
    for batch in batches:
        columns = [chain.ragged(batch.column(c)) for c in ("n", "k", "mean", "spread")]
        at_run, values = columns[0][1], np.stack([v for v, _ in columns], 1)
        keys, paths = _keys(batch, values, at_run), [None] * batch.num_rows
        known = batch.column("n").is_valid().to_pylist()
        for at, runs, x in chain.padded(values, at_run, model.n):
            n, k, mean, spread = (np.nan_to_num(x[:, :, c])[:, :, None] for c in range(4))
            # a run stays in its state: the chance of all its items, and of the steps between them in closed form
            moved = np.where(n > 1, np.maximum(n - 1, 0) * np.where(n > 1, stay, 0.0), 0.0)
            logs = moved - 0.5 * (k * np.log(2 * np.pi * var) + (spread + k * (mean - mu) ** 2) / var)
            top = logs.max(2, keepdims=True)
            e = np.exp(logs - np.where(np.isfinite(top), top, 0.0))
            alpha, _, logp = chain.forward(model, e, runs)
            path = _backward_draws(alpha, model.a, runs, _uniforms([keys[r] for r in at.tolist()], runs, seed, sweep))
            for j, r in enumerate(at.tolist()):
                paths[r] = path[j, : runs[j]] if known[r] and np.isfinite(logp[j]) else None
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.int32()))], names=[*batch.schema.names, "path"])


def gibbs_runs(seqs: DataFrame, model: ContinuousHmm, delta: float, sweeps: int = 20, priors: NormalPrior | None = None, seed: int = 0) -> tuple[ContinuousHmm, DataFrame]:
    """Gibbs sampling of a model of single normals over runs of like items: the last model and ``seq_id, path``, a state for each item.

    Sequences are compressed once (:func:`compressed`); a run's items share a state, its likelihood comes from their number, mean and
    squared deviations, and its steps to itself in closed form. The forward filter takes a step per run. Where each run has one item, these
    are the draws of :func:`gibbs_normal`.
    """
    known_classes(model, False, "a model of one class")
    if any(len(c) > 1 or c[0].kind != "normal" for c in model.components):
        raise ValueError("runs are for models of single normals")
    model, priors = model.copy(), priors or NormalPrior()
    kind = seqs.schema["seq_id"].dataType.simpleString()
    schema = f"seq_id {kind}, n array<long>, k array<long>, mean array<double>, spread array<double>, path array<int>"
    with kept(compressed(seqs, delta)) as runs:
        for sweep in range(sweeps):
            drawn = runs.mapInArrow(partial(_draw_runs, model=model, seed=seed, sweep=sweep), schema).where("path is not null")
            cells = drawn.select("path", F.posexplode(F.arrays_zip("path", "n", "k", "mean", "spread")).alias("t", "r"))
            at = F.when(F.col("t") > 0, F.get("path", F.col("t") - 1)).otherwise(-1)
            k, mean = F.col("r.k"), F.col("r.mean")
            rows = cells.groupBy(at.alias("src"), F.col("r.path").alias("dst")).agg(F.count("*").alias("runs"), F.sum("r.n").alias("n"), F.sum(k).alias("k"), F.sum(k * mean).alias("s"), F.sum(F.col("r.spread") + k * mean * mean).alias("ss")).collect()
            pi, a, sums = np.zeros(model.n), np.zeros((model.n, model.n)), [np.zeros((1, 3)) for _ in range(model.n)]
            for src, dst, count, n, k, s, ss in sorted(rows):
                if src < 0:
                    pi[dst] += count
                else:
                    a[src, dst] += count
                a[dst, dst] += n - count
                sums[dst][0] += [k, s, ss]
            model = _redrawn(model, priors, generator(seed, sweep, 11), pi, a, sums)
    last = compressed(seqs, delta).mapInArrow(partial(_draw_runs, model=model, seed=seed, sweep=sweeps), schema)
    return model, last.select("seq_id", F.flatten(F.transform(F.arrays_zip("path", "n"), lambda r: F.array_repeat(r["path"], r["n"].cast("int")))).alias("path"))
