"""Recursions over a block of padded sequences: small array helpers for the Arrow operators.

Sequences of a block are ordered by falling length, so those alive at a step are the first ``k`` rows. ``e`` holds the
emission likelihoods, of shape (rows, steps, states); columns of silent states are zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from hiddenpath.model import EPS, ContinuousHmm, DiscreteHmm, Hmm

#: Cells (steps x states x rows) of a block; a longer sequence makes a block of its own.
BLOCK_CELLS = 1_000_000


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column of numbers (or lists of ``d`` numbers: shape (values, d)); null lists are
    empty, null values are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array(column.value_lengths().fill_null(0))
    inner = column.flatten()
    if pa.types.is_list(inner.type):
        widths = np.unique(inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        if len(widths) > 1:
            raise ValueError(f"observations must have one dimension, not {widths.tolist()}")
        width = int(widths[0]) if len(widths) else 1
        values = inner.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, max(width, 1))
    else:
        values = inner.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def padded(values: np.ndarray, at: np.ndarray, n_states: int, most: int = BLOCK_CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows: row numbers, lengths in falling order and values of shape (rows, steps[, d])."""
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    k = 0
    while k < len(order):
        rows = order[k : k + max(1, most // max(1, int(lengths[order[k]]) * n_states))]
        n = lengths[rows]
        steps = int(n[0])
        x = np.full((len(rows), steps, *values.shape[1:]), np.nan)
        if steps:
            inside = np.arange(steps) < n[:, None]
            x[inside] = values[(at[rows][:, None] + np.arange(steps))[inside]]
        yield rows, n, x
        k += len(rows)


def codes(model: DiscreteHmm, x: np.ndarray, state: int) -> np.ndarray:
    """Index into the state's emission table at each step; -1 where history or symbol is missing or out of range."""
    order, m = model.order(state), model.m
    sym = np.where((x >= 0) & (x < m), np.nan_to_num(x, nan=-1), -1).astype(np.int64)
    index, ok = np.zeros_like(sym), np.ones(sym.shape, bool)
    for back in range(order, -1, -1):
        s = np.full_like(sym, -1)
        s[:, back:] = sym[:, : sym.shape[1] - back] if back else sym
        ok &= s >= 0
        index = index * m + s
    return np.where(ok, index, -1)


def emissions(model: Hmm, x: np.ndarray) -> np.ndarray:
    """Likelihood of each step in each state. A missing observation (NaN) has likelihood 1 in every state that emits."""
    e = np.zeros((*x.shape[:2], model.n))
    missing = np.isnan(x) if x.ndim == 2 else np.isnan(x).any(2)
    if isinstance(model, DiscreteHmm):
        silent = set(model.silent)
        for i in range(model.n):
            if i not in silent:
                c = codes(model, x, i)
                p = np.where(c >= 0, model.b[i][np.maximum(c, 0)], 0.0)
                e[:, :, i] = np.where(missing, 1.0, np.where(p < EPS, 0.0, p))
    else:
        assert isinstance(model, ContinuousHmm)
        for i in range(model.n):
            with np.errstate(invalid="ignore"):
                e[:, :, i] = np.where(missing, 1.0, model.density(i, x))
    return e


def least_scale(model: Hmm) -> float:
    """A step whose likelihood given those before is under this is impossible."""
    return EPS if isinstance(model, DiscreteHmm) else float(np.finfo(float).tiny)


def _step(prev: np.ndarray, a: np.ndarray, cls: np.ndarray | None) -> np.ndarray:
    return prev @ a[0] if cls is None else np.einsum("bi,bij->bj", prev, a[cls])


def forward(model: Hmm, e: np.ndarray, n: np.ndarray, classes: np.ndarray | None = None, eps: float | None = None, lean: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward variables (``lean``: those of each row's last step only), scales and log-likelihoods; -inf once a step's scale is under ``eps``: EPS for
    probabilities; densities depend on the unit, so for them it is the smallest normal double."""
    eps = least_scale(model) if eps is None else eps
    rows, steps, _ = e.shape
    s = model.silent_order()
    loud = [i for i in range(model.n) if i not in s]
    inside = np.linalg.inv(np.eye(len(s)) - model.a[0][np.ix_(s, s)]) if s else None
    alpha, scale = np.zeros((rows, model.n) if lean else e.shape), np.ones((rows, steps))
    dead = np.zeros(rows, bool)
    for t in range(steps):
        k = int((n > t).sum())
        raw = (model.pi if t == 0 else _step(alpha[:k] if lean else alpha[:k, t - 1], model.a, None if classes is None else classes[:k, t - 1])) * e[:k, t]
        if s:
            raw[:, s] = ((model.pi[s] if t == 0 else 0.0) + raw[:, loud] @ model.a[0][np.ix_(loud, s)]) @ inside
        total = raw.sum(1)
        dead[:k] |= total < eps
        scale[:k, t] = total
        new = np.divide(raw, total[:, None], out=np.zeros_like(raw), where=total[:, None] >= eps)
        if lean:
            alpha[:k] = new
        else:
            alpha[:k, t] = new
    with np.errstate(divide="ignore"):
        logp = np.where(dead, -np.inf, np.log(scale).sum(1))
        if s and steps:
            last = (alpha if lean else alpha[np.arange(rows), np.maximum(n - 1, 0)])[:, loud].sum(1)
            logp = np.where(n > 0, logp + np.log(last), logp)
    return alpha, scale, logp


def advance(model: Hmm, alpha: np.ndarray | None, e: np.ndarray, cls: int = 0) -> tuple[np.ndarray, float]:
    """One step of :func:`forward` for one sequence: the scaled vector after an item of likelihoods ``e``, and its scale (0: impossible).

    ``alpha`` is the vector before it, None at the first item; ``cls`` the class of the step between.
    """
    raw = (model.pi if alpha is None else alpha @ model.a[cls]) * e
    if s := model.silent_order():
        loud = [i for i in range(model.n) if i not in s]
        raw[s] = ((model.pi[s] if alpha is None else 0.0) + raw[loud] @ model.a[0][np.ix_(loud, s)]) @ np.linalg.inv(np.eye(len(s)) - model.a[0][np.ix_(s, s)])
    total = float(raw.sum())
    return (raw / total, total) if total >= least_scale(model) else (np.zeros(model.n), 0.0)


def descaled(alpha: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Forward variables without their scales; they underflow on long sequences."""
    return alpha * np.cumprod(scale, 1)[:, :, None]


def backward(model: Hmm, e: np.ndarray, n: np.ndarray, scale: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    """Backward variables with the scales of :func:`forward`: 1 at the last step."""
    s = model.silent_order()
    loud = [i for i in range(model.n) if i not in s]
    inside = np.linalg.inv(np.eye(len(s)) - model.a[0][np.ix_(s, s)]) if s else None
    beta = np.zeros(e.shape)
    beta[np.flatnonzero(n > 0), n[n > 0] - 1] = 1.0
    for t in range(e.shape[1] - 2, -1, -1):
        k = int((n > t + 1).sum())
        with np.errstate(over="ignore"):  # of a state that can't be reached where all others are far out
            after = np.divide(e[:k, t + 1] * beta[:k, t + 1], scale[:k, t + 1, None], out=np.zeros_like(e[:k, t + 1]), where=scale[:k, t + 1, None] > 0)
        after = np.minimum(after, 1e200)
        got = after @ model.a[0].T if classes is None else np.einsum("bj,bij->bi", after, model.a[classes[:k, t]])
        if s:
            got[:, s] = got[:, s] @ inside.T
            got[:, loud] += got[:, s] @ model.a[0][np.ix_(loud, s)].T
        beta[:k, t] = got
    return beta


def begun(model: Hmm, e: np.ndarray, n: np.ndarray, beta: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The log-likelihoods from the backward side, for models without silent states; they equal those of :func:`forward`."""
    if model.silent:
        raise ValueError("the backward side of silent states has no plain end")
    with np.errstate(divide="ignore"):
        first = (model.pi * e[:, 0] * beta[:, 0]).sum(1) if e.shape[1] else np.ones(len(n))
        inside = np.arange(e.shape[1]) < n[:, None]
        rest = np.where(inside & (np.arange(e.shape[1]) > 0), np.log(scale), 0.0).sum(1)
        return np.where(n > 0, np.log(first) + rest, 0.0)


def viterbi(model: Hmm, e: np.ndarray, n: np.ndarray, classes: np.ndarray | None = None, silent_start: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """Likeliest paths and their log probabilities. Of equal predecessors the smallest wins; impossible: empty, -inf."""
    rows, steps, states = e.shape
    s = model.silent_order()
    with np.errstate(divide="ignore"):
        la, le, lpi = np.log(model.a), np.log(e), np.log(model.pi)
    score = np.full((rows, states), -np.inf)
    back = np.zeros((rows, steps, states), np.int32)
    last = np.full((rows, states), -np.inf)
    for t in range(steps):
        k = int((n > t).sum())
        if t == 0:
            new = lpi + le[:k, 0]
            back[:k, 0] = -1
        else:
            both = score[:k, :, None] + (la[0] if classes is None else la[classes[:k, t - 1]])
            back[:k, t] = both.argmax(1)
            new = both.max(1) + le[:k, t]
        for q in s:
            new[:, q] = lpi[q] if t == 0 and silent_start else -np.inf
            via = new + la[0][:, q]
            via[:, q] = -np.inf
            best = via.argmax(1)
            better = via[np.arange(k), best] > new[:, q]
            back[:k, t, q] = np.where(better, best, -1)
            new[:, q] = np.where(better, via[np.arange(k), best], new[:, q])
        score = new
        done = np.flatnonzero(n[:k] == t + 1)
        last[done] = new[done]
    logp = np.where(n > 0, last.max(1), 0.0)
    end = last.argmax(1)
    quiet = np.zeros(states, bool)
    quiet[s] = True
    if not s:
        path = np.zeros((rows, steps), np.int32)
        for t in range(steps - 1, -1, -1):
            k = int((n > t).sum())
            path[:k, t] = np.where(n[:k] == t + 1, end[:k], back[np.arange(k), min(t + 1, steps - 1), path[:k, min(t + 1, steps - 1)]])
        return [path[i, : n[i]] if np.isfinite(logp[i]) else path[i, :0] for i in range(rows)], logp
    paths = []
    for i in range(rows):
        out, t, q = [], int(n[i]) - 1, int(end[i])
        while t >= 0 and q >= 0 and np.isfinite(logp[i]):
            out.append(q)
            q, t = int(back[i, t, q]), t if quiet[q] else t - 1
        paths.append(np.array(out[::-1], np.int32))
    return paths, logp


def expected(model: Hmm, e: np.ndarray, n: np.ndarray, alpha: np.ndarray, beta: np.ndarray, scale: np.ndarray, w: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """State occupancies of every step, weighted by row, and expected transitions of each class."""
    gamma = alpha * beta * w[:, None, None]
    trans = np.zeros_like(model.a)
    if e.shape[1] > 1:
        live = np.arange(1, e.shape[1]) < n[:, None]
        with np.errstate(over="ignore"):
            after = np.minimum(np.where(live[:, :, None], e[:, 1:] * beta[:, 1:], 0) / np.where(scale[:, 1:] > 0, scale[:, 1:], 1)[:, :, None], 1e200)
        before = alpha[:, :-1] * w[:, None, None]
        for c in range(len(model.a)):
            use = live if classes is None else live & (classes[:, : e.shape[1] - 1] == c)
            trans[c] = model.a[c] * (before[use].T @ after[use])
    return gamma, trans
