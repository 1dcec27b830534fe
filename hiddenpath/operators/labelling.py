"""Likeliest labelling: a beam over label strings, each with the probability of all its state paths."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hiddenpath.functions import chain
from hiddenpath.model import DiscreteHmm
from hiddenpath.operators.decoding import _whole, known_classes

#: Fixed value: how far a labelling may fall behind the best one of a state, in log probability (a share of 3 percent).
BEHIND = -math.log(0.03)


def likeliest_labelling(model: DiscreteHmm, e: np.ndarray, k: int, classes: np.ndarray | None = None) -> tuple[list[str], float]:
    """The best labelling found for likelihoods of shape (steps, states), and its log probability; ``classes`` are those of the steps.

    A hypothesis is a label string with the log probability of ending in each state; every state keeps the ``k`` best
    that are within BEHIND of its best one, and hypotheses that no state keeps are dropped.
    """
    if not len(e):
        return [], 0.0
    names = sorted(set(model.labels))
    own = np.array([[x == name for x in model.labels] for name in names])
    with np.errstate(divide="ignore"):
        first = np.log(model.pi * e[0])
        la, le = np.log(model.a), np.log(e)
    trail: list[list[tuple[int, int]]] = [[(-1, g) for g in range(len(names)) if np.isfinite(first[own[g]]).any()]]
    score = np.array([np.where(own[g], first, -np.inf) for _, g in trail[0]]).reshape(-1, model.n)
    for t in range(1, len(e)):
        if not len(score):
            return [], -math.inf
        moved = np.logaddexp.reduce(score[:, :, None] + la[0 if classes is None else classes[t - 1]], axis=1) + le[t]
        grown = np.where(own[None], moved[:, None, :], -np.inf).reshape(-1, model.n)
        best = grown.max(0)
        rank = np.argsort(np.argsort(-grown, axis=0, kind="stable"), axis=0, kind="stable")
        kept = np.flatnonzero(((rank < k) & (grown >= best - BEHIND) & np.isfinite(grown)).any(1))
        trail.append([(int(h) // len(names), int(h) % len(names)) for h in kept])
        score = grown[kept]
    if not len(score):
        return [], -math.inf
    total = np.logaddexp.reduce(score, axis=1)
    at, out = int(total.argmax()), []
    for step in reversed(trail):
        parent, g = step[at]
        out.append(names[g])
        at = parent
    return out[::-1], float(total.max())


def _label(batches: Iterator[pa.RecordBatch], model: DiscreteHmm, k: int, classes: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        obs, known = chain.ragged(batch.column("obs")), batch.column("obs").is_valid().to_pylist()
        labels, logp = [None] * batch.num_rows, [None] * batch.num_rows
        cls = np.nan_to_num(_whole(batch, classes, obs)).astype(np.int64) if classes else None
        for at, n, x in chain.padded(*obs, model.n):
            e = chain.emissions(model, x)
            for j, r in enumerate(at.tolist()):
                if known[r]:
                    labels[r], logp[r] = likeliest_labelling(model, e[j, : n[j]], k, None if cls is None else cls[obs[1][r] : obs[1][r + 1]])
        yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array(labels, pa.list_(pa.string())), pa.array(logp, pa.float64())], names=["seq_id", "labels", "logp"])


def label(seqs: DataFrame, model: DiscreteHmm, k: int = 2, classes: str | None = None) -> DataFrame:
    """``seq_id, labels, logp``: the likeliest label string of each sequence. Null sequences give nulls, impossible ones an empty string of labels and -Infinity.

    ``classes`` names a column with the transition class of the step after each item, which a model with several needs. Models with
    silent states raise an error.
    """
    if model.silent or not model.labels:
        raise ValueError("labelling needs a labelled model without silent states")
    known_classes(model, classes is not None)
    return seqs.select("seq_id", "obs", *([classes] if classes else [])).mapInArrow(partial(_label, model=model, k=k, classes=classes), f"seq_id {seqs.schema['seq_id'].dataType.simpleString()}, labels array<string>, logp double")
