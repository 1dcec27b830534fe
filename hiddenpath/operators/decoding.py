"""Scores and paths of sequences: one Arrow pass per model that computes what is asked for and no more."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiddenpath.functions import chain
from hiddenpath.functions.folds import log_sum_exp, softmax
from hiddenpath.model import DiscreteHmm, Hmm

_DOUBLES = pa.list_(pa.float64())
_MATRIX = pa.list_(_DOUBLES)
#: What can be asked for: the Arrow and SQL types.
OUTPUTS = {
    "logp": (pa.float64(), "double"),
    "alpha": (_MATRIX, "array<array<double>>"),
    "scale": (_DOUBLES, "array<double>"),
    "beta": (_MATRIX, "array<array<double>>"),
    "posterior": (_MATRIX, "array<array<double>>"),
    "path": (pa.list_(pa.int32()), "array<int>"),
    "path_logp": (pa.float64(), "double"),
    "path_labels": (pa.list_(pa.string()), "array<string>"),
}


def known_classes(model: Hmm, given: bool, what: str = "a column of classes") -> None:
    """An error for a model with several transition classes where nothing tells the class of a step."""
    if len(model.a) > 1 and not given:
        raise ValueError(f"a model of {len(model.a)} transition classes needs {what}")


def _whole(batch: pa.RecordBatch, column: str, like: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    values, at = chain.ragged(batch.column(column))
    if (np.diff(at) != np.diff(like[1])).any():
        raise ValueError(f"{column} must have an entry per observation")
    return values


def _decode(batches: Iterator[pa.RecordBatch], model: Hmm, outputs: list[str], classes: str | None, restrict: str | None, history: bool) -> Iterator[pa.RecordBatch]:
    need_forward = {"logp", "alpha", "scale", "beta", "posterior"} & set(outputs)
    need_backward = {"beta", "posterior"} & set(outputs)
    need_path = {"path", "path_logp", "path_labels"} & set(outputs)
    flat = None
    if not history and isinstance(model, DiscreteHmm):
        flat = model.copy()
        flat.b = [b[: model.m] for b in model.b]
    for batch in batches:
        rows = batch.num_rows
        obs = chain.ragged(batch.column("obs"))
        known = batch.column("obs").is_valid().to_numpy(zero_copy_only=False)
        cls = _whole(batch, classes, obs) if classes else None
        lab = _whole(batch, restrict, obs) if restrict else None
        got: dict[str, list] = {o: [None] * rows for o in outputs}
        for at, n, x in chain.padded(*obs, model.n):
            c = None if cls is None else _pick(cls, obs[1], at, n)
            e = chain.emissions(model, x)
            if lab is not None:
                e *= _pick(lab, obs[1], at, n)[:, :, None] == np.array([float(v) for v in model.labels])
            c = None if c is None else np.nan_to_num(c).astype(np.int64)
            one: dict[str, object] = {}
            if need_forward:
                one["alpha"], one["scale"], one["logp"] = chain.forward(model, e, n, c, lean=need_forward == {"logp"})
            if need_backward:
                one["beta"] = chain.backward(model, e, n, one["scale"], c)
                one["posterior"] = one["alpha"] * one["beta"]
            if need_path:
                one["path"], one["path_logp"] = chain.viterbi(flat or model, chain.emissions(flat, x) if flat else e, n, c, silent_start=history)
                one["path_labels"] = [[str(model.labels[q]) for q in p] if model.labels else None for p in one["path"]]
            for o in outputs:
                for k, r in enumerate(at.tolist()):
                    if known[r]:
                        v = one[o][k]
                        got[o][r] = float(v) if o.endswith("logp") else v[: n[k]].tolist() if o in ("alpha", "beta", "posterior", "scale") else v if isinstance(v, list) or v is None else v.tolist()
        yield pa.RecordBatch.from_arrays([batch.column("seq_id"), *[pa.array(got[o], OUTPUTS[o][0]) for o in outputs]], names=["seq_id", *outputs])


def _pick(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Companion values of a block, padded like its observations."""
    out = np.full((len(rows), int(n[0]) if len(n) else 0), np.nan)
    inside = np.arange(out.shape[1]) < n[:, None]
    out[inside] = values[(offsets[rows][:, None] + np.arange(out.shape[1]))[inside]]
    return out


def decode(seqs: DataFrame, model: Hmm, outputs: list[str], classes: str | None = None, restrict: str | None = None, history: bool = True) -> DataFrame:
    """``seq_id`` and the columns ``outputs`` (names in OUTPUTS), a row per sequence.

    ``seqs`` has ``seq_id`` and ``obs``: codes, reals, or arrays of reals. ``classes`` names an array column with the transition class
    of each step (entry t: from t to t + 1); ``restrict`` an array column of numeric labels to which the states' labels must be
    equal. A null sequence gives nulls, an empty one logp 0 and empty arrays; a null item has likelihood 1 in every emitting
    state; an impossible sequence has logp -Infinity and an empty path. ``history`` False decodes paths as if
    all states were of order 0 and without the start chances of silent ones.
    """
    known_classes(model, classes is not None)
    names = ["seq_id", "obs", *[c for c in (classes, restrict) if c]]
    schema = f"seq_id {seqs.schema['seq_id'].dataType.simpleString()}, " + ", ".join(f"{o} {OUTPUTS[o][1]}" for o in outputs)
    return seqs.select(*dict.fromkeys(names)).mapInArrow(partial(_decode, model=model, outputs=outputs, classes=classes, restrict=restrict, history=history), schema)


def _score_all(batches: Iterator[pa.RecordBatch], models: list[Hmm], classes: str | None, only: list[int] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        obs = chain.ragged(batch.column("obs"))
        cls = _whole(batch, classes, obs) if classes else None
        if only is None:
            scores, columns = np.zeros((batch.num_rows, len(models))), batch.columns
        else:
            scores, columns = chain.ragged(batch.column("scores"))[0].reshape(-1, len(models)).copy(), [batch.column(c) for c in batch.schema.names if c != "scores"]
        for k, m in enumerate(models):
            if only is not None and k not in only:
                continue
            for at, n, x in chain.padded(*obs, m.n):
                c = None if cls is None else np.minimum(np.nan_to_num(_pick(cls, obs[1], at, n)), len(m.a) - 1).astype(np.int64)
                scores[at, k] = chain.forward(m, chain.emissions(m, x), n, c, lean=True)[2]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(scores), _DOUBLES)], names=[*[c for c in batch.schema.names if c != "scores"], "scores"])


def score_all(seqs: DataFrame, models: list[Hmm], classes: str | None = None, only: list[int] | None = None) -> DataFrame:
    """All columns of ``seqs`` and ``scores``, the log-likelihood under each model: rows aren't multiplied by models.

    ``classes`` names a column of transition classes as in :func:`decode`; models of fewer classes take their last for a
    higher one, and models of several need the column. ``only`` lists the models to score again: ``seqs`` then has ``scores``, of which the
    others' stay.
    """
    for m in models:
        known_classes(m, classes is not None)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seqs.schema if f.name != "scores")
    return seqs.mapInArrow(partial(_score_all, models=models, classes=classes, only=only), f"{columns}, scores array<double>")


def classify(seqs: DataFrame, models: list[Hmm], keep: Sequence[str] = ()) -> DataFrame:
    """Bayes classification: ``seq_id``, the columns of ``keep``, ``model_id, posterior, posteriors``; of equal models the first wins."""
    priors = np.array([1 / len(models) if m.prior is None or m.prior < 0 else m.prior for m in models])
    with np.errstate(divide="ignore"):
        shift = F.array(*[F.lit(float(v)) for v in np.log(priors / priors.sum())])
    joint = F.transform("scores", lambda s, k: s + F.get(shift, k))
    scored = score_all(seqs.select("seq_id", "obs", *keep), models).select("seq_id", *keep, softmax(joint).alias("posteriors"))
    best = F.array_position("posteriors", F.array_max("posteriors")).cast("int") - 1
    return scored.select("seq_id", *keep, best.alias("model_id"), F.array_max("posteriors").alias("posterior"), "posteriors")


def best_model(seqs: DataFrame, models: list[Hmm]) -> DataFrame:
    """``seq_id, model_id, logp`` of the likeliest model; of equal ones the first."""
    scored = score_all(seqs.select("seq_id", "obs"), models)
    return scored.select("seq_id", (F.array_position("scores", F.array_max("scores")).cast("int") - 1).alias("model_id"), F.array_max("scores").alias("logp"))


def total_log_likelihood(seqs: DataFrame, model: Hmm, penalty: float | None = None) -> DataFrame:
    """One row: ``logp`` over all sequences, weighted where there is a weight, and ``n``, those possible.

    An impossible sequence counts as ``penalty``, or makes the sum -Infinity.
    """
    scored = score_all(seqs, [model])
    w = F.col("weight") if "weight" in seqs.columns else F.lit(1.0)
    s = F.col("scores")[0]
    value = s if penalty is None else F.when(s == float("-inf"), penalty).otherwise(s)
    return scored.agg(F.sum(w * value).alias("logp"), F.count_if(s > float("-inf")).alias("n"))


def log_odds(seqs: DataFrame, models: list[Hmm], label: str) -> DataFrame:
    """Discriminative figures of labelled sequences: ``seq_id, label, odds`` (log odds of the own model) and ``gain``,
    their logistic value. ``label`` names the column with the own model's number."""
    priors = [1 / len(models) if m.prior is None or m.prior < 0 else m.prior for m in models]
    shift = F.array(*[F.lit(float(np.log(p))) for p in priors])
    joint = score_all(seqs.select("seq_id", "obs", F.col(label).alias("label")), models).withColumn("j", F.transform("scores", lambda s, k: s + F.get(shift, k)))
    others = F.filter(F.transform("j", lambda s, k: F.when(k != F.col("label"), s)), lambda s: s.isNotNull())
    odds = F.get("j", F.col("label")) - log_sum_exp(others)
    return joint.select("seq_id", "label", odds.alias("odds")).withColumn("gain", 1 / (1 + F.exp(-F.col("odds"))))


def confusion(seqs: DataFrame, models: list[Hmm], label: str) -> DataFrame:
    """Sequences by own and predicted model: ``label, model_id, n``."""
    own = seqs.select("seq_id", "obs", F.col(label).alias("label"))
    return classify(own, models, ["label"]).groupBy("label", "model_id").agg(F.count("*").alias("n"))


def _trajectory(batches: Iterator[pa.RecordBatch], models: list[Hmm], shift: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        obs = chain.ragged(batch.column("obs"))
        out: list = [None] * batch.num_rows
        known = batch.column("obs").is_valid().to_numpy(zero_copy_only=False)
        for at, n, x in chain.padded(*obs, max(m.n for m in models)):
            scores = np.zeros((len(at), x.shape[1], len(models)))
            for k, m in enumerate(models):
                with np.errstate(divide="ignore"):
                    scores[:, :, k] = shift[k] + np.cumsum(np.log(chain.forward(m, chain.emissions(m, x), n)[1]), 1)
            with np.errstate(invalid="ignore"):
                p = np.exp(scores - scores.max(2, keepdims=True))
                p = np.nan_to_num(p / p.sum(2, keepdims=True))
            for k, r in enumerate(at.tolist()):
                out[r] = p[k, : n[k]].tolist() if known[r] else None
        yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array(out, _MATRIX)], names=["seq_id", "posteriors"])


def trajectory(seqs: DataFrame, models: list[Hmm]) -> DataFrame:
    """Recursive Bayes classification: ``seq_id, posteriors``, the models' posteriors after each item.

    The last entry is that of :func:`classify`. Zeros stand where no model can emit the items so far; a null sequence
    gives null, an empty one an empty array. Models with silent states raise an error.
    """
    if any(m.silent or len(m.a) > 1 for m in models):
        raise ValueError("a trajectory needs models without silent states and with one transition class")
    priors = np.array([1 / len(models) if m.prior is None or m.prior < 0 else m.prior for m in models])
    with np.errstate(divide="ignore"):
        shift = np.log(priors / priors.sum())
    kind = seqs.schema["seq_id"].dataType.simpleString()
    return seqs.select("seq_id", "obs").mapInArrow(partial(_trajectory, models=models, shift=shift), f"seq_id {kind}, posteriors array<array<double>>")


def distance(x: Hmm, y: Hmm, seqs: DataFrame) -> DataFrame:
    """Model distance on sequences sampled from ``x``: one row with the mean difference of log-likelihood per item."""
    s = score_all(seqs.select("seq_id", "obs"), [x, y])
    return s.agg((F.sum(F.col("scores")[0] - F.col("scores")[1]) / F.sum(F.size("obs"))).alias("distance"))


def distances(x: Hmm, y: Hmm, of_x: DataFrame, of_y: DataFrame) -> DataFrame:
    """One row: ``there`` and ``back``, the distances on sequences sampled from ``x`` and from ``y``, and ``distance``, their mean."""
    both = of_x.select("seq_id", "obs", F.lit(True).alias("own")).unionByName(of_y.select("seq_id", "obs", F.lit(False).alias("own")))
    s = score_all(both, [x, y]).select("own", F.size("obs").alias("n"), (F.col("scores")[0] - F.col("scores")[1]).alias("gain"))
    there, back = (F.sum(F.when(side, sign * F.col("gain"))) / F.sum(F.when(side, F.col("n"))) for side, sign in ((F.col("own"), 1), (~F.col("own"), -1)))
    return s.agg(there.alias("there"), back.alias("back"), ((there + back) / 2).alias("distance"))


def _joint(batches: Iterator[pa.RecordBatch], model: Hmm, path: str, classes: str | None) -> Iterator[pa.RecordBatch]:
    quiet = np.zeros(model.n, bool)
    quiet[model.silent] = True
    with np.errstate(divide="ignore"):
        la, lpi = np.log(model.a), np.log(model.pi)
    for batch in batches:
        obs, out = chain.ragged(batch.column("obs")), [None] * batch.num_rows
        cls = _whole(batch, classes, obs) if classes else None
        paths = batch.column(path).to_pylist()
        known = batch.column("obs").is_valid().to_pylist()
        for at, n, x in chain.padded(*obs, model.n):
            with np.errstate(divide="ignore"):
                le = np.log(chain.emissions(model, x))
            for k, r in enumerate(at.tolist()):
                if not known[r] or paths[r] is None:
                    continue
                q = np.array(paths[r], np.int64)
                item = np.cumsum(~quiet[q]) - 1  # the last item emitted at each step
                if (0 if not len(q) else int(item[-1]) + 1) != n[k]:
                    out[r] = float("-inf")
                    continue
                step = np.zeros(max(len(q) - 1, 0), np.int64) if cls is None else np.nan_to_num(cls[obs[1][r] + np.maximum(item[:-1], 0)]).astype(np.int64)
                moves = la[step, q[:-1], q[1:]].sum() if len(q) > 1 else 0.0
                loud = ~quiet[q]
                out[r] = float(lpi[q[0]] + moves + le[k, item[loud], q[loud]].sum()) if len(q) else 0.0
        yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array(out, pa.float64())], names=["seq_id", "logp"])


def joint_log_likelihood(seqs: DataFrame, model: Hmm, path: str, classes: str | None = None) -> DataFrame:
    """``seq_id, logp``: log probability of each sequence together with the states of the column ``path``, silent ones included.

    For models of all kinds; :func:`hiddenpath.functions.folds.joint_log_likelihood` is the column form for plain ones. A path
    that emits more or fewer items than there are gives -Infinity, a null sequence or path null. A silent state before the
    first item takes the start chance, as in decoding.
    """
    known_classes(model, classes is not None)
    names = ["seq_id", "obs", path, *([classes] if classes else [])]
    kind = seqs.schema["seq_id"].dataType.simpleString()
    return seqs.select(*names).mapInArrow(partial(_joint, model=model, path=path, classes=classes), f"seq_id {kind}, logp double")


def _curve(batches: Iterator[pa.RecordBatch], models: list[Hmm], every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        obs = chain.ragged(batch.column("obs"))
        sums: dict[int, list[float]] = {}
        for _, n, x in chain.padded(*obs, max(m.n for m in models)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.subtract(*[np.cumsum(np.log(chain.forward(m, chain.emissions(m, x), n)[1]), 1) for m in models])
            for t in range(every, x.shape[1] + 1, every):
                long = n >= t
                total = sums.setdefault(t, [0, 0.0])
                total[0] += int(long.sum())
                total[1] += float(gain[long, t - 1].sum())
        yield pa.RecordBatch.from_pydict({"items": pa.array(list(sums), pa.int32()), "n": pa.array([v[0] for v in sums.values()], pa.int64()), "gain": pa.array([v[1] for v in sums.values()], pa.float64())})


def distance_curve(x: Hmm, y: Hmm, seqs: DataFrame, every: int) -> DataFrame:
    """Model distance at checkpoints: ``items, n, distance``, the mean difference of log-likelihood per item over the first
    ``items`` (``every``, twice that, ...) of the ``n`` sequences that have so many."""
    if any(m.silent or len(m.a) > 1 for m in (x, y)):
        raise ValueError("checkpoints need models without silent states and with one transition class")
    parts = seqs.select("obs").mapInArrow(partial(_curve, models=[x, y], every=every), "items int, n long, gain double")
    return parts.groupBy("items").agg(F.sum("n").alias("n"), (F.sum("gain") / (F.sum("n") * F.col("items"))).alias("distance"))
