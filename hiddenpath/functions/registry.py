"""SQL names for scoring and decoding with a model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hiddenpath.functions import chain
from hiddenpath.model import Hmm
from hiddenpath.operators.decoding import known_classes


def register(spark: SparkSession, name: str, model: Hmm) -> None:
    """SQL functions ``<name>_logp(obs)``, ``<name>_path(obs)`` and ``<name>_posterior(obs)`` over arrays of codes or reals; null for null.

    The table function ``<name>_decode(obs)`` gives the likeliest path in long form, ``t, state, label``, and joins laterally:
    ``SELECT s.seq_id, d.t, d.state FROM seqs s, LATERAL <name>_decode(s.obs) d``. Null, empty and impossible sequences have no rows there; an
    impossible sequence has posteriors of zeros. With silent states, ``t`` counts the states of the path.
    """
    known_classes(model, False, "the Arrow operators and a column of classes")

    def run(obs: pd.Series, what: str) -> list:
        one = pa.list_(pa.float64()) if getattr(model, "dim", 1) > 1 else pa.float64()
        column = pa.array([None if o is None else list(o) for o in obs], pa.list_(one))
        known, out = column.is_valid().to_pylist(), [None] * len(obs)
        for at, n, x in chain.padded(*chain.ragged(column), model.n):
            e = chain.emissions(model, x)
            if what == "path":
                got = [p.tolist() for p in chain.viterbi(model, e, n)[0]]
            else:
                alpha, scale, score = chain.forward(model, e, n)
                got = score.tolist() if what == "logp" else [p[:k].tolist() for p, k in zip(alpha * chain.backward(model, e, n, scale), n, strict=True)]
            for k, r in enumerate(at.tolist()):
                out[r] = got[k] if known[r] else None
        return out

    @F.pandas_udf("double")
    def logp(obs: pd.Series) -> pd.Series:
        return pd.Series(run(obs, "logp"), dtype="float64")

    @F.pandas_udf("array<int>")
    def path(obs: pd.Series) -> pd.Series:
        return pd.Series(run(obs, "path"), dtype="object")

    @F.pandas_udf("array<array<double>>")
    def posterior(obs: pd.Series) -> pd.Series:
        return pd.Series(run(obs, "posterior"), dtype="object")

    labels = [str(v) for v in model.labels] if model.labels else [None] * model.n
    dims = getattr(model, "dim", 1)

    class Decode:
        def eval(self, obs: list | None) -> Iterator[tuple[int, int, str | None]]:
            if not obs:
                return
            x = np.array([[np.nan] * dims if v is None and dims > 1 else np.nan if v is None else v for v in obs], float)[None]
            path = chain.viterbi(model, chain.emissions(model, x), np.array([len(obs)]))[0][0]
            for t, q in enumerate(path.tolist()):
                yield t, q, labels[q]

    spark.udtf.register(f"{name}_decode", F.udtf(Decode, returnType="t int, state int, label string"))
    spark.udf.register(f"{name}_logp", logp)
    spark.udf.register(f"{name}_posterior", posterior)
    spark.udf.register(f"{name}_path", path)
