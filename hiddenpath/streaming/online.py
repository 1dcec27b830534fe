"""The forward recursion as a stream operator: state probabilities and log-likelihood after every event.

An extension: the recursion needs nothing but its last vector, so a stream can carry it as state per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hiddenpath.functions import chain
from hiddenpath.model import DiscreteHmm, Hmm


def online_filter(events: DataFrame, model: Hmm, key: str, order: str, value: str, idle_ms: int | None = None) -> DataFrame:
    """``key, order, logp, alpha`` for each event (``value`` is encoded). Events of a micro-batch are put in order; an
    impossible event gives -Infinity and empty ``alpha`` from then on. ``idle_ms``: keys idle so long are forgotten.

    The state holds no history, so models with states of higher order, silent states or several transition classes raise an error.
    """
    if model.silent or len(model.a) > 1 or isinstance(model, DiscreteHmm) and any(model.order(i) for i in range(model.n)):
        raise ValueError("a stream filter needs a model of order 0 without silent states and with one transition class")

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        alpha, logp = (np.array(state.get[0]), state.get[1]) if state.exists else (None, 0.0)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = []
        for x in rows[value].to_numpy(float):
            if np.isfinite(logp):
                e = chain.emissions(model, np.array([[x]]))[0, 0]
                raw = (model.pi if alpha is None else alpha @ model.a[0]) * e
                total = raw.sum()
                alpha, logp = (raw / total, logp + float(np.log(total))) if total > 0 else (np.zeros(0), float("-inf"))
            out.append((logp, alpha.tolist()))
        state.update((alpha.tolist(), float(logp)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [group[0]] * len(rows), order: rows[order].to_numpy(), "logp": [p for p, _ in out], "alpha": [v for _, v in out]})

    types = {f.name: f.dataType.simpleString() for f in events.schema}
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, {order} {types[order]}, logp double, alpha array<double>", "alpha array<double>, logp double", "append", timeout)


class _Filter(StatefulProcessor):
    """Per key: the last vector and items, and the events that the watermark hasn't passed yet, in a list."""

    def __init__(self, model: Hmm, key: str, order: str, kind: str) -> None:
        self.model, self.key, self.order, self.kind = model, key, order, kind
        self.history = max([model.order(i) for i in range(model.n)], default=0) if isinstance(model, DiscreteHmm) else 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "alpha array<double>, logp double, recent array<double>, after int")
        self.waiting = handle.getListState("waiting", "at long, value double, after int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            at = part["at"].to_numpy(np.int64)
            first = int(at.min()) if first is None else min(first, int(at.min()))
            values = [None if pd.isna(v) else float(v) for v in part["value"]]
            self.waiting.appendList(list(zip(at.tolist(), values, part["cls"].astype(int).tolist(), strict=True)))
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = sorted(self.waiting.get(), key=lambda r: (r[0], r[2], r[1] is None, r[1] or 0.0))
        ready = [r for r in events if r[0] // 1000 <= passed]
        later = events[len(ready) :]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1000)
        else:
            self.waiting.clear()
        alpha, logp, recent, cls = (None, 0.0, [], 0)
        if self.now.exists():
            alpha, logp, recent, cls = self.now.get()
            alpha, recent = np.array(alpha, float), list(recent)
        loud = [i for i in range(self.model.n) if i not in self.model.silent]
        out = []
        for at, value, after in ready:
            recent = [*recent, np.nan if value is None else value][-self.history - 1 :]
            if np.isfinite(logp):
                e = chain.emissions(self.model, np.array([recent], float))[0, -1]
                alpha, total = chain.advance(self.model, alpha, e, cls)
                logp = logp + float(np.log(total)) if total > 0 else float("-inf")
            cls = after
            shown = logp + float(np.log(alpha[loud].sum())) if np.isfinite(logp) else logp
            out.append((at, shown, alpha.tolist() if np.isfinite(logp) else []))
        if ready:
            self.now.update((alpha.tolist(), float(logp), [float(v) for v in recent], cls))
            yield pd.DataFrame({self.key: [key[0]] * len(out), self.order: pd.to_datetime([r[0] for r in out], unit="us"), "logp": [r[1] for r in out], "alpha": [r[2] for r in out]})

    def close(self) -> None:
        pass


def online_history(events: DataFrame, model: Hmm, key: str, order: str, value: str, delay: str, classes: str | None = None) -> DataFrame:
    """``key, order, logp, alpha`` for each event, once the watermark has passed it: the figures that ``decode`` gives for the events
    of the key up to it, in order of time.

    ``order`` is a timestamp; events may come out of order by up to ``delay``, which is how long they are held back; later ones are dropped, as
    Spark drops rows behind the watermark. State per key: the last vector, as many items as the model's highest order, and the events
    held back. Models of any order work, with silent states and, with a column of ``classes`` (the class of the step after each event),
    several transition classes. Null values have likelihood 1; an impossible event gives -Infinity and an empty ``alpha`` from then on. Events of one
    time are taken by class and value. Sessions need the RocksDB state store.
    """
    if len(model.a) > 1 and classes is None:
        raise ValueError(f"a model of {len(model.a)} transition classes needs a column of classes")
    kind = events.schema[key].dataType.simpleString()
    micros = F.unix_micros(F.col(order).cast("timestamp")).alias("at")
    cls = F.coalesce(F.col(classes).cast("int"), F.lit(0)) if classes else F.lit(0)
    late = events.withWatermark(order, delay).select(key, order, micros, F.col(value).cast("double").alias("value"), cls.alias("cls"))
    return late.groupBy(key).transformWithStateInPandas(_Filter(model, key, order, kind), f"{key} {kind}, {order} timestamp, logp double, alpha array<double>", "append", "eventtime")
