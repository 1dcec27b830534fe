"""Pair models: two sequences consumed side by side, state by state.

A state takes ``dx`` items of the first and ``dy`` of the second sequence; its table has an entry per pair of symbols,
or per symbol where it takes items of one of them only. Of several items taken at once the last is emitted. Sequences may
have several tracks, of which each state reads one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hiddenpath.functions import chain
from hiddenpath.model import EPS

#: Cells (places x states) of a table that is traced back at once; larger alignments go by strips or are halved first.
MOST_CELLS = 4_000_000

#: Classes of the steps that leave the cells (u, v): arrays of u and v to an array of classes.
Chooser = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass
class PairHmm:
    pi: np.ndarray
    #: Classes x n x n; the class of a step is that of ``chooser`` at the source's place.
    a: np.ndarray
    b: list[np.ndarray]
    #: Items of x and of y that each state takes.
    steps: list[tuple[int, int]]
    #: Symbols of the alphabet, or of each track's.
    m: int | list[int]
    chooser: Chooser | None = None
    #: The track that each state reads; without, sequences have one.
    tracks: list[int] | None = None

    def __post_init__(self) -> None:
        self.pi, self.a = np.asarray(self.pi, float), np.asarray(self.a, float)
        self.a = self.a[None] if self.a.ndim == 2 else self.a
        self.b = [np.asarray(x, float).reshape(-1) for x in self.b]
        self.steps = [(int(dx), int(dy)) for dx, dy in self.steps]
        if any(dx < 0 or dy < 0 or not dx + dy for dx, dy in self.steps):
            raise ValueError("a state takes one item at least, of x, of y, or of both")
        if len(self.a) > 1 and self.chooser is None:
            raise ValueError(f"a model of {len(self.a)} transition classes needs a chooser")

    @property
    def n(self) -> int:
        return len(self.pi)

    def size(self, state: int) -> int:
        """Symbols of the track that a state reads."""
        return self.m[self.tracks[state] if self.tracks else 0] if isinstance(self.m, list) else self.m

    def check(self) -> list[str]:
        """What is wrong with the model, an empty list if nothing is."""
        bad = [] if abs(self.pi.sum() - 1) < EPS else ["pi does not sum to 1"]
        if self.a.shape[1:] != (self.n, self.n) or len(self.b) != self.n or len(self.steps) != self.n:
            return [*bad, "pi, a, b and steps differ in their number of states"]
        bad += [f"row {i} of class {c} sums to {s:g}" for (c, i), s in np.ndenumerate(self.a.sum(2)) if abs(s) > EPS and abs(s - 1) > EPS]
        for i, (x, (dx, dy)) in enumerate(zip(self.b, self.steps, strict=True)):
            if self.tracks and not 0 <= self.tracks[i] < (len(self.m) if isinstance(self.m, list) else 1):
                bad.append(f"state {i} reads a track that there isn't")
            elif len(x) != self.size(i) ** (1 + bool(dx and dy)):
                bad.append(f"state {i} has {len(x)} emissions")
            elif abs(x.sum() - 1) > EPS:
                bad.append(f"emissions of state {i} do not sum to 1")
        return bad

    def to_json(self) -> str:
        """All of the model but its chooser."""
        return json.dumps({"pi": self.pi.tolist(), "a": self.a.tolist(), "b": [x.tolist() for x in self.b], "steps": self.steps, "m": self.m, "tracks": self.tracks})


def model_of_json(text: str, chooser: Chooser | None = None) -> PairHmm:
    """The model of :meth:`PairHmm.to_json`; ValueError where it isn't valid."""
    model = PairHmm(**json.loads(text), chooser=chooser)
    if bad := model.check():
        raise ValueError("; ".join(bad))
    return model


def _before(x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The items before the places ``u``, the first ones at place 0; zeros of an empty sequence."""
    return x[..., np.maximum(u - 1, 0)] if x.shape[-1] else np.zeros((*x.shape[:-1], len(u)))


def sum_below(limit: float) -> Chooser:
    """Class 0 where the two items at a place sum to less than ``limit``, else 1."""
    return lambda x, y, u, v: (_before(x, u) + _before(y, v) >= limit).astype(int)


def both_nonzero(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return ((_before(x, u) != 0) & (_before(y, v) != 0)).astype(int)


def either_nonzero(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return ((_before(x, u) != 0) | (_before(y, v) != 0)).astype(int)


class _Tables:
    """Log chances of a model on two sequences. Symbols outside an alphabet are impossible."""

    def __init__(self, model: PairHmm, x: np.ndarray, y: np.ndarray) -> None:
        self.model, self.x, self.y = model, np.asarray(x), np.asarray(y)
        with np.errstate(divide="ignore"):
            self.a, self.pi = np.log(model.a), np.log(model.pi)
            logs = [np.log(b) for b in model.b]
        self.lx, self.ly = self.x.shape[-1], self.y.shape[-1]
        self.emit: list[tuple] = []
        for s, (dx, dy) in enumerate(model.steps):
            m = model.size(s)
            xs, ys = (self._coded(v, s, m) for v in (self.x, self.y))
            if dx and dy:
                table = np.full((m + 1, m + 1), -np.inf)
                table[:m, :m] = logs[s].reshape(m, m)
                self.emit.append((table.reshape(-1), xs * (m + 1), ys))
            else:
                self.emit.append((np.append(logs[s], -np.inf)[xs if dx else ys],))

    def _coded(self, v: np.ndarray, state: int, m: int) -> np.ndarray:
        v = v[self.model.tracks[state] if self.model.tracks else 0] if v.ndim == 2 else v
        return np.where((v >= 0) & (v < m), v, m).astype(np.int64)

    def emissions(self, s: int, u: slice, v: slice) -> np.ndarray:
        """Of the cells along an antidiagonal: ``u`` rising, ``v`` the places of y before them, read backwards."""
        got = self.emit[s]
        if len(got) == 3:
            return got[0][got[1][u] + got[2][v][::-1]]
        return got[0][u] if self.model.steps[s][0] else got[0][v][::-1]

    def classes(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.asarray(self.model.chooser(self.x, self.y, u, v), int)


def _sweep(t: _Tables, lo: tuple[int, int], hi: tuple[int, int], before: int | None, middle: int | None = None, back: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Scores of the states in the last cell of the segment from ``lo`` to ``hi``, which state ``before`` leads into.

    Antidiagonals are kept as far back as states reach, so memory is linear. With ``middle``, also the first cell and state at
    or behind that antidiagonal of each state's best path, as (diagonal * places + u) * states + state. ``back`` takes up
    the best predecessors of all cells. Of equal predecessors the smallest wins.
    """
    model, n = t.model, t.model.n
    length, width = hi[0] - lo[0], hi[1] - lo[1]
    ring = max(dx + dy for dx, dy in model.steps) + 1
    score = np.full((ring, n, length + 1), -np.inf)
    cross = np.full((ring, n, length + 1), -1, np.int64) if middle is not None else None
    if before is None:
        start = t.pi
    else:
        start = t.a[int(t.classes(np.array([lo[0]]), np.array([lo[1]]))[0]) if model.chooser else 0, before]
    for d in range(1, length + width + 1):
        now = d % ring
        score[now] = -np.inf
        for s, (dx, dy) in enumerate(model.steps):
            first, last = max(dx, d - width), min(length, d - dy)  # places of x after the step
            if first > last or d - dx - dy < 0:
                continue
            old = (d - dx - dy) % ring
            came = slice(first - dx, last - dx + 1)
            cls = t.classes(lo[0] + np.arange(first - dx, last - dx + 1), lo[1] + d - dy - np.arange(first, last + 1)) if model.chooser else None
            best, via = np.full(last - first + 1, -np.inf), np.zeros(last - first + 1, np.int16)
            for p in range(n):
                step = t.a[0, p, s] if cls is None else t.a[cls, p, s]
                if cls is None and step == -np.inf:
                    continue
                got = score[old, p, came] + step
                better = got > best
                best[better], via[better] = got[better], p
            if d == dx + dy:  # from the segment's first cell
                best[dx - first], via[dx - first] = start[s], -1
            best += t.emissions(s, slice(lo[0] + first - 1, lo[0] + last) if dx else slice(0, 0), slice(lo[1] + d - last - 1, lo[1] + d - first) if dy else slice(0, 0))
            score[now, s, first : last + 1] = best
            places = np.arange(first, last + 1)
            if back is not None:
                back[places, d - places, s] = via
            if cross is not None and d >= middle:
                if d - dx - dy < middle:
                    cross[now, s, first : last + 1] = (d * (length + 1) + places) * n + s
                else:
                    cross[now, s, first : last + 1] = cross[old][np.maximum(via, 0), places - dx]
    end = (length + width) % ring
    return score[end, :, length], cross[end, :, length] if cross is not None else None


def _traced(t: _Tables, lo: tuple[int, int], hi: tuple[int, int], before: int | None, end: int | None) -> tuple[list[int], float]:
    back = np.full((hi[0] - lo[0] + 1, hi[1] - lo[1] + 1, t.model.n), -1, np.int16)
    last, _ = _sweep(t, lo, hi, before, back=back)
    q = int(last.argmax()) if end is None else end
    logp, u, v, path = float(last[q]), hi[0] - lo[0], hi[1] - lo[1], []
    if not np.isfinite(logp):
        return [], logp
    while q >= 0:
        path.append(q)
        p = int(back[u, v, q])
        u, v, q = u - t.model.steps[q][0], v - t.model.steps[q][1], p
    return path[::-1], logp


def align(model: PairHmm, x: np.ndarray, y: np.ndarray, end: int | None = None, lo: tuple[int, int] = (0, 0), hi: tuple[int, int] | None = None, before: int | None = None, most_cells: int = MOST_CELLS) -> tuple[list[int], float]:
    """The likeliest state path that takes all of both sequences, and its log probability; impossible: empty, -inf.

    ``end`` is the last state, if given. ``lo`` and ``hi`` bound a segment, which state ``before`` leads into: without, it
    begins with the start chances. A table of over ``most_cells`` cells is not built: a sweep finds where the best path crosses the middle
    antidiagonal, and both halves are aligned by themselves. Memory is linear in the lengths, time about twice that of one sweep.
    """
    t = _Tables(model, x, y)
    hi = (t.lx, t.ly) if hi is None else hi
    if lo == hi:
        return [], 0.0
    reach = max(dx + dy for dx, dy in model.steps)
    path: list[int] = []
    logp, todo = None, [(lo, hi, before, end)]
    while todo:
        a, b, first, last = todo.pop()
        length, width = b[0] - a[0], b[1] - a[1]
        if (length + 1) * (width + 1) * model.n <= most_cells or length + width <= 4 * reach:
            part, value = _traced(t, a, b, first, last)
            logp = value if logp is None else logp
            if not part:
                return [], -np.inf
            path += part
            continue
        scores, cross = _sweep(t, a, b, first, middle=(length + width) // 2)
        q = int(scores.argmax()) if last is None else last
        logp = float(scores[q]) if logp is None else logp
        if not np.isfinite(scores[q]):
            return [], -np.inf
        cell, state = divmod(int(cross[q]), model.n)
        d, u = divmod(cell, length + 1)
        turn = (a[0] + u, a[1] + d - u)
        todo += [(turn, b, state, q), (a, turn, first, state)]  # the first half comes first
    return path, float(logp)


def _logs(model: PairHmm) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Log chances of a model of one track and class; its tables have an impossible symbol more."""
    m = model.m
    with np.errstate(divide="ignore"):
        tables = [np.pad(np.log(b).reshape(m, m) if dx and dy else np.log(b), [(0, 1)] * (1 + bool(dx and dy)), constant_values=-np.inf) for b, (dx, dy) in zip(model.b, model.steps, strict=True)]
        return np.log(model.a[0]), np.log(model.pi), tables


def align_block(model: PairHmm, xs: list[np.ndarray], ys: list[np.ndarray]) -> list[tuple[list[int], float]]:
    """:func:`align` of whole pairs side by side, for models of one track and class.

    Shorter sequences are filled up with a symbol that no state emits, so cells beyond their ends stay impossible.
    """
    rows, n, m = len(xs), model.n, model.m
    lx, ly = np.array([len(v) for v in xs]), np.array([len(v) for v in ys])
    length, width = int(lx.max()), int(ly.max())
    x, y = np.full((rows, length), m), np.full((rows, width), m)
    for to, vs in ((x, xs), (y, ys)):
        for k, v in enumerate(vs):
            to[k, : len(v)] = np.where((v >= 0) & (v < m), v, m)
    la, lpi, tables = _logs(model)
    ring = max(dx + dy for dx, dy in model.steps) + 1
    score = np.full((ring, n, rows, length + 1), -np.inf)
    back = np.full((length + width + 1, n, rows, length + 1), -1, np.int8)
    final = np.full((rows, n), -np.inf)
    for d in range(1, length + width + 1):
        now = d % ring
        score[now] = -np.inf
        for s, (dx, dy) in enumerate(model.steps):
            first, last = max(dx, d - width), min(length, d - dy)
            if first > last or d - dx - dy < 0:
                continue
            old = (d - dx - dy) % ring
            best, via = np.full((rows, last - first + 1), -np.inf), np.zeros((rows, last - first + 1), np.int8)
            for p in np.flatnonzero(la[:, s] > -np.inf):
                got = score[old, p, :, first - dx : last - dx + 1] + la[p, s]
                better = got > best
                best[better], via[better] = got[better], p
            if d == dx + dy:
                best[:, dx - first], via[:, dx - first] = lpi[s], -1
            u, v = x[:, first - 1 : last] if dx else None, y[:, d - last - 1 : d - first][:, ::-1] if dy else None
            score[now, s, :, first : last + 1] = best + (tables[s][u, v] if dx and dy else tables[s][u if dx else v])
            back[d, s, :, first : last + 1] = via
        done = np.flatnonzero(lx + ly == d)
        final[done] = score[now][:, done, lx[done]].T
    logp = np.where(lx + ly > 0, final.max(1), 0.0)
    q = np.where(np.isfinite(logp) & (lx + ly > 0), final.argmax(1), -1)
    u, v, steps, out = lx.copy(), ly.copy(), np.array(model.steps), [[] for _ in range(rows)]
    while (live := np.flatnonzero(q >= 0)).size:
        for k, state in zip(live.tolist(), q[live].tolist(), strict=True):
            out[k].append(state)
        before = back[u[live] + v[live], q[live], live, u[live]]
        u[live], v[live] = u[live] - steps[q[live], 0], v[live] - steps[q[live], 1]
        q[live] = before
    return [(p[::-1], float(s)) for p, s in zip(out, logp, strict=True)]


#: Strips of antidiagonals that a table is cut into, if their own tables are small enough, and at most.
STRIPS, MOST_STRIPS = 32, 64


def strip_height(model: PairHmm, lengths: int, most_cells: int) -> int | None:
    """Antidiagonals of a strip for sequences of ``lengths`` items together; None where MOST_STRIPS strips would have tables of over ``most_cells`` cells."""
    reach = max(dx + dy for dx, dy in model.steps)
    most = int((most_cells / model.n) ** 0.5) - reach - 1
    height = max(1, min(-(-lengths // STRIPS), most))
    return height if height <= most and lengths <= MOST_STRIPS * height else None


class _Emitted:
    """Log emissions of sequences side by side: ``x`` and ``y`` have a column per pair, ``y`` backwards; ``u`` and ``v`` slice them."""

    def __init__(self, model: PairHmm, tables: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> None:
        self.steps = model.steps
        self.by = [(t.reshape(-1), x * (model.m + 1), y) if dx and dy else (t[x if dx else y],) for t, (dx, dy) in zip(tables, model.steps, strict=True)]
        self.codes = np.empty(x.shape, np.int64)

    def add(self, s: int, u: slice, v: slice, to: np.ndarray, spare: np.ndarray) -> None:
        got = self.by[s]
        if len(got) == 3:
            codes = np.add(got[1][u], got[2][v], out=self.codes[: len(to)])
            to += np.take(got[0], codes, out=spare, mode="clip")
        else:
            to += got[0][u if self.steps[s][0] else v]


def _entered(old: np.ndarray, la: np.ndarray, s: int, to: np.ndarray, spare: np.ndarray) -> None:
    """The best of the states' scores ``old`` with their steps into state ``s``."""
    np.add(old[0], la[0, s], out=to)
    for p in range(1, len(la)):
        if la[p, s] > -np.inf:
            np.maximum(to, np.add(old[p], la[p, s], out=spare), out=to)


def _sweep_block(model: PairHmm, logs: tuple, x: np.ndarray, y: np.ndarray, lx: np.ndarray, ly: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the states in the last cell of each pair, and those of all cells on the antidiagonals 0, height, 2 height, ... and
    those before them that states reach back to: of shape (strips, reach, states, places of x, pairs)."""
    la, lpi, tables = logs
    n, length, width, rows = model.n, len(x), len(y), x.shape[1]
    reach = max(dx + dy for dx, dy in model.steps)
    emitted = _Emitted(model, tables, x, y[::-1])
    score = np.full((reach + 1, n, length + 1, rows), -np.inf)
    kept = np.full((-(-(length + width) // height), reach, n, length + 1, rows), -np.inf)
    spare, final = np.empty((length + 1, rows)), np.full((rows, n), -np.inf)
    for d in range(1, length + width + 1):
        now = d % (reach + 1)
        for s, (dx, dy) in enumerate(model.steps):
            first, last = max(dx, d - width), min(length, d - dy)
            if first > last or d - dx - dy < 0:
                continue
            best, free = score[now, s, first : last + 1], spare[: last - first + 1]
            _entered(score[(d - dx - dy) % (reach + 1), :, first - dx : last - dx + 1], la, s, best, free)
            if d == dx + dy:
                best[dx - first] = lpi[s]
            emitted.add(s, slice(first - 1, last), slice(width - d + first, width - d + last + 1), best, free)
        if d % height == 0 and d // height < len(kept):
            for j in range(min(reach, d + 1)):
                kept[d // height, reach - 1 - j] = score[(d - j) % (reach + 1)]
        done = np.flatnonzero(lx + ly == d)
        final[done] = score[now][:, lx[done], done].T
    return final, kept


def align_strips(model: PairHmm, xs: list[np.ndarray], ys: list[np.ndarray], height: int) -> list[tuple[list[int], float]]:
    """:func:`align_block` in linear space: one sweep keeps the scores of every ``height``-th antidiagonal, then the strips between these
    are gone through from the last to the first, each only in the cells that the best path can have come through.

    A strip's table has about ``height`` squared cells. Paths and scores are those of the whole table: of equal predecessors the smallest wins.
    """
    logs = la, lpi, tables = _logs(model)
    rows, n, m, steps = len(xs), model.n, model.m, model.steps
    lx, ly = np.array([len(v) for v in xs]), np.array([len(v) for v in ys])
    length, width = int(lx.max()), int(ly.max())
    x, y = np.full((length, rows), m, np.int64), np.full((width, rows), m, np.int64)
    for to, vs in ((x, xs), (y, ys)):
        for k, v in enumerate(vs):
            to[: len(v), k] = np.where((v >= 0) & (v < m), v, m)
    final, kept = _sweep_block(model, logs, x, y, lx, ly, height)
    logp = np.where(lx + ly > 0, final.max(1), 0.0)
    state, d, u = np.where(np.isfinite(logp) & (lx + ly > 0), final.argmax(1), -1), lx + ly, lx.copy()
    reach, everyone = max(dx + dy for dx, dy in steps), np.arange(rows)
    side = height + reach + 1  # places of x, up to that of each pair's path
    table, spare, out = np.empty((reach + height, n, side, rows)), np.empty((side, rows)), [[] for _ in range(rows)]
    moves = [[(p, float(la[p, s])) for p in range(n) if la[p, s] > -np.inf] for s in range(n)]
    for k in range(len(kept) - 1, -1, -1):
        least = k * height  # the strip's antidiagonals come after this one
        left = u - side + 1
        places = left + np.arange(side)[:, None]
        table[:] = -np.inf
        table[:reach] = np.where(places >= 0, kept[k][:, :, np.maximum(places, 0), everyone], -np.inf)
        at = places - 1
        there = least + height - left - 1 - np.arange(side + height - 1)[:, None]  # items of y, backwards, of the last antidiagonal on
        codes = [np.where((i >= 0) & (i < len(v)), v[np.clip(i, 0, max(len(v) - 1, 0)), everyone] if len(v) else m, m) for v, i in ((x, at), (y, there))]
        emitted = _Emitted(model, tables, *codes)
        for t in range(reach, reach + height):
            for s, (dx, dy) in enumerate(steps):
                best, free = table[t, s, dx:], spare[dx:]
                _entered(table[t - dx - dy, :, : side - dx], la, s, best, free)
                if least + t - reach + 1 == dx + dy:
                    begun = np.flatnonzero((left <= 0) & (dx - left < side))
                    best[-left[begun], begun] = lpi[s]
                back = reach + height - 1 - t
                emitted.add(s, slice(dx, None), slice(back + dx, back + side), best, free)
        for r in np.flatnonzero((state >= 0) & (d > least)).tolist():
            t, i, q, path = int(d[r]) - least + reach - 1, side - 1, int(state[r]), out[r]
            begins, low = reach - 1 - least, int(left[r])
            while t >= reach and q >= 0:
                path.append(q)
                dx, dy = steps[q]
                t, i = t - dx - dy, i - dx
                if t == begins and low + i == 0:
                    q = -1
                    break
                top, via = -np.inf, 0
                for p, step in moves[q]:
                    if (got := table.item(t, p, i, r) + step) > top:
                        top, via = got, p
                q = via
            d[r], u[r], state[r] = t + least - reach + 1, low + i, q
    return [(p[::-1], float(s)) for p, s in zip(out, logp, strict=True)]


#: Cells of the tables of a block of pairs.
BLOCK_CELLS = 24_000_000


def _blocks(model: PairHmm, lx: np.ndarray, ly: np.ndarray, cells: Callable[[int, int], float] | None = None, most: int | None = None) -> Iterator[list[int]]:
    """Pairs of like lengths, as many as ``most`` cells hold (BLOCK_CELLS); ``cells`` tells those of a pair, without: its whole table's."""
    cells = cells or (lambda length, width: (length + width + 1) * (length + 1) * model.n)
    most = BLOCK_CELLS if most is None else most
    block: list[int] = []
    width = 0
    for k in np.lexsort((ly, lx)).tolist():
        length, width = int(lx[k]), max(width, int(ly[k]))
        if block and (len(block) + 1) * cells(length, width) > most:
            yield block
            block, width = [], int(ly[k])
        block.append(k)
    if block:
        yield block


def _strip_cells(model: PairHmm, length: int, width: int, most_cells: int) -> float:
    """Cells that :func:`align_strips` holds for a pair; infinite where :func:`strip_height` is None."""
    reach = max(dx + dy for dx, dy in model.steps)
    height = strip_height(model, length + width, most_cells)
    return np.inf if height is None else model.n * ((-(-(length + width) // height) * reach + reach + 3) * (length + 1) + (height + reach + 1) ** 2)


def path_log_likelihood(model: PairHmm, x: np.ndarray, y: np.ndarray, path: list[int]) -> float:
    """Log probability of a path with both sequences; -inf where it is impossible or doesn't take all of them."""
    t = _Tables(model, x, y)
    u = v = 0
    total, before = 0.0, None
    for q in path:
        dx, dy = model.steps[q]
        if u + dx > t.lx or v + dy > t.ly:
            return -np.inf
        c = 0 if model.chooser is None or before is None else int(t.classes(np.array([u]), np.array([v]))[0])
        total += float(t.pi[q] if before is None else t.a[c, before, q])
        u, v, before = u + dx, v + dy, q
        total += float(t.emissions(q, slice(u - 1, u) if dx else slice(0, 0), slice(v - 1, v) if dy else slice(0, 0))[0])
    return total if (u, v) == (t.lx, t.ly) else -np.inf


def _sequences(column: pa.Array) -> list[np.ndarray | None]:
    """Codes of each row, of shape (items) or (tracks, items); unknown ones are -1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_list(column.type.value_type):
        values, at = chain.ragged(column)
        coded = np.nan_to_num(values, nan=-1).astype(np.int64)
        return [coded[a:b] if ok else None for a, b, ok in zip(at[:-1], at[1:], column.is_valid().to_pylist(), strict=True)]
    rows = []
    for row in column.to_pylist():
        if row is not None and len({len(r or []) for r in row}) > 1:
            raise ValueError("the tracks of a sequence have one length")
        rows.append(None if row is None else np.array([[-1 if v is None else v for v in r or []] for r in row], np.int64).reshape(len(row), -1))
    return rows


def _align(batches: Iterator[pa.RecordBatch], model: PairHmm, segment: str | None, most_cells: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, ys = (_sequences(batch.column(c)) for c in ("x", "y"))
        parts = batch.column(segment).to_pylist() if segment else [None] * batch.num_rows
        paths, logp = [None] * batch.num_rows, [None] * batch.num_rows
        left = [r for r, (x, y) in enumerate(zip(xs, ys, strict=True)) if x is not None and y is not None]
        if not segment and model.chooser is None and isinstance(model.m, int) and not model.tracks and model.n < 127:
            small = [r for r in left if (len(xs[r]) + 1) * (len(ys[r]) + 1) * model.n <= min(most_cells, BLOCK_CELLS // 8) and xs[r].ndim == ys[r].ndim == 1]
            for block in _blocks(model, np.array([len(xs[r]) for r in small]), np.array([len(ys[r]) for r in small])) if small else ():
                for k, (path, value) in zip(block, align_block(model, [xs[small[k]] for k in block], [ys[small[k]] for k in block]), strict=True):
                    paths[small[k]], logp[small[k]] = path, value
            done = set(small)
            cells, most = partial(_strip_cells, model, most_cells=most_cells), BLOCK_CELLS // 4  # doubles
            long = [r for r in left if r not in done and xs[r].ndim == ys[r].ndim == 1 and cells(len(xs[r]), len(ys[r])) <= most]
            for block in _blocks(model, np.array([len(xs[r]) for r in long]), np.array([len(ys[r]) for r in long]), cells, most) if long else ():
                x, y = [xs[long[k]] for k in block], [ys[long[k]] for k in block]
                for k, (path, value) in zip(block, align_strips(model, x, y, strip_height(model, max(map(len, x)) + max(map(len, y)), most_cells)), strict=True):
                    paths[long[k]], logp[long[k]] = path, value
            done.update(long)
            left = [r for r in left if r not in done]
        for r in left:
            p = parts[r]
            how = {} if p is None else {"lo": (p["u0"], p["v0"]), "hi": (p["u1"], p["v1"]), "before": p["before"], "end": p["end"]}
            paths[r], logp[r] = align(model, xs[r], ys[r], most_cells=most_cells, **how)
        yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(paths, pa.list_(pa.int32())), pa.array(logp, pa.float64())], names=["pair_id", "path", "logp"])


def _scored(batches: Iterator[pa.RecordBatch], model: PairHmm, path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(_sequences(batch.column("x")), _sequences(batch.column("y")), batch.column(path).to_pylist(), strict=True)
        logp = [None if x is None or y is None or p is None else path_log_likelihood(model, x, y, p) for x, y, p in rows]
        yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(logp, pa.float64())], names=["pair_id", "logp"])


def score_paths(pairs: DataFrame, model: PairHmm, path: str) -> DataFrame:
    """``pair_id, logp`` of rows ``pair_id, x, y`` and the states of the column ``path``: -Infinity where these don't take all items, null for nulls."""
    return pairs.select("pair_id", "x", "y", path).mapInArrow(partial(_scored, model=model, path=path), f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, logp double")


def align_pairs(pairs: DataFrame, model: PairHmm, segment: str | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """``pair_id, path, logp`` of rows ``pair_id, x, y``: the likeliest alignment. Null sequences give nulls, an impossible
    pair an empty path and -Infinity.

    ``x`` and ``y`` are arrays of codes, or of tracks of codes. ``segment`` names a struct column ``u0, v0, u1, v1, before, end`` that bounds
    each row's alignment as in :func:`align`; a null struct aligns all. A pair's table has ``most_cells`` cells at most, whatever the lengths:
    larger ones go by strips, side by side (:func:`align_strips`), where the model is plain and their kept antidiagonals fit a block, else by halves.
    """
    names = ["pair_id", "x", "y", *([segment] if segment else [])]
    return pairs.select(*names).mapInArrow(partial(_align, model=model, segment=segment, most_cells=most_cells), f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, path array<int>, logp double")
