"""Pair alignments: all paths, linear space, segments, tracks, classes, stored models."""

import itertools
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from hiddenpath.operators import pairs
from hiddenpath.plans import catalog


def model(seed, steps, m=3, classes=1, chooser=None, tracks=None):
    rng, n = np.random.default_rng(seed), len(steps)
    sizes = [m[tracks[s]] if tracks else m for s in range(n)]
    return pairs.PairHmm(pi=rng.dirichlet([1] * n), a=rng.dirichlet([1] * n, (classes, n)), b=[rng.dirichlet([1] * k ** (1 + bool(dx and dy))) for k, (dx, dy) in zip(sizes, steps)], steps=steps, m=m, chooser=chooser, tracks=tracks)


PLAIN = [(1, 1), (1, 0), (0, 1)]
WIDE = [(1, 1), (2, 0), (0, 1), (2, 3), (3, 1)]


def all_paths(m, lx, ly):
    """State paths that take all items."""
    out = []

    def go(u, v, path):
        if (u, v) == (lx, ly):
            out.append(path)
        for s, (dx, dy) in enumerate(m.steps):
            if u + dx <= lx and v + dy <= ly:
                go(u + dx, v + dy, [*path, s])

    go(0, 0, [])
    return [p for p in out if p]


CHOOSERS = [None, pairs.sum_below(2), pairs.both_nonzero, pairs.either_nonzero]


@pytest.mark.parametrize("steps,chooser", list(itertools.product([PLAIN, WIDE], CHOOSERS)))
def test_all_paths(steps, chooser):
    m = model(3, steps, classes=2 if chooser else 1, chooser=chooser)
    rng = np.random.default_rng(1)
    for lx, ly in [(0, 1), (1, 0), (2, 3), (4, 3), (5, 4)]:
        x, y = rng.integers(0, 3, lx), rng.integers(0, 3, ly)
        scored = [(pairs.path_log_likelihood(m, x, y, p), p) for p in all_paths(m, lx, ly)]
        path, logp = pairs.align(m, x, y)
        if not scored:
            assert path == [] and logp == -math.inf
            continue
        assert logp == pytest.approx(max(s for s, _ in scored)) and pairs.path_log_likelihood(m, x, y, path) == pytest.approx(logp)
        for end in range(len(steps)):
            ending = [s for s, p in scored if p[-1] == end]
            assert pairs.align(m, x, y, end)[1] == (pytest.approx(max(ending)) if ending else -math.inf)
    assert pairs.align(m, np.zeros(0, int), np.zeros(0, int)) == ([], 0.0)


@pytest.mark.parametrize("steps,chooser", [(PLAIN, None), (WIDE, None), (PLAIN, pairs.sum_below(2)), (WIDE, pairs.either_nonzero)])
def test_linear_space(steps, chooser):
    """Halved again and again, alignments are as likely as those of the whole table; several may be equally likely."""
    m = model(5, steps, classes=2 if chooser else 1, chooser=chooser)
    rng = np.random.default_rng(2)
    for lx, ly in [(40, 55), (90, 13), (7, 120), (64, 64), (1, 80)]:
        x, y = rng.integers(0, 3, lx), rng.integers(0, 3, ly)
        whole = pairs.align(m, x, y)
        for most in (200, 1500):
            path, logp = pairs.align(m, x, y, most_cells=most)
            assert logp == pytest.approx(whole[1]) and (pairs.path_log_likelihood(m, x, y, path) if path else -math.inf) == pytest.approx(logp)
        for end in range(len(steps)):
            path, logp = pairs.align(m, x, y, end, most_cells=200)
            assert logp == pytest.approx(pairs.align(m, x, y, end)[1]) and (not path or path[-1] == end)


def test_segments():
    """The best path's part between two of its cells is the best of that segment, and the parts add up."""
    m = model(7, WIDE, classes=2, chooser=pairs.sum_below(2))
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 3, 60), rng.integers(0, 3, 50)
    path, logp = pairs.align(m, x, y)
    cells = np.cumsum([(0, 0), *[m.steps[q] for q in path]], axis=0).tolist()
    k, j = len(path) // 3, 2 * len(path) // 3
    parts = [pairs.align(m, x, y, end, tuple(cells[a]), tuple(cells[b]), before, most_cells=300) for a, b, before, end in ((0, k, None, path[k - 1]), (k, j, path[k - 1], path[j - 1]), (j, len(path), path[j - 1], None))]
    whole = sum((p for p, _ in parts), [])
    assert pairs.path_log_likelihood(m, x, y, whole) == pytest.approx(logp) and sum(v for _, v in parts) == pytest.approx(logp)


def test_memory_is_linear():
    m = model(9, PLAIN)
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 3, 1000), rng.integers(0, 3, 1000)
    tracemalloc.start()
    path, logp = pairs.align(m, x, y, most_cells=100_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # the table has 3 million cells
    assert pairs.path_log_likelihood(m, x, y, path) == pytest.approx(logp)


def test_unknown_symbols_and_impossible_pairs(spark):
    m = model(3, PLAIN)
    rows = [(1, [0, 9], [1, 1]), (2, None, [1]), (3, [], []), (4, [0, None], [1]), (5, [0, 1], [1])]
    got = {r.pair_id: r for r in pairs.align_pairs(spark.createDataFrame(rows, "pair_id int, x array<int>, y array<int>"), m).collect()}
    assert got[1].path == [] and got[1].logp == -math.inf and got[4].path == [] and got[2].path is None and got[2].logp is None
    assert got[3].path == [] and got[3].logp == 0 and got[5].logp == pytest.approx(pairs.align(m, np.array([0, 1]), np.array([1]))[1])


def test_tracks_and_segments_of_rows(spark):
    m = model(11, [(1, 1), (1, 0), (0, 1), (2, 1)], m=[2, 4], tracks=[1, 0, 0, 1])
    assert m.check() == []
    rng = np.random.default_rng(8)
    x, y = (np.stack([rng.integers(0, 2, k), rng.integers(0, 4, k)]) for k in (5, 4))
    scored = max((pairs.path_log_likelihood(m, x, y, p), p) for p in all_paths(m, 5, 4))
    rows = [(1, x.tolist(), y.tolist(), None), (2, x.tolist(), y.tolist(), (1, 1, 5, 4, 0, None))]
    d = spark.createDataFrame(rows, "pair_id int, x array<array<int>>, y array<array<int>>, s struct<u0:int,v0:int,u1:int,v1:int,before:int,end:int>")
    got = {r.pair_id: r for r in pairs.align_pairs(d, m, "s").collect()}
    assert got[1].logp == pytest.approx(scored[0]) and got[1].path == scored[1]
    assert got[2].logp == pytest.approx(pairs.align(m, x, y, None, (1, 1), (5, 4), 0)[1])
    plain = {r.pair_id: r.logp for r in pairs.align_pairs(d, m).collect()}
    assert plain[1] == plain[2] == pytest.approx(scored[0])


def test_stored_models():
    m = model(13, WIDE, m=[2, 3], tracks=[0, 1, 1, 0, 0])
    back = pairs.model_of_json(m.to_json())
    assert back.steps == m.steps and back.m == m.m and back.tracks == m.tracks and (back.pi == m.pi).all() and (back.a == m.a).all() and all((p == q).all() for p, q in zip(back.b, m.b))
    m.a[0, 1] *= 0.5
    m.b[2] = m.b[2][:2]
    assert len(m.check()) == 2
    with pytest.raises(ValueError, match="row 1"):
        pairs.model_of_json(m.to_json())
    with pytest.raises(ValueError, match="chooser"):
        model(1, PLAIN, classes=2)
    with pytest.raises(ValueError, match="item"):
        model(1, [(1, 1), (0, 0)])


@pytest.mark.parametrize("steps", [PLAIN, WIDE])
def test_pairs_side_by_side(spark, monkeypatch, steps):
    """Blocks of pairs of all lengths give what each pair gives by itself."""
    m = model(17, steps)
    rng = np.random.default_rng(9)
    xs, ys = ([rng.integers(-1, 4, k) if k % 5 == 4 else rng.integers(0, 3, k) for k in rng.integers(0, 14, 60)] for _ in range(2))
    want = [pairs.align(m, x, y) for x, y in zip(xs, ys)]
    got = pairs.align_block(m, xs, ys)
    assert [p for p, _ in got] == [p for p, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want])
    monkeypatch.setattr(pairs, "BLOCK_CELLS", 4000)
    assert sorted(k for b in pairs._blocks(m, np.array(list(map(len, xs))), np.array(list(map(len, ys)))) for k in b) == list(range(60))
    d = spark.createDataFrame([(k, x.tolist(), y.tolist()) for k, (x, y) in enumerate(zip(xs, ys))], "pair_id int, x array<int>, y array<int>")
    rows = {r.pair_id: r for r in pairs.align_pairs(d, m).collect()}
    assert [rows[k].path for k in range(60)] == [p for p, _ in want] and [rows[k].logp for k in range(60)] == pytest.approx([v for _, v in want])


def long_rows(rng, lengths):
    return [rng.integers(-1, 4, k) if j % 7 == 4 else rng.integers(0, 3, k) for j, k in enumerate(lengths)]


def batch_of(xs, ys):
    return pa.RecordBatch.from_pydict({"pair_id": list(range(len(xs))), "x": [v.tolist() for v in xs], "y": [v.tolist() for v in ys]})


@pytest.mark.parametrize("steps", [PLAIN, WIDE, [(1, 1), (2, 0), (0, 1)], [(4, 4), (0, 3), (1, 0)]])
def test_strips_give_the_whole_table(steps):
    """Paths and scores by strips of all heights are those of the whole table, to the last bit and with its choice of equal paths."""
    rng = np.random.default_rng(21)
    even = model(1, steps)
    even.pi, even.a, even.b = np.full(even.n, 0.25), np.full_like(even.a, 0.25), [np.full(len(b), 0.125) for b in even.b]  # equal paths everywhere
    barred = model(2, steps)
    barred.a[0, 0, 1] = barred.pi[0] = 0
    for m in (model(0, steps), even, barred):
        xs, ys = (long_rows(rng, rng.integers(0, 40, 25)) for _ in range(2))
        want = [pairs.align(m, x, y) for x, y in zip(xs, ys)]
        for height in (1, 2, 3, 7, 16, 100):
            assert pairs.align_strips(m, xs, ys, height) == want


def test_long_pairs_are_swept_once(monkeypatch):
    """Pairs of over ``most_cells`` cells are swept side by side, not each by itself and twice; what is too long for strips is halved."""
    m, rng = model(23, PLAIN), np.random.default_rng(22)
    xs, ys = (long_rows(rng, rng.integers(90, 140, 20)) for _ in range(2))
    xs[3], ys[5] = rng.integers(0, 3, 700), rng.integers(0, 3, 700)
    want = [pairs.align(m, x, y) for x, y in zip(xs, ys)]
    calls, sweep = [], pairs._sweep
    monkeypatch.setattr(pairs, "_sweep", lambda *a, **k: calls.append(1) or sweep(*a, **k))

    def got(most):
        (out,) = pairs._align(iter([batch_of(xs, ys)]), m, None, most)
        return list(zip(out.column("path").to_pylist(), out.column("logp").to_pylist()))

    assert got(3000) == want and not calls
    monkeypatch.setattr(pairs, "BLOCK_CELLS", 800_000)
    assert got(3000) == want and not calls
    few = got(700)  # strips of 11 antidiagonals: the two pairs with 700 items have too many of them
    assert [s for _, s in few] == pytest.approx([s for _, s in want]) and 0 < len(calls) < 300
    assert all(few[k] == want[k] for k in range(20) if k not in (3, 5))


def test_strips_are_linear_in_memory():
    m = model(9, PLAIN)
    rng = np.random.default_rng(6)
    height = pairs.strip_height(m, 2000, 60_000)
    peaks = []
    for size in (1000, 2000):
        x, y = rng.integers(0, 3, size), rng.integers(0, 3, size)
        tracemalloc.start()
        ((path, logp),) = pairs.align_strips(m, [x], [y], pairs.strip_height(m, 2 * size, 60_000))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert pairs.path_log_likelihood(m, x, y, path) == pytest.approx(logp)
    assert height == 63 and peaks[0] < 4e6 and peaks[1] < 3 * peaks[0]
    assert pairs.strip_height(m, 20_000, 60_000) is None and pairs.strip_height(m, 2000, 20) is None


def test_linear_alignment_of_the_tables(spark):
    """The registered query gives the lengths and scores of whole tables."""
    d = "/root/testdata/sf0.001"
    got = {r.pair_id: (r.steps, r.logp) for r in catalog.pair_alignment_linear(spark, d).collect()}
    o, e = (spark.read.parquet(f"{d}/{t}.parquet").toPandas() for t in ("orders", "events"))
    o, e = o.sort_values(["o_orderdate", "o_orderkey"]), e.sort_values(["ts", "event_id"])
    xs = {k: [("F", "O", "P").index(v) for v in g.o_orderstatus] for k, g in o.groupby(o.o_custkey // 100)}
    ys = {k: [catalog.EVENTS.index(v) for v in g.event_type] for k, g in e.groupby(e.user_id // 15)}
    want = {k: pairs.align(catalog._LONG_PAIR, np.array(xs[k]), np.array(ys[k])) for k in xs.keys() & ys.keys()}
    assert got == {k: (len(path), pytest.approx(logp, abs=1e-4)) for k, (path, logp) in want.items()} and got
