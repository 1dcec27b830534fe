"""The filter audit, whitening and the Jaccard join against plain computations."""

import random
import re
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiddenpath.llm import filter_audit, set_join, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_failures(text):
    words = WORD.findall(text)
    fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
    return fails + "D" * bool(re.search("[#$%&*|]", text))


def plain_audit(rows, labels):
    cells = {}
    for doc, text, source in rows:
        t = text or ""
        fails = plain_failures(t) + "E" * any(d is not None and doc is not None and d < doc and (x or "") == t for d, x, _ in rows)
        good, toxic = (any(r[k] == 1 for r in labels if r[0] == doc and doc is not None) for k in (1, 2))
        for order in map("".join, permutations("ABCDE")):
            gone = next((k for k, f in enumerate(order, 1) if f in fails), 6)
            for step, f in enumerate(order, 1):
                cell = cells.setdefault((source or "", order, step), [0] * 7)
                now = [gone > step, gone == step, f in fails and gone < step, fails == f, gone == step and good, gone == step and toxic]
                cell[:6] = [a + b for a, b in zip(cell[:6], now, strict=True)]
    for (part, order, step), cell in cells.items():
        cell[6] = sum(c[1] for (p, o, s), c in cells.items() if p == part and o[s - 1] == order[step - 1])
    return {k: tuple(v) for k, v in cells.items()}


@pytest.mark.parametrize("many", [0, 500])
def test_audit(spark, monkeypatch, many):
    monkeypatch.setattr(filter_audit, "MANY", many)
    rng = random.Random(3)
    long = " ".join(f"w{k}" for k in range(250))
    texts = [long, long, "LOUD " * 210, "a b " * 200, long + " 5 %", "", None, "short", "\t\n\x0b", long + " q" * 300, "Ünïcode " * 30, long + " " + "X" * 90]
    rows = [(i, rng.choice(texts), rng.choice(["web", "web", "code", None, ""])) for i in range(70)]
    rows += [(None, long, "web"), (None, long, "web"), (3, long, "code"), (3, "short", "code"), (3, "short", "code")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("fails", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("part", F.lit(0)).repartition(3)
    got = filter_audit.audit_filters(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("source", F.lit(1))).collect()
    names = [*filter_audit.COUNTS, "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got} == plain_audit(rows, labels)
    assert len(got) == 600 * 3
    none = d.where("false")
    assert filter_audit.audit_filters(none, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_whitening(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) * 3 + 1
    vectors = [[float(np.float32(v)) for v in row] for row in base]
    rows = list(enumerate(vectors)) + [(100 + k, vectors[0]) for k in range(30)] + [(None, vectors[1]), (5, vectors[2])]
    left_out = [(200, None), (201, [1.0] * 5 + [None]), (202, [1.0] * 5 + [float("nan")]), (203, [float("-inf")] * 6), (204, []), (205, [1.0] * 7), (206, [1e300] * 6)]
    d = spark.createDataFrame(rows + left_out, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("id", F.lit("a")).withColumn("n", F.lit(0)).repartition(4)
    got = whitening.whiten(d, components=4).collect()
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), [sum(int(v) for v in c) for c in fit.T]
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    mean = np.array([float(Fraction(t, n)) for t in total])
    cov = (fit - mean).T @ (fit - mean) / n
    values = np.linalg.eigvalsh(cov)[::-1]
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
        if r.vec_id is not None and r.vec_id < 60 and r.vec_id != 5:
            assert r.deviation == sum((n * int(v) - t) ** 2 for v, t in zip(x[r.vec_id], total, strict=True))
    white = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(white[100, c] == white[0, c] for c in range(1, 5))
    w = np.array([[white[i, c] for c in range(1, 5)] for i in range(60) if i != 5])
    y = np.delete(x, 5, 0) - mean
    for c in range(4):
        axis = np.linalg.lstsq(y, w[:, c], rcond=None)[0] * np.sqrt(values[c])
        assert np.linalg.norm(axis) == pytest.approx(1, rel=1e-9) and axis[np.abs(axis).argmax()] > 0
        assert axis @ cov @ axis == pytest.approx(values[c], rel=1e-9)


def test_whitening_without_variance(spark):
    flat = [(k, [float(k % 3), 2.0, 5.0]) for k in range(9)]
    got = whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 27 and {r.n for r in got} == {3}
    assert {r.component for r in got if r.whitened is None} == {2, 3} and all(r.identity_error < 1e-9 for r in got)
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_large_deviations(spark):
    """Sums of squares that fit a long are exact, others are null; entries near the end of the grid don't overflow."""
    x = np.array([[2**31 + 5, 7], [3, -(2**31)]], np.int64)
    assert whitening.squares(x) == [(2**31 + 5) ** 2 + 49, 9 + 2**62]
    assert whitening.squares(x * 3) == [None, 81 + 9 * 2**62 if 81 + 9 * 2**62 < 2**63 else None]
    d = spark.createDataFrame([(1, [2.0**53, 0.5]), (2, [-(2.0**53), 0.25]), (3, [1.0, 0.75])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(d).collect()}
    total = 64 + 3_000_000
    assert got[3, 1].deviation == (3 * (64 + 1_000_000) - total) ** 2 + (3 * 48 - 96) ** 2 and got[1, 1].deviation is None


def changed(words, places, tag):
    return [f"{tag}{k}" if k in places else w for k, w in enumerate(words)]


def plain_groups(rows, width, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()))
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted(((i, len(a), find(i) if i is not None else None) for i, a in sets), key=str)


@pytest.mark.parametrize("width,percent,node_records", [(1, 85, 4096), (4, 85, 4), (1, 60, 3)])
def test_jaccard_groups(spark, width, percent, node_records):
    """Small and large groups, short sets around the bounds of their bands, boilerplate, chains, repeated ids."""
    rng = random.Random(width * 100 + percent)
    rows, new = [], iter(range(10**6))
    for g in range(25):
        n = rng.choice([1, 2, 3, 5, 6, 7, 8, 11, 13, 20, 33, 60, 150])
        base = [f"g{g}w{k}" for k in range(n)]
        for c in range(rng.choice([1, 2, 3, 6])):
            words = changed(base, set(rng.sample(range(n), rng.randint(0, max(1, n // 10)))), f"c{c}x")
            rows.append((next(new), " ".join(words + [f"e{g}y{c}z{k}" for k in range(rng.randint(0, 2))])))
    hot = [f"h{k}" for k in range(70)]
    for c in range(40):  # one large group of near copies, some of them far from most
        rows.append((next(new), " ".join(changed(hot, set(rng.sample(range(70), rng.choice([0, 1, 2, 3, 5, 8]))), f"c{c}x"))))
    for c in range(30):  # documents of the same boilerplate
        rows.append((next(new), " ".join(hot[:40] + [f"b{c}w{k}" for k in range(60)])))
    chain = [f"k{k}" for k in range(100)]
    rows += [(next(new), " ".join(chain[k : k + 80])) for k in range(0, 20, 2)]
    rows += [(3, rows[60][1]), (3, ""), (None, rows[60][1]), (None, None), (next(new), None), (next(new), " \t"), (next(new), "G1W0 G1w1")]
    rows += [(next(new), rows[5][1].upper()), (rows[5][0], rows[5][1])]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("x")).withColumn("n", F.lit(1)).withColumn("cls", F.lit(1)).repartition(3)
    got = sorted((tuple(r) for r in set_join.jaccard_groups(d, width, percent, node_records).collect()), key=str)
    assert got == plain_groups(rows, width, percent)


def test_segments_hold_the_bound():
    """Of linked sets, every choice of need segments holds an equal one: fewer than that differ; removing a token gives a neighbour's key."""
    rng = np.random.default_rng(4)
    for n in (6, 7, 12, 13, 14, 40, 200, 1000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, np.uint64))
            drop = rng.integers(0, int(0.15 * n / 0.85) + 1)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**63, rng.integers(0, 3), np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
                continue
            s = set_join.segments(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 85)
            key = s["sums"] + s["salt"]
            entries = {(int(r), int(d)): key[s["base"][k] : s["base"][k + 1]] for k, (r, d) in enumerate(zip(s["row"], s["band"], strict=True))}
            need = {int(d): int(x) for d, x in zip(s["band"], s["need"], strict=True)}
            band = min(set_join.size_bands(85).searchsorted([len(a), len(b)], "right")) - 1
            if (0, band) in entries:
                assert (entries[0, band] != entries[1, band]).sum() < need[band]
            else:
                assert np.array_equal(a, b)
    assert set_join.jaccard_groups.__doc__


def test_empty_join(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert set_join.jaccard_groups(none).count() == 0
    with pytest.raises(ValueError):
        set_join.jaccard_groups(none, percent=0)
