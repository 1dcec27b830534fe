"""Near-dedup: hot keys, recall by depth, odd rows."""

import random
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from hiddenpath.llm import graph, near_dedup


@pytest.mark.parametrize("many", [0, 2, 500])
def test_components_of_stars_and_paths(spark, monkeypatch, many):
    """Hot vertices, a smallest one and one in the middle, give the same components however the joins are split."""
    monkeypatch.setattr(graph, "MANY", many)
    pairs = [(0, k) for k in range(1, 60)] + [(500, k) for k in range(400, 480)] + [(k, k + 1) for k in range(600, 640)] + [(470, 600)] + [(7, 7), (None, 3)]
    got = {r.v: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {k: 0 for k in range(60)} | {k: 400 for k in [*range(400, 480), 500, *range(600, 641)]}
    assert got == want


@pytest.mark.parametrize("depth", [4, 8, 12, 16, 24])
def test_recall_at_the_threshold(depth):
    """Pairs of similarity 0.8, counted: every one meets in some tree of the depth."""
    rng = np.random.default_rng(5)
    pairs, n = 40, 90
    rows = []
    for _ in range(pairs):
        w = [str(x) for x in rng.integers(0, 1 << 60, n)]
        rows += [" ".join(w[:81]), " ".join(w[:72] + w[81:])]  # 72 words shared, of 90
    batch = pa.RecordBatch.from_pydict({"rep": pa.array(range(2 * pairs), pa.int64()), "n_shingles": pa.array([81] * 2 * pairs, pa.int64()), "text": rows})
    met = np.zeros(pairs, bool)
    for out in partial(near_dedup._regrow, width=1, trees=near_dedup.trees_at(depth, 80), depth=depth)(iter([batch])):
        node = out.column("node").to_numpy()
        met |= node[0::2] == node[1::2]
    assert met.all()


def test_copies_of_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(graph, "MANY", 3)
    rng = random.Random(2)
    w = [f"w{k}" for k in range(60)]
    near = [*w[:30], "zz", *w[31:]]
    rows = [(k, " ".join(w)) for k in range(40)] + [(100 + k, " ".join(near)) for k in range(40)] + [(200 + k, " ".join(rng.choices(w, k=40))) for k in range(10)]
    rows += [(200, " ".join(near)), (None, " ".join(w)), (300, None), (301, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_dedup.near_duplicates(d).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id is not None and r.doc_id < 201} == {0}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None and r.doc_id > 200} == {k: k for k in (*range(201, 210), 300, 301)}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
