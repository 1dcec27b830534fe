"""Inputs on which a cut of the work would show."""

import random
import string

import numpy as np
import pyarrow as pa
import pytest

from hiddenpath.llm import near_dedup, secret_scan


def changed(words, count, tag):
    """A copy with ``count`` words replaced, spread evenly."""
    out = list(words)
    for k in range(count):
        out[(2 * k + 1) * len(out) // (2 * count)] = f"{tag}x{k}"
    return out


def test_long_near_copies(spark, monkeypatch):
    """Nodes of three records that are large by their shingles only: A, A' almost equal, B at 0.8 to both."""
    monkeypatch.setattr(near_dedup, "NODE_SHINGLES", 1000)
    monkeypatch.setattr(near_dedup, "LAST_DEPTH", 10)
    rows = []
    for g in range(20):
        a = [f"g{g}w{k}" for k in range(500)]
        rows += [(3 * g, " ".join(a)), (3 * g + 1, " ".join(changed(a, 1, f"g{g}a"))), (3 * g + 2, " ".join(changed(a, 10, f"g{g}b")))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 3 for i, _ in rows}


def test_miss_of_all_depths():
    """A pair at the threshold is lost with less than 8e-8 over the first trees and those of every later depth."""
    miss = (1 - 0.8**near_dedup.FIRST_DEPTH) ** near_dedup.TREES
    for depth in range(near_dedup.FIRST_DEPTH + near_dedup.STEP, near_dedup.LAST_DEPTH + 1, near_dedup.STEP):
        miss += (1 - 0.8**depth) ** near_dedup.trees_at(depth, 80)
    assert miss < 8e-8


@pytest.mark.parametrize("node_records", [2, 8])
def test_hot_group(spark, node_records):
    """Pairs just over 0.8 in a group whose records all share boilerplate, similarity about 0.7."""
    rng, shared = random.Random(7), [f"b{k}" for k in range(500)]
    rows = []
    for g in range(150):
        a = shared + [f"g{g}w{rng.random()}" for _ in range(90)]
        rows += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(changed(a, 12, f"g{g}c")))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    near = {i: {j for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in sets}
    assert all(near[i] == {i, i ^ 1} for i in sets)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), node_records=node_records).collect()}
    assert got == {i: i - i % 2 for i in sets}


def test_long_secrets(spark):
    """Values over 256 characters are found and masked to their end, quoted or not."""
    rng = random.Random(11)
    mixed = string.ascii_letters + string.digits
    jwt = "eyJ" + "".join(rng.choices(mixed, k=40)) + ".eyJ" + "".join(rng.choices(mixed, k=300)) + "." + "".join(rng.choices(mixed + "_-", k=342))
    odd = "".join(rng.choices(mixed + "!@#%^*", k=700))
    rows = [(1, f"set token = {jwt} here"), (2, f"auth: {jwt}\nnext"), (3, f'password = "{odd}" end'), (4, f"secret={odd} end"), (5, f"api_key=abc+{'Qz7' * 4}!x{jwt} end")]
    got = {r.row.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), path=None).collect()}
    assert [got[i].masked for i in (1, 2, 3, 4)] == ["set token = [SECRET] here", "auth: [SECRET]\nnext", 'password = "[SECRET]" end', "secret=[SECRET] end"]
    assert [(f.start, f.end) for f in got[5].findings] == [(8, len(rows[4][1]) - 4)]


def test_long_values_are_judged_whole():
    """The scores' features hold what stands after the first 512 characters."""
    value = "a1" * 300 + "Z" * 400
    raw = np.frombuffer(f"token = {value} x".encode(), np.uint8)
    assert [(a, b) for _, a, b, _ in secret_scan.candidates(raw, np.array([0, len(raw)]))] == [(8, 8 + len(value))]
    batch = pa.RecordBatch.from_pydict({"row": [1], "scan_text": [raw.tobytes().decode()], "scan_path": [""]})
    seen = []

    class Judge:
        def predict(self, rows):
            seen.extend(rows[:, 0])
            return np.ones(len(rows))

    list(secret_scan._scan(iter([batch]), Judge(), 0.5))
    assert seen == [len(value)]
