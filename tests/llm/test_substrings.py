"""Substring dedup: refinement and whole results against brute force, hot anchors, other lengths, odd rows, SQL."""

import hashlib
import random
import tracemalloc

import duckdb
import numpy as np
import pytest

from hiddenpath.llm import oracles, queries, suffix_dedup


def brute(rows, length):
    """Results as a set of rows: a window goes where a smaller doc_id has it too; a null id is the smallest."""
    key = {i: -1 if i is None else i for i, _ in rows}
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            least[s] = min(least.get(s, key[i]), key[i])
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < key[i]:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((key[i], len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def texts(seed):
    """Prose with a passage that most texts share, runs of one letter, copies and near copies."""
    rng = random.Random(seed)
    words = ["ba", "kolo", "mire", "stuné", "zé", "aaaa"]
    shared = " ".join(rng.choices(words, k=40))
    out = []
    for k in range(70):
        t = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        if k % 3:
            cut = rng.randrange(60)
            t += shared[cut : cut + rng.randint(40, 160)] + rng.choice(("", "a" * rng.randint(1, 300)))
        out.append(t)
    return [*out, out[5], out[6], f"x{out[7]}", None, ""]


@pytest.mark.parametrize("length", [24, 50, 51, 130])
def test_refinement_against_brute_force(length):
    rng = random.Random(length)
    for _ in range(30):
        parts = ["".join(rng.choices("ab", k=rng.choice((1, 5, 40)))) * rng.randint(1, 30) for _ in range(6)]
        stretches = [s for s in ("".join(rng.choices(parts, k=3)) for _ in range(8)) if len(s) >= 8]
        raw = np.frombuffer("".join(stretches).encode(), np.uint8)
        end = np.cumsum([len(s) for s in stretches])
        begin = end - [len(s) for s in stretches]
        pos, which, ids = suffix_dedup.refine(raw, begin, end, length)
        got = {}
        for p, w, i in zip(pos.tolist(), which.tolist(), ids.tolist(), strict=True):
            assert begin[w] <= p and p + length <= end[w]
            got.setdefault(i, []).append(p)
        want = {}
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            for p in range(b, e - length + 1):
                want.setdefault(raw[p : p + length].tobytes(), []).append(p)
        assert sorted(sorted(x) for x in got.values()) == sorted(sorted(x) for x in want.values() if len(x) > 1)


@pytest.mark.parametrize(("length", "hot_share", "gathered", "bucket_bytes"), [(50, 10**9, 500, 10**9), (31, 10_000, 10**7, 2_000), (120, 10**9, 10**7, 10**9)])
def test_whole_results(spark, monkeypatch, length, hot_share, gathered, bucket_bytes):
    monkeypatch.setattr(suffix_dedup, "MOST_TASKS", 3)  # of the second case's buckets, tasks take several
    rows = list(enumerate(texts(length)))
    rng = random.Random(1)
    rng.shuffle(rows)
    # rows of one doc_id don't remove from each other; a null id is the smallest
    rows += [(rows[0][0], rows[1][1]), (rows[2][0], rows[2][1]), (None, rows[3][1]), (None, None)]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string").repartition(3)
    found = suffix_dedup.repeated_substrings(d, length, texts=False, bucket_bytes=bucket_bytes, hot_share=hot_share, gathered=gathered)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())
    assert got == brute(rows, length)
    assert sum(r[2] > 0 for r in got) > 20


def test_against_sql(spark, tmp_path):
    rows = list(enumerate(texts(3)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(oracles.ORACLE_SQL["op9_suffix_array_dedup"])
    got = queries.op9_suffix_array_dedup(spark, str(tmp_path))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall()) == [(i, *r) for i, *r in brute(rows, 50)]


def part_of(texts, length):
    """The runs of some texts, each of a document of its own, as they come to one part of a bucket."""
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, end, _, row = suffix_dedup.anchors(raw, at, length)
    stop = end + length - 1
    gathered = suffix_dedup._Gathered()
    gathered.add(np.zeros(len(start), np.int64), row, row, start - at[row], stop - start, raw[suffix_dedup._expand(start, stop)[0]])
    return suffix_dedup._rows(gathered.packed())


def covered(texts, length, most):
    gone = [np.zeros(len(t), bool) for t in texts]
    for found in suffix_dedup._settle(iter([part_of(texts, length)]), length, most):
        for doc, th, a, b in zip(*found, strict=True):
            assert doc == th
            gone[doc][a:b] = True
    return gone


@pytest.mark.parametrize("length", [24, 50])
def test_large_parts_in_portions_against_brute_force(length):
    rng = random.Random(length)
    for _ in range(6):
        words = ["".join(rng.choices("abc", k=rng.choice((3, 9, 30, 60)))) for _ in range(5)]
        texts = ["".join(w * rng.randint(1, 12) for w in rng.choices(words, k=4)) + "d" * rng.randint(0, 90) for _ in range(30)]
        want = [np.zeros(len(t), bool) for t in texts]
        seen = set()
        for t, gone in zip(texts, want, strict=True):
            windows = [t[k : k + length] for k in range(len(t) - length + 1)]
            for k, w in enumerate(windows):
                gone[k : k + length] |= w in seen
            seen.update(windows)
        for most in (length, 300, 4000, 10**9):
            assert all((a == b).all() for a, b in zip(covered(texts, length, most), want, strict=True))


def test_a_part_that_one_anchor_has_swollen_takes_bounded_memory():
    texts = ["mit " * (9000 + k) for k in range(60)] + ["".join(random.Random(k).choices("abcdefgh ", k=10_000)) for k in range(30)] * 2
    batch = part_of(texts, 50)
    tracemalloc.start()
    got = {}
    for doc, _, a, b in suffix_dedup._settle(iter([batch]), 50):
        for d, n in zip(doc.tolist(), (b - a).tolist(), strict=True):
            got[d] = got.get(d, 0) + n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got) == set(range(1, 60)) | set(range(90, 120))
    assert all(got[d] >= len(texts[d]) for d in got)
    assert peak < 260_000_000
