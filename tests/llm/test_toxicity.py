"""Toxicity: noisy-or of sentences scored alone, bounded samples, held-out documents, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiddenpath.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    words = [a + b for a in ("ba", "ko", "mi", "re") for b in ("la", "n", "rt", "so")]
    rows = []
    for i in range(300):
        s = [" ".join(rng.choices(words, k=6)) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            s[rng.randrange(len(s))] += rng.choice((" you vile gronk", " gronks are scum", " a gronky scumbag"))
        rows.append((i, ". ".join(s) + rng.choice(("", ".", "!\n")), int(i % 3 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    return rows, d


def test_noisy_or_of_sentences(spark, tables):
    rows, d = tables
    model = toxicity.train(d, d.where("doc_id < 200"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, model).collect()}
    assert sum(got[i].predicted == y for i, _, y in rows if i >= 200) >= 98
    parts = [(1000 * i + k, s) for i, t, _ in rows[:60] for k, s in enumerate(x for x in t.replace("!", ".").replace("\n", ".").split(".") if x)]
    alone = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(parts, "doc_id long, text string"), model).collect()}
    empty = toxicity.score_toxicity(spark.createDataFrame([(1, "")], "doc_id long, text string"), model).first().score
    for i, t, _ in rows[:60]:
        p = [alone[k] for k, _ in parts if k // 1000 == i]
        # a mark that follows another ends a sentence without words
        p += [empty] * (t.count("!\n"))
        assert got[i].score == pytest.approx(1 - np.prod([1 - x for x in p]), abs=1e-9)
        raw = t.encode()
        for s in got[i].toxic_sentences:
            assert b"gronk" in raw[s.start : s.end] or b"scum" in raw[s.start : s.end]


def test_repeated_rows_do_not_widen_the_sample(spark, tables):
    _, d = tables
    hot = d.where("doc_id < 3").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("x")
    one, many = toxicity.train(d, d, 50), toxicity.train(d.unionByName(hot), d.unionByName(hot), 50)
    assert np.array_equal(one.words, many.words) and np.array_equal(one.weights, many.weights)


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 5 <> 0"))
    got = toxicity.score_toxicity(docs, model).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got) > 20


def test_odd_rows(spark, tables):
    _, d = tables
    model = toxicity.train(d, d)
    long = "mila kon rert. " * 60_000 + "you vile gronk."
    rows = [(None, None, 1), (1, "", 1), (2, long, 1), (2, long, 1), (3, "...!!!", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id in (None, 1)}) == 1
    assert {r.predicted for r in got if r.doc_id == 2} == {1}
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0
    none = toxicity.train(d.limit(0), d.limit(0))
    # nothing is known of a word: scores depend on the number of sentences alone
    assert len({r.score for r in toxicity.score_toxicity(odd.where("doc_id is null or doc_id = 1"), none).collect()}) == 1
    # one label for half the rows of a text and another for the rest: a tie between words; all scores are numbers
    tied = spark.createDataFrame([(k, "same text", k % 2) for k in range(40)], "doc_id long, text string, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(tied, toxicity.train(tied, tied)).collect())
