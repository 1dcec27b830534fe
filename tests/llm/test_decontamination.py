"""Decontamination: the shuffled join with split words gives what the broadcast one does; odd rows."""

import random

import pytest

from hiddenpath.llm import decontamination

WORDS = [f"w{k}" for k in range(30)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 120))) for _ in range(80)]
    texts += [texts[3], "w1 " * 200, "w1", None, ""]
    items = [(k, " ".join(rng.choice(texts[:80]).split()[:14])) for k in range(12)] + [(90, "w1"), (91, "w1 w1 w1"), (92, "w1 " * 12), (None, "w2 w3"), (93, None)]
    rows = [(k if k % 20 else None, t, "x", 1) for k, t in enumerate(texts)] + [(7, texts[7], "x", 1), (7, texts[8], "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, prefix string, n int").repartition(4), spark.createDataFrame(items, "item_id long, text string")


def test_shuffled_join(tables, monkeypatch):
    docs, bench = tables
    want = sorted(map(str, decontamination.decontaminate(docs, bench).collect()))
    assert len(want) == docs.count() and sum("contaminated=True" in x for x in want) > 20
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", 0)
    for part in (1_000_000, 10):
        monkeypatch.setattr(decontamination, "PART_PLACES", part)
        monkeypatch.setattr(decontamination, "HOT_SHARE", 1_000)
        assert sorted(map(str, decontamination.decontaminate(docs, bench).collect())) == want


def test_long_text_of_one_word(spark):
    d = spark.createDataFrame([(1, "w1 " * 50_000 + "end")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "w1 " * 10), (2, "end")], "item_id long, text string")
    r = decontamination.decontaminate(d, b).first()
    assert (r.n_words, r.n_hit, r.n_items) == (50_001, 50_001, 2)
