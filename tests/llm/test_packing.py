"""Packing: ids against the tokenizer over random texts, bins of hot shards, odd rows."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from hiddenpath.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def random_texts(count, seed):
    rng = random.Random(seed)
    ranges = [(0x20, 0x7F), (0xA0, 0x180), (0x300, 0x340), (0x370, 0x400), (0x400, 0x460), (0x900, 0x980), (0x130, 0x134), (0x2000, 0x2070), (0x3040, 0x30A0), (0x4E00, 0x4E80), (0xAC00, 0xAC40), (0x1F600, 0x1F620), (0xFB00, 0xFB07), (0x1E00, 0x1F00)]
    fixed = ["İ.", "İ,", "it's", "I'LL", "<|endoftext|>", "<|EndOfText|>", "<|", "क़.", "Å.", "é,", "ß.", "Σ.", "ΣΑΣ,", "ŉ.", "ǰ.", "x.", "...", "12.5", " a", "ﬁ.", "K."]
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.3:
                words.append(rng.choice(fixed))
            else:
                lo, hi = rng.choice(ranges)
                words.append("".join(chr(rng.randrange(lo, hi)) for _ in range(rng.randint(1, 5))) + rng.choice(("", "", ".", ",")))
        yield rng.choice((" ", "\n", "\t ", " \x0b")).join(words)


def test_ids_of_random_texts():
    texts = list(random_texts(10_000, 1))
    mine, real = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    want = [x.ids for x in real.encode_batch(texts, add_special_tokens=False)]
    for k in range(0, len(texts), 500):
        raw = [t.encode() for t in texts[k : k + 500]]
        ids, at = mine.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        for i in range(len(raw)):
            assert ids[at[i] : at[i + 1]].tolist() == want[k + i], texts[k + i]


def test_replacement_fills_the_gap():
    """Greedy takes 6 and 3 of 10; giving up the 3 for 2 and 2 fills the sequence."""
    bins, offset = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    held = [sorted(np.array([6, 3, 2, 2])[bins == k].tolist()) for k in sorted(set(bins))]
    assert sorted(map(sum, held), reverse=True)[0] == 10 and sorted(offset[bins == bins[0]].tolist())[0] == 0


def test_hot_shard_is_packed_in_goes():
    n = 50
    batch = pa.RecordBatch.from_pydict({"shard": pa.array([7] * n, pa.int64()), "length": pa.array([3] * n, pa.int64())})
    got = pa.Table.from_batches(packing._pack(iter([batch.slice(k, 10) for k in range(0, n, 10)]), 10, 20))
    places = sorted(zip(got["sequence_id"].to_pylist(), got["offset"].to_pylist()))
    assert len(set(places)) == n and {o for _, o in places} == {0, 3, 6} and len({s for s, _ in places}) == 7 + 7 + 4


def test_odd_rows(spark):
    long = "word " * 30_000
    rows = [(1, None, 1), (None, "a b", 2), (2, "", 3), (3, long, 4), (3, long, 4), (3, "other", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(d, PATH, ids=False).collect()
    assert sorted(r.length for r in got if r.doc_id in (1, 2)) == [1, 1]
    assert sum(r.length for r in got if r.doc_id == 3) == 2 * 30_001 + 2
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(d.limit(0), PATH).count() == 0
