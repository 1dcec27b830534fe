"""Fingerprints of words: no algebraic collisions, equal bytes equal prints."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hiddenpath.llm import near_dedup, packing
from hiddenpath.llm.common import span_hashes, word_spans, SPACE_WORD


def thue_morse(letters, k):
    a, b = letters
    for _ in range(k):
        a, b = a + b, b + a
    return a


def prints(words):
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = word_spans(raw, np.array([0, len(raw)]), SPACE_WORD)
    return span_hashes(raw, s, e)


def test_no_collisions():
    words = [thue_morse(x, k) for k in range(14) for x in ("ab", "ba", "cd")]
    words += ["x" * k for k in range(1, 600)] + ["x" * k + "\x00" for k in range(1, 40)] + [f"w{k}" for k in range(20000)] + [f"averylongword{k}" for k in range(20000)]
    words = list(dict.fromkeys(words))
    got = prints(words)
    assert len(set(got.tolist())) == len(words)
    assert (prints(["zz", *words, "yy"])[1:-1] == got).all()


def test_unlike_documents_with_like_words(spark):
    x, y = thue_morse("ab", 10), thue_morse("ba", 10)
    d = spark.createDataFrame([(1, f"p q r {x}"), (2, f"p q r {y}"), (3, f"p q r {x}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(d).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("k", [10, 13, 16])
def test_ids_of_long_words(k):
    path = public_tokenizers.path("word_bpe_49k.json")
    text = f"{thue_morse('ab', k)} {thue_morse('ba', k)} and {'q' * 2**k}"
    raw = np.frombuffer(text.encode(), np.uint8)
    got, _ = packing.WordTokenizer(path).encode(raw, np.array([0, len(raw)]))
    assert got.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
