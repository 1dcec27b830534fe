"""Toxicity by multiple-instance learning: sentences are instances, documents are labelled bags.

A sentence's probability is a logistic function of the words and word beginnings it holds; a document is toxic if any sentence is,
so its score is the noisy-or 1 - prod(1 - p). The weights are fitted to document labels through the noisy-or,
which leaves the blame with the sentences that explain the labels; these are then located. Words of the labelled sample are
counted by tasks; the driver fits on the cells of the chosen words alone and sees no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiddenpath.llm.common import ascii_lower, blocks, cut, mix, span_hashes, word_spans

#: Labelled documents of each label that the model is fitted on at most, and the longest of them in characters.
SAMPLE_ROWS, LONGEST_SAMPLE = 3000, 50_000
#: Words that the model weighs at most, and documents of the sample that must hold a word.
MOST_WORDS, LEAST_ROWS = 4000, 5
STEPS, RATE, DECAY = 400, 0.1, 3e-4

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
_SLOTS = 1 << 20
#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (5, 6, 7, 8, 9)


@dataclass
class ToxicityModel:
    #: Fingerprints of the weighed words in ascending order, their weights, and the bias of a sentence.
    words: np.ndarray
    weights: np.ndarray
    bias: float


def _sentences(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of words and word beginnings, their sentences, and start and row of each sentence.

    A sentence ends after a full stop, exclamation mark, question mark or line break; every row has one at least.
    """
    s, e, _ = word_spans(raw, at, _WORD)
    low = ascii_lower(raw)
    parts, owner = [span_hashes(low, s, e)], [np.arange(len(s))]
    for k in BEGINNINGS:
        longer = np.flatnonzero(e - s > k)
        parts.append(mix(span_hashes(low, s[longer], s[longer] + k) + np.uint64(k)))
        owner.append(longer)
    words = np.concatenate(parts)
    starts = np.unique(np.concatenate([np.flatnonzero(_STOP[raw]) + 1, at[:-1]]))
    starts = starts[starts < max(len(raw), 1)]
    # empty rows share a start with the row after them: give them sentences of their own
    row = np.searchsorted(at[1:], starts, "right")
    empty = np.flatnonzero(np.diff(at) == 0)
    starts, row = np.concatenate([starts, at[empty]]), np.concatenate([row, empty])
    ok = row < len(at) - 1
    order = np.lexsort((starts[ok], row[ok]))
    starts, row = starts[ok][order], row[ok][order]
    full = np.flatnonzero(np.append(starts[1:], len(raw)) > starts)
    sentence = full[np.searchsorted(starts[full], s, "right") - 1] if len(s) else np.zeros(0, np.int64)
    return words, sentence[np.concatenate(owner)], starts, row


def _weights_of(words: np.ndarray, model: ToxicityModel, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that the model weighs, and which they are."""
    maybe = np.flatnonzero(slots[(words & np.uint64(_SLOTS - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(model.words, words[maybe]), max(len(model.words) - 1, 0))
    hit = model.words[at] == words[maybe] if len(model.words) else np.zeros(len(maybe), bool)
    return maybe[hit], at[hit]


def _slots(model: ToxicityModel) -> np.ndarray:
    slots = np.zeros(_SLOTS, bool)
    slots[(model.words & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
    return slots


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, the documents of a block that hold each, and how many of them are toxic."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for lo, hi, raw, at in blocks(batch.column("text")):
            word, sentence, _, row = _sentences(raw, at)
            own, index = np.unique(word, return_inverse=True)
            pairs = np.unique(index.reshape(-1) * np.int64(hi - lo) + row[sentence])
            which = pairs // (hi - lo)
            bad = np.bincount(which, toxic[lo + pairs % (hi - lo)], len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.bincount(which, minlength=len(own)).astype(np.int64)), pa.array(bad)], names=["word", "held", "bad"])


def _chosen_cells(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per document its label, number of sentences, and the chosen words of each sentence: 16-bit places after 32-bit sentences."""
    known = ToxicityModel(words, np.zeros(len(words)), 0.0)
    slots = _slots(known)
    for batch in batches:
        for lo, hi, raw, at in blocks(batch.column("text")):
            word, sentence, _, row = _sentences(raw, at)
            where, which = _weights_of(word, known, slots)
            cells = np.unique(sentence[where] * np.int64(len(words) + 1) + which)
            sentence, which = cells // (len(words) + 1), cells % (len(words) + 1)
            first = np.searchsorted(row, np.arange(hi - lo + 1))
            edges = np.searchsorted(sentence, first)
            packed = [[x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for x in ((sentence - first[row[sentence]]).astype(np.int32), which.astype(np.uint16))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "toxic")], pa.array(np.diff(first)), *[pa.array(x, pa.binary()) for x in packed]], names=["doc_id", "toxic", "n", "sentences", "words"])


def fit(words: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, cells: tuple[np.ndarray, np.ndarray]) -> ToxicityModel:
    """Weights that minimise the mean log loss of noisy-or scores, by Adam with decay of the weights.

    ``sizes`` and ``toxic`` are the sentences and the label of each document; ``cells`` are sentences, counted through, and
    places in ``words``.
    """
    if not len(sizes):
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -4.0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    n_sentences, n_rows = len(row), len(sizes)
    w, b = np.zeros(len(words)), -np.log(2.0 * n_sentences / n_rows)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = np.where(toxic > 0, 0.5 / max(toxic.sum(), 1), 0.5 / max((1 - toxic).sum(), 1))
    for step in range(1, STEPS + 1):
        z = b + np.bincount(cells[0], w[cells[1]], n_sentences)
        # log of the chance that no sentence is toxic, and its slope
        none = -np.bincount(row, _softplus(z), n_rows)
        score = -np.expm1(none)
        slope = np.where(toxic > 0, -np.exp(none) / np.maximum(score, 1e-9), 1.0) * share
        g = slope[row] / (1 + np.exp(-np.clip(z, -500, 500)))
        gw, gb = np.bincount(cells[1], g[cells[0]], len(w)) + DECAY * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * min(1.0, 2 - 2 * step / STEPS + 0.02)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        b -= rate * mb / (np.sqrt(vb) + 1e-8)
    return ToxicityModel(words, w, float(b))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model of ``labels.toxic``, from at most ``sample_rows`` documents of each label.

    They are taken in the order of a hash of doc_id, among those of LONGEST_SAMPLE characters at most. Rows with a
    null label, id or text are not used; a document with both labels counts as toxic; of rows of one doc_id the smallest text counts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(10))
    some = known.where("toxic = 1").orderBy(order).limit(sample_rows).unionByName(known.where("toxic = 0").orderBy(order).limit(sample_rows))
    # the sample's ids are bounded by its size, and so are its texts: one for each id
    rows = docs.select("doc_id", "text").where(F.char_length("text") <= LONGEST_SAMPLE).join(F.broadcast(some), "doc_id")
    sample = cut(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic"))
    n, n_bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = sample.mapInArrow(_count_words, "word long, held long, bad long").groupBy("word").agg(F.sum("held").alias("held"), F.sum("bad").alias("bad")).where(f"held >= {LEAST_ROWS}")
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("held") - F.col("bad") + 0.5) / (n - n_bad + 1))
    chosen = counts.orderBy(F.desc(F.abs(odds) * F.sqrt("held")), "word").limit(MOST_WORDS).collect()
    words = np.sort(np.array([r["word"] for r in chosen], np.int64).view(np.uint64))
    # of a text, the driver gets the places of chosen words
    found = sorted(sample.mapInArrow(partial(_chosen_cells, words=words), "doc_id long, toxic int, n long, sentences binary, words binary").collect(), key=lambda r: r["doc_id"])
    sizes = np.array([r["n"] for r in found], np.int64)
    first = np.cumsum(sizes) - sizes
    sentences = [np.frombuffer(r["sentences"], np.int32) + at for r, at in zip(found, first, strict=True)]
    places = [np.frombuffer(r["words"], np.uint16) for r in found]
    none = [np.zeros(0, np.int64)]
    return fit(words, sizes, np.array([r["toxic"] for r in found], float), (np.concatenate(none + sentences), np.concatenate(none + places)))


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    slots = _slots(model)
    for batch in batches:
        for lo, hi, raw, at in blocks(batch.column("text")):
            words, sentence, starts, row = _sentences(raw, at)
            where, which = _weights_of(words, model, slots)
            # a word counts once in a sentence
            cells = np.unique(sentence[where] * (len(model.words) + 1) + which)
            z = model.bias + np.bincount(cells // (len(model.words) + 1), model.weights[cells % (len(model.words) + 1)] if len(cells) else None, len(starts))
            score = -np.expm1(-np.bincount(row, _softplus(z), hi - lo))
            bad = np.flatnonzero(z >= 0)
            ends = np.minimum(np.append(starts[1:], len(raw)), at[row + 1])
            spans = pa.StructArray.from_arrays([pa.array((starts - at[row])[bad]), pa.array((ends - at[row])[bad]), pa.array(1 / (1 + np.exp(-z[bad])))], names=["start", "end", "score"])
            offsets = np.searchsorted(row[bad], np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.clip(score, 0, 1)), pa.array((score >= 0.5).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["doc_id", "score", "predicted", "toxic_sentences"])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Scores of whole texts: ``doc_id, score, predicted, toxic_sentences``, a row per input row.

    ``toxic_sentences`` lists sentences of probability 0.5 or more with their byte offsets. Only ``text`` is looked
    at. Null and empty texts count as one sentence without words; a model fitted on no rows scores every
    sentence alike; rows that repeat are scored each, null ids stay null. An empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_score, model=model), "doc_id long, score double, predicted int, toxic_sentences array<struct<start: long, end: long, score: double>>"
    )
