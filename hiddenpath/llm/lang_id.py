"""Language identification by cross-parsing entropy.

A suffix automaton is built of a sample of labelled text of each language. A text is parsed from left to right
into the longest phrases that occur in a language's sample; the language that needs the fewest phrases,
normalised by sample size, wins. Texts are parsed as the UTF-8 bytes of their letters in lower case, so every letter
of every script counts and the alphabet is small; what stands between letters is one break. Automata are dense
transition tables, so a task parses all chunks of a batch of texts side by side, for all languages at once, and then
mends the chunks whose predecessor ended inside a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiddenpath.llm.common import blocks

#: Bytes of text that a language's automaton is built from at most, and those of all languages together (each has 200 at least).
SAMPLE_CHARS, ALL_CHARS = 24_000, 200_000
#: Languages at most: with 200 bytes each, their automata take some 33 KB each in every task, 165 MB together.
MOST_LANGUAGES = 5_000
#: Characters that one document gives to a sample at most.
PASSAGE = 4_000
#: Characters parsed side by side; no result depends on it.
CHUNK = 512
_BREAK = 32


@dataclass
class LanguageModel:
    languages: list[str]
    #: Code of each byte: 0 is the break, 1 a byte that no sample has.
    codes: np.ndarray
    #: For each language in turn, state by code: twice the row start of the next state, plus 1 where a phrase ends.
    table: np.ndarray
    roots: np.ndarray
    weights: np.ndarray


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts the suffixes of ``text``; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return go


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """The lower-case letter of each code point, or the break; made once in a worker."""
    if not _letters:
        points = np.full(0x110000, _BREAK, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                points[c] = ord(x.lower()[0])
        _letters.append(points)
    return _letters[0]


def letter_bytes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of the rows' letters in lower case, single breaks between, their offsets, and letters of each row."""
    points = letter_table()
    if len(raw) and raw.max() < 128:
        cp = points[raw]
    else:
        head = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        cp, at = points[np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)], head[at]
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != _BREAK) | (cp[:-1] != _BREAK)
    # a row's first character stays, whatever the row before it ends in
    keep[at[:-1][at[:-1] < len(cp)]] = True
    cp, at = cp[keep], np.concatenate([[0], np.cumsum(keep)])[at]
    letters = np.diff(np.concatenate([[0], np.cumsum(cp != _BREAK)])[at])
    if not len(cp) or cp.max() < 128:
        return cp.astype(np.uint8), at, letters
    size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    return np.frombuffer(cp.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8), np.concatenate([[0], np.cumsum(size)])[at], letters


def build_model(samples: dict[str, str]) -> LanguageModel:
    """Automata of one text per language."""
    languages = sorted(samples)
    texts = {}
    for x in languages:
        raw = np.frombuffer(samples[x].encode(), np.uint8)
        texts[x] = letter_bytes(raw, np.array([0, len(raw)]))[0]
    known = np.unique(np.concatenate([np.zeros(0, np.uint8), *texts.values()]))
    codes = np.ones(256, np.int64)
    codes[known] = np.arange(len(known)) + 2
    codes[_BREAK] = 0
    n = len(known) + 2
    parts, roots, weights, base = [], [], [], 0
    for language in languages:
        go = suffix_automaton(codes[texts[language]].tolist())
        start = np.full(n, 2 * base + 1, np.int64)
        for c, s in go[0].items():
            start[c] = 2 * (base + s * n) + 1
        rows = np.tile(start, (len(go), 1)).astype(np.int32)
        for s, out in enumerate(go):
            for c, to in out.items():
                rows[s, c] = 2 * (base + to * n)
        parts.append(rows.reshape(-1))
        roots.append(base)
        weights.append(np.log2(max(2, len(texts[language]))))
        base += rows.size
    return LanguageModel(languages, codes, np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(roots, np.int64), np.array(weights))


def train(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """A model of every ``lang`` value of ``docs`` (``doc_id, text, lang``), from a bounded sample of each.

    A language gets ``sample_chars`` characters, or its share of ALL_CHARS if there are many languages. Documents are taken in the
    order of a hash of doc_id; each gives PASSAGE characters at most, from a place that the hash names. Rows without text
    or lang are not used; rows that repeat count once. More than MOST_LANGUAGES values are refused, none is left out.
    """
    h = F.xxhash64("doc_id")
    rows = docs.where("lang is not null and text <> ''").select("lang", "text", (F.pmod(h, F.lit(1_000_000)) / 1_000_000.0).alias("at"), h.alias("h"))
    own = F.least(F.char_length("text"), F.lit(PASSAGE))
    sizes = rows.groupBy("lang").agg(F.sum(own).alias("n"))
    languages = sizes.count()
    if not languages:
        return build_model({})
    if languages > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages; the automata of {MOST_LANGUAGES} at most fit a task")
    sample_chars = min(sample_chars, max(200, ALL_CHARS // languages))
    # in the mean three times what is needed, and two passages, so that no language falls short
    share = sizes.select("lang", F.least(F.lit(1.0), (3 * sample_chars + 2 * PASSAGE) / F.col("n")).alias("share"))
    start = F.pmod(F.shiftright("h", 20), F.greatest(F.char_length("text") - (PASSAGE - 1), F.lit(1))).cast("int") + 1
    # a row for each language: less than the model, which every task gets later
    some = rows.join(F.broadcast(share), "lang").where("at <= share").select("lang", "at", F.substring("text", start, F.lit(min(PASSAGE, sample_chars))).alias("text")).distinct()
    sample: dict[str, str] = {}
    for r in sorted(some.collect(), key=lambda r: (r["lang"], r["at"], r["text"])):
        if len(sample.setdefault(r["lang"], "")) < sample_chars:
            sample[r["lang"]] += r["text"][: sample_chars - len(sample[r["lang"]])] + "\n"
    return build_model({x: t.encode()[:sample_chars].decode("utf-8", "ignore") for x, t in sample.items()})


def _run(table: np.ndarray, codes: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that end in each lane of codes ``start:start + length``, and the states after it."""
    order = np.argsort(-length, kind="stable")
    start, now = start[order], state[order].astype(np.int64)
    active = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), "left")
    ends = np.zeros(len(start), np.int32)
    for t, k in enumerate(active.tolist()):
        to = table.take(now[:k] + codes[start[:k] + t])
        ends[:k] += to & 1
        np.right_shift(to, 1, out=to)
        now[:k] = to
    phrases, after = np.empty_like(ends), np.empty_like(now)
    phrases[order], after[order] = ends, now
    return phrases, after


def _differences(table: np.ndarray, codes: np.ndarray, start: np.ndarray, length: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lanes parsed from ``old`` states: phrases more if from ``new`` ones, the new end states, and whether they differ.

    Both parses of a lane go on until their states meet, which they soon do: phrases end together from there.
    """
    more, after, differs = np.zeros(len(start), np.int64), new.copy(), np.zeros(len(start), bool)
    lane, x, y, t = np.arange(len(start)), old.copy(), new.copy(), 0
    while len(lane):
        done = t >= length[lane]
        after[lane[done]] = y[done]
        differs[lane[done]] = True
        going = ~done & (x != y)
        lane, x, y = lane[going], x[going], y[going]
        code = codes[start[lane] + t]
        a, b = table.take(x + code), table.take(y + code)
        more[lane] += (b & 1).astype(np.int64) - (a & 1)
        x, y = (a >> 1).astype(np.int64), (b >> 1).astype(np.int64)
        t += 1
    return more, after, differs


#: Rounds in which all chunks whose start moved are parsed again side by side; texts still moving then are gone through in order.
ROUNDS = 6


def _in_order(table: np.ndarray, codes: np.ndarray, start: np.ndarray, length: np.ndarray, begin: np.ndarray, end: np.ndarray, phrases: np.ndarray, last: np.ndarray, todo: np.ndarray) -> None:
    """Parses the chunks from the first of ``todo`` in each text on, one of every text at a time.

    A chunk whose start is the one it was parsed from stays. Chunks of equal codes that are entered in one state are parsed once: a text
    that keeps its phase, such as a sentence that repeats, has few of those. So work is linear in the text at most.
    """
    chains = np.flatnonzero(np.append(True, last[:-1]))  # the first chunk of each text and language
    front = np.unique(np.searchsorted(chains, todo, "right"), return_index=True)[1]
    now, known = todo[front], {}
    while len(now):
        moved = now[begin[now] != end[now - 1]]
        keys = [(int(end[k - 1]), codes[start[k] : start[k] + length[k]].tobytes()) for k in moved.tolist()]
        new = {key: k for key, k in zip(keys, moved.tolist(), strict=True) if key not in known}
        if new:
            at = np.array(list(new.values()))
            got = _run(table, codes, start[at], length[at], end[at - 1])
            known.update(zip(new, zip(*(x.tolist() for x in got), strict=True), strict=True))
        begin[moved] = end[moved - 1]
        for k, key in zip(moved.tolist(), keys, strict=True):
            phrases[k], end[k] = known[key]
        now = now[~last[now]] + 1


def count_phrases(codes: np.ndarray, at: np.ndarray, model: LanguageModel, chunk: int = CHUNK) -> np.ndarray:
    """Longest-match phrases of each whole row of codes in each language; a row without codes has one."""
    pieces = -(-np.diff(at) // chunk)
    row = np.repeat(np.arange(len(pieces)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = at[row] + nth * chunk
    length = np.minimum(at[row + 1] - start, chunk)
    n_lang, n = len(model.roots), len(row)
    first = np.tile(nth == 0, n_lang)
    last = np.tile(nth == pieces[row] - 1, n_lang)
    start, length = np.tile(start, n_lang), np.tile(length, n_lang)
    begin = np.repeat(model.roots, n)
    phrases, end = _run(model.table, codes, start, length, begin)
    phrases = phrases.astype(np.int64)
    # chunks after the first go on from where their predecessor ended, until no end state changes
    todo, rounds = np.flatnonzero(~first), 0
    while len(todo):
        if rounds == ROUNDS:
            _in_order(model.table, codes, start, length, begin, end, phrases, last, todo)
            break
        rounds += 1
        new = end[todo - 1]
        more, after, differs = _differences(model.table, codes, start[todo], length[todo], begin[todo], new)
        begin[todo] = new
        phrases[todo] += more
        end[todo[differs]] = after[differs]
        todo = todo[differs & ~last[todo]] + 1
    out = np.ones((n_lang, len(pieces)))
    for j in range(n_lang):
        out[j] += np.bincount(row, phrases[j * n : (j + 1) * n], len(pieces))
    return out


def _identify(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.languages, "und"], object)
    # lanes are as many as chunks times languages
    most = max(20_000, 4_000_000 // max(len(model.languages), 1))
    for batch in batches:
        for lo, hi, raw, at in blocks(batch.column("text"), min(most, 1_000_000)):
            text, at, letters = letter_bytes(raw, at)
            best = np.full(hi - lo, len(model.languages))
            score = np.zeros(hi - lo)
            if len(model.languages):
                cost = count_phrases(model.codes[text], at, model) * model.weights[:, None]
                best = np.where(letters > 0, np.argmin(cost, 0), best)
                low = np.sort(cost, 0)
                second = low[1] if len(low) > 1 else low[0] * 1e9
                score = np.where(letters > 0, second / np.maximum(second + low[0], 1e-9), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The language of each whole text: ``doc_id, lang_pred, score``, a row per input row.

    Only ``text`` is looked at. ``score`` is the runner-up's share of the two smallest costs (0.5: a tie; ties
    go to the first language in alphabetical order). Texts that are null or have no letter get ``und`` and 0, as
    do all if the model knows no language. A letter of which a sample has no byte ends a phrase with each byte. Null ids stay
    null, rows that repeat get a row each. An empty table gives an empty result.
    """
    # a file split holds many texts, and the model travels once with the function
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_identify, model=model), "doc_id long, lang_pred string, score double")
