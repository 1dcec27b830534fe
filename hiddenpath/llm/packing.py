"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised once per distinct word of a batch; pieces of at most ``size`` tokens are dealt to shards by a
hash of what they are. A shard, of some thousand pieces whatever the input, fills sequences greedily,
each time with the longest piece that fits; then a sequence with a gap gives up its smallest piece for the two
unpacked pieces that fill the expanded gap best, if they fill it better.
"""

from __future__ import annotations

import itertools
import math
import os
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiddenpath.llm.common import blocks, span_hashes, word_spans

SIZE, SHARD_PIECES = 2048, 16_384
#: Words whose ids a worker remembers at most; then it forgets them all.
MOST_CACHED = 3_000_000

_SPACE = np.ones(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters below this one are single letters still when a text is composed and lower-cased; others may end in a mark.
_LATIN = "\u0130"


class WordTokenizer:
    """Ids of whole texts by a tokenizer whose normaliser lower-cases and whose tokens never cross white space.

    So a text's ids are those of its words, one after the other, and each distinct word is tokenised once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tails = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ".,"}
        self._forget()

    def _forget(self) -> None:
        #: Fingerprints of known words in ascending order, their slots, and by slot the place of their ids in ``ids``.
        self.prints, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _tokenise(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words. Words of letters go through the tokenizer many in a text, which it takes apart again."""
        plain = [w.isalpha() and max(w) < _LATIN for w in words]
        letters, others, out = [w for w, x in zip(words, plain, strict=True) if x], [w for w, x in zip(words, plain, strict=True) if not x], {}
        for k in range(0, len(letters), 512):
            part = letters[k : k + 512]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, owner = got.ids, np.array(got.word_ids, np.int64)
            cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
            if len(cuts) + 1 != len(part):
                others += part
                continue
            edges = [0, *cuts.tolist(), len(ids)]
            out.update((w, ids[a:b]) for w, a, b in zip(part, edges[:-1], edges[1:], strict=True))
        for w, got in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            out[w] = got.ids
        return out

    def _learn(self, prints: np.ndarray, words: list[str]) -> None:
        """Adds new words; a final stop or comma after a letter that stays one is a token of its own."""
        alone = [len(w) > 1 and w[-1] in self.tails and w[-2].isalpha() and w[-2] < _LATIN and "'" not in w for w in words]
        bare = [w[:-1] if x else w for w, x in zip(words, alone, strict=True)]
        got = self._tokenise(list(dict.fromkeys(bare)))
        ids = [got[b] + self.tails[w[-1]] if x else got[b] for w, b, x in zip(words, bare, alone, strict=True)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.arange(len(ids)) + len(self.begin) - 1
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(lens))
        self.ids = np.append(self.ids, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lens.sum())))
        at = np.searchsorted(self.prints, prints)
        self.prints, self.slots = np.insert(self.prints, at, prints), np.insert(self.slots, at, new)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the offsets of the rows in them."""
        # the upper-case letters of ASCII don't matter, unless they tell a special token from ordinary text
        text = raw if (raw == 124).any() and b"<|" in raw.tobytes() else _LOWER[raw]
        s, e, first = word_spans(text, at, _SPACE)
        prints, index, inverse = np.unique(span_hashes(text, s, e), return_index=True, return_inverse=True)
        if len(self.prints) > MOST_CACHED:
            self._forget()
        data = text.tobytes()
        known = np.searchsorted(self.prints, prints)
        new = np.flatnonzero(self.prints[np.minimum(known, len(self.prints) - 1)] != prints) if len(self.prints) else np.arange(len(prints))
        if len(new):
            self._learn(prints[new], [data[a:b].decode("utf-8", "replace") for a, b in zip(s[index[new]].tolist(), e[index[new]].tolist(), strict=True)])
        slot = self.slots[np.searchsorted(self.prints, prints)][inverse]
        begin, n = self.begin[slot], self.begin[slot + 1] - self.begin[slot]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], n)]
        return out, total[first]


_tokenizers: dict[str, WordTokenizer] = {}


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int, ids: bool) -> Iterator[pa.RecordBatch]:
    if tokenizer not in _tokenizers:
        _tokenizers[tokenizer] = WordTokenizer(tokenizer)
    words = _tokenizers[tokenizer]
    for batch in batches:
        for lo, _, raw, at in blocks(batch.column("text"), 4_000_000):
            token, offs = words.encode(raw, at)
            n = np.diff(offs) + 1  # each document ends in id 0
            count = -(-n // size)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * size
            length = np.minimum(n[row] - start, size)
            little, zero = token.astype("<u4").view(np.uint8), b"\0\0\0\0"
            crc, chunks = [], []
            for a, k, last in zip((offs[row] + start).tolist(), length.tolist(), (start + length == n[row]).tolist(), strict=True):
                data = little[4 * a : 4 * (a + k - last)]
                crc.append(zlib.crc32(zero, zlib.crc32(data)) if last else zlib.crc32(data))
                if ids:
                    chunks.append(data.tobytes() + zero * last)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(lo + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(chunks if ids else [None] * len(row), pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the place in it of each piece; lengths are 1 to ``size``."""
    order = np.argsort(-lengths, kind="stable")
    have = np.bincount(lengths, minlength=size + 1)
    ladder = np.arange(size + 1)

    def below() -> np.ndarray:
        return np.maximum.accumulate(np.where(have > 0, ladder, 0))

    bins: list[list[int]] = []
    fit = below()
    while fit[size]:
        held, gap = [], size
        while gap and fit[gap]:
            x = int(fit[gap])
            k = min(int(have[x]), gap // x)
            have[x] -= k
            held += [x] * k
            gap -= x * k
            if not have[x]:
                fit = below()
        if gap and len(held) > 0 and fit[size]:
            small = held[-1]
            room = gap + small
            first = np.flatnonzero(have[: room + 1])
            second = fit[room - first]
            twice = (second == first) & (have[first] < 2)
            if twice.any():
                second[twice] = fit[np.maximum(first[twice] - 1, 0)]
            total = np.where(second > 0, first + second, 0)
            best = int(np.argmax(total)) if len(total) else -1
            if best >= 0 and total[best] > small:
                held[-1:] = [int(first[best]), int(second[best])]
                have[small] += 1
                have[first[best]] -= 1
                have[second[best]] -= 1
                fit = below()
        bins.append(held)
    # pieces of one length are alike: deal them out in the order of the input
    starts = np.concatenate([[0], np.cumsum(np.bincount(lengths, minlength=size + 1)[::-1])])
    at = {x: int(starts[size - x]) for x in np.unique(lengths).tolist()}
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, held in enumerate(bins):
        where = 0
        for x in held:
            i = order[at[x]]
            at[x] += 1
            bin_of[i], offset[i] = k, where
            where += x
    return bin_of, offset


def _pack(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard to rows with their places; a shard that copies of a row swell is packed in several goes."""
    used = 0

    def place(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal used
        table = pa.Table.from_batches(rows).combine_chunks()
        bin_of, offset = best_two_fit(table["length"].to_numpy(), size)
        shard = table["shard"].to_numpy()
        first, used = used, used + int(bin_of.max()) + 1
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array((shard << 32) + first + bin_of)).append_column("offset", pa.array(offset)).to_batches()[0]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and b > a:
                other = held[-1].column("shard")[0].as_py() != shard[a]
                if other or sum(x.num_rows for x in held) >= most:
                    yield place(held)
                    held, used = [], 0 if other else used
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield place(held)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, shard_pieces: int = SHARD_PIECES, ids: bool = True) -> DataFrame:
    """Pieces of documents packed into sequences of at most ``size`` tokens, a row per piece.

    ``docs`` has ``doc_id`` (integer) and ``text``; other columns are ignored; ``tokenizer`` is the path of a tokenizer
    file that every executor can read. A document is its ids and then id 0; only longer ones than ``size`` are cut. Columns:
    ``doc_id, piece, start, length, ids_crc32, ids`` (little-endian unsigned 32-bit ids; null unless ``ids``),
    ``sequence_id, offset``. Null and empty texts are the single id 0; repeated rows are packed each; an
    empty table gives an empty result. Shards are packed one by one, which leaves at most about one
    unfilled sequence in each; they hold ``shard_pieces`` pieces at most in the mean, as a token is a byte at least.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = docs.mapInArrow(partial(_pieces, tokenizer=tokenizer, size=size, ids=ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    total = docs.agg(F.count("*") + F.coalesce(F.sum(F.octet_length("text") / size), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / shard_pieces))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(shards)).alias("shard")
    dealt = pieces.select(shard, "*").repartition(min(parts, shards), "shard").sortWithinPartitions("shard", "length", "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(partial(_pack, size=size, most=8 * shard_pieces), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
