"""Shared helpers: the shared folder, Arrow text access in bounded blocks, vectorised hashing."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a task turns into arrays at a time; a longer document makes a block of its own.
BLOCK_BYTES = 2_000_000


def use_shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session has none, a session on one machine gets a temporary folder; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    use_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo:hi`` of a string column, their bytes and offsets, of about ``most`` bytes at a time."""
    raw, at = utf8(column)
    lo, rows = 0, len(at) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


_rng = np.random.Generator(np.random.Philox(key=20240229))
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 to ``n`` - 1, modulo 2**64; kept for the life of the worker."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        made = np.full(max(n, BLOCK_BYTES + 1024), base, np.uint64)
        made[0] = 1
        got = np.multiply.accumulate(made)
        if n <= 4 * BLOCK_BYTES:
            _powers[int(base)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 256
_GAMMA, _DELTA = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each byte span ``raw[start:end]``, equal for equal bytes wherever they stand.

    Eight bytes at a time go through two chains of mixers, so that no arithmetic relation between blocks cancels out;
    spans of over LONG_SPAN bytes go through BLAKE2b.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    word = eight[starts]
    short = np.flatnonzero(size < 8)
    word[short] &= (np.uint64(1) << (size[short] * 8).astype(np.uint64)) - np.uint64(1)
    one = mix(word ^ size.astype(np.uint64) * _GAMMA)
    live, k = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    two = one * _DELTA
    while len(live):
        left = size[live] - k
        word = eight[starts[live] + k]
        short = np.flatnonzero(left < 8)
        word[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        one[live], two[live] = mix(one[live] ^ word), mix((two[live] + word) ^ _GAMMA)
        k += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_SPAN):
        one[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(one + two * (size > 8))


_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    return _ASCII_LOWER[raw]


def word_spans(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes inside rows: starts, ends and the first word of each row (and the total)."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = is_word[raw]
    change = inside[1:] != inside[:-1]
    begins = change & inside[1:]
    ends = change & inside[:-1]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    both = cuts[inside[cuts] & inside[cuts + 1]]
    begins[both] = ends[both] = True
    s, e = np.flatnonzero(begins), np.flatnonzero(ends)
    return s, e, np.searchsorted(s, at, "left")


#: Bytes of words in the sense of ``[^\x20\x09-\x0D]+``; every other byte, also of longer characters, belongs to words.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def bool_sum(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
