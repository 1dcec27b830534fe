"""Exact substring dedup: bytes covered by a string of ``length`` bytes that a smaller doc_id also holds.

Suffixes are sorted by bucket-pointer refinement, spread over tasks so that each holds a bounded share:

Exact copies of a smaller doc_id's text are removed whole; the steps below see one document of each text.

1. Anchors. Every window of ``length`` bytes takes the smallest fingerprint among its 24-byte grams as its
   anchor; equal windows have equal anchors. Each task reduces its anchors to one entry per value and sends
   them to buckets; a value held by two documents is matched.
2. Runs. Documents that hold matched anchors cut their windows into runs of one anchor. Windows repeated inside
   a block of texts are settled there, and the smallest document's copy goes on. Runs go to the bucket of their
   anchor; anchors that hold over 1 / ``HOT_SHARE`` of all entries are too common for one bucket, so their
   windows go out one by one to the buckets of their contents, and once from a task.
3. Refinement settles windows, of a block and then of a bucket. Positions are sorted by ``FIRST_GRAM`` bytes into initial
   buckets; these are refined by the bucket identifiers at a later offset, again and again, each time with the
   identifiers that the refinement before has given, until buckets tell ``length`` bytes apart. A window is removed
   where its final bucket has a smaller document. What has grown over ``PART_BYTES`` is refined in portions of
   whole anchors; of an anchor with more than that, each document's windows are refined once each, by contents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiddenpath.llm.common import _BYTE, blocks, cut, mix, span_hashes, utf8

GRAM, FIRST_GRAM = 24, 8
#: Bytes of text for each bucket of anchors: their number grows with the input, beyond the session's shuffle partitions.
BUCKET_BYTES = 32_000_000
#: Shuffle partitions at most; of more buckets, a task takes several, one after the other.
MOST_TASKS = 20_000
#: Buckets of runs for each bucket of anchors, and parts of a bucket: a task refines one part, of about a megabyte, at a time.
KEYS, SPLIT = 2, 8
#: Slots of documents for each bucket of anchors; a slot's covers travel as one row.
SLOTS = 1
#: Bytes of runs that a task gathers before it packs and sends them, and windows of hot anchors that it remembers.
GATHERED, REMEMBERED = 12_000_000, 500_000
#: Text bytes whose windows are expanded side by side, and bytes of runs that are refined at once.
WINDOW_BYTES, PART_BYTES = 1_000_000, 1_000_000
#: At most so many anchors can hold more than this share of all entries; so the list sent to tasks is bounded.
HOT_SHARE = 10_000
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64(0xFFFFFFFF)


def anchors(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive window starts with one anchor: first start, end, anchor value and row."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, np.zeros(0, np.uint64), none
    h, eight = _BYTE[raw], None
    for k, step in enumerate(_STEP):
        h = h[: -(1 << k)] * step + h[1 << k :]
        eight = h if k == 2 else eight
    h = mix(h[:-8] * _STEP[0] + eight[16:])
    span = length - GRAM + 1
    low, width = h, 1
    while width < span:
        move = min(width, span - width)
        low = np.minimum(low[:-move], low[move:])
        width += move
    n = len(low)
    change = np.ones(n, bool)
    np.not_equal(low[1:], low[:-1], out=change[1:])
    edges = at[1:-1]
    change[edges[edges < n]] = True
    ends = edges - length + 1
    change[ends[(ends > 0) & (ends < n)]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    row = np.searchsorted(at, start, "right") - 1
    ok = start + length <= at[row + 1]
    return start[ok], end[ok], low[start[ok]], row[ok]


def _key(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of an anchor, and a key of 32 bits and the bucket."""
    bucket = (value >> np.uint64(32)) % np.uint64(buckets)
    return bucket, (bucket << np.uint64(32)) | (value & _LOW)


def _runs_of(sorted_by: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and the length at the end."""
    return np.append(np.flatnonzero(np.append(True, sorted_by[1:] != sorted_by[:-1])), len(sorted_by)) if len(sorted_by) else np.zeros(1, np.int64)


_ENTRIES = "bucket int, local boolean, docs binary, lens binary, keys binary, counts binary"


def _packed(bucket: int, local: bool, docs: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple:
    """Entries sorted by document as runs."""
    at = _runs_of(docs)
    return bucket, local, docs[at[:-1]].tobytes(), np.diff(at).astype(np.int32).tobytes(), (keys if local else (keys & _LOW).astype(np.uint32)).tobytes(), counts.astype(np.uint16).tobytes()


_ZSTD = pa.Codec("zstd")


def _small(data: np.ndarray) -> bytes:
    """The bytes of an array, their number first, compressed: runs are most of what is shuffled."""
    return data.nbytes.to_bytes(8, "little") + _ZSTD.compress(data.tobytes(), asbytes=True)


def _back(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), kind)


def _entries(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("th").to_numpy(zero_copy_only=False)
        keys, docs = [], []
        for lo, _, raw, at in blocks(batch.column("text"), WINDOW_BYTES):
            _, _, value, row = anchors(raw, at, length)
            key = _key(value, buckets)[1]
            fresh = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])) if len(key) else np.zeros(0, bool)
            keys.append(key[fresh])
            docs.append(ids[lo + row[fresh]])
        key, doc = np.concatenate(keys or [np.zeros(0, np.uint64)]), np.concatenate(docs or [np.zeros(0, np.int64)])
        if not len(key):
            continue
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        at = _runs_of(key)
        first, last, n = doc[at[:-1]], doc[at[1:] - 1], np.diff(at)
        shared = first != last
        rows = []
        # one entry of each value goes to its bucket, with the number of local ones
        out_key, out_doc, out_n = key[at[:-1]], first, np.minimum(n, 65535)
        order = np.lexsort((out_key, out_doc, out_key >> np.uint64(32)))
        out_key, out_doc, out_n = out_key[order], out_doc[order], out_n[order]
        cut_at = _runs_of(out_key >> np.uint64(32))
        for a, b in zip(cut_at[:-1], cut_at[1:], strict=True):
            rows.append(_packed(int(out_key[a] >> np.uint64(32)), False, out_doc[a:b], out_key[a:b], out_n[a:b]))
        # what two local documents hold is matched for all of them already
        hit = np.repeat(shared, n)
        if hit.any():
            key, doc = key[hit], doc[hit]
            order = np.argsort(doc, kind="stable")
            rows.append(_packed(int(rows[0][0]), True, doc[order], key[order], np.zeros(0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "local", "docs", "lens", "keys", "counts"])


def _by_bucket(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[list[dict]]:
    """Rows sorted by bucket, a list per bucket."""
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r[key] != now:
                if rows:
                    yield rows
                now, rows = r[key], []
            rows.append(r)
    if rows:
        yield rows


def _lists(at: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _match(batches: Iterator[pa.RecordBatch], hot_share: int) -> Iterator[pa.RecordBatch]:
    """Matched anchors by document, and the anchors of each bucket with most entries (document null)."""
    for rows in _by_bucket(batches):
        keys, docs, counts, bucket = [], [], [], rows[0]["bucket"]
        for r in rows:
            doc = np.repeat(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["lens"], np.int32))
            if r["local"]:
                at = np.concatenate([[0], np.cumsum(np.frombuffer(r["lens"], np.int32))])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["docs"], np.int64)), _lists(at, np.frombuffer(r["keys"], np.int64)), pa.nulls(len(at) - 1, pa.int64())], names=["th", "keys", "n"])
                continue
            keys.append(np.frombuffer(r["keys"], np.uint32))
            docs.append(doc)
            counts.append(np.frombuffer(r["counts"], np.uint16))
        if not keys:
            continue
        key, doc, n = np.concatenate(keys), np.concatenate(docs), np.concatenate(counts).astype(np.int64)
        order = np.lexsort((doc, key))
        key, doc, n = key[order], doc[order], n[order]
        at = _runs_of(key)
        full = (np.uint64(bucket) << np.uint64(32)) | key.astype(np.uint64)
        total = np.add.reduceat(n, at[:-1])
        hot = np.flatnonzero(total * hot_share > total.sum() + 100 * hot_share)
        if len(hot):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(hot), pa.int64()), _lists(np.arange(len(hot) + 1), full[at[hot]].view(np.int64)), pa.array(total[hot])], names=["th", "keys", "n"])
        hit = np.repeat(doc[at[:-1]] != doc[at[1:] - 1], np.diff(at))
        if hit.any():
            key, doc = full[hit], doc[hit]
            order = np.argsort(doc, kind="stable")
            key, doc = key[order], doc[order]
            at = _runs_of(doc)
            yield pa.RecordBatch.from_arrays([pa.array(doc[at[:-1]]), _lists(at, key.view(np.int64)), pa.nulls(len(at) - 1, pa.int64())], names=["th", "keys", "n"])


def _expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the range of each."""
    n = end - start
    which = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n)])
    return np.arange(first[-1]) - first[:-1][which] + start[which], which


def _joined(pos: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in ``pos``) of runs of consecutive positions with equal companions."""
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, pos[1:] != pos[:-1] + 1)
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    at = np.append(np.flatnonzero(new), len(pos))
    return at[:-1], at[1:]


_FOUND = "bucket int, slot int, parts binary, docs binary, ths binary, at binary, lens binary, text binary"
_FOUND_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _covers(doc: np.ndarray, th: np.ndarray, start: np.ndarray, end: np.ndarray, slots: int) -> list[tuple]:
    """Removed stretches of document texts, a row for each slot of documents."""
    if not len(doc):
        return []
    slot = (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(slots)).astype(np.int64)
    order = np.lexsort((start, th, doc, slot))
    slot, doc, th, start, end = slot[order], doc[order], th[order], start[order], end[order]
    at = _runs_of(slot)
    return [(None, int(slot[a]), None, _small(doc[a:b]), _small(th[a:b]), _small(start[a:b].astype(np.int32)), _small((end[a:b] - start[a:b]).astype(np.int32)), None) for a, b in zip(at[:-1], at[1:], strict=True)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _FOUND_TYPES, strict=True)], names=_FOUND_NAMES)


class _Gathered:
    """Runs on their way to buckets: bucket, document, text fingerprint, start, length and bytes."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, to: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray, lens: np.ndarray, text: np.ndarray) -> None:
        self.parts.append((to, doc, th, start, lens, text))
        self.size += len(text)

    def packed(self) -> list[tuple]:
        """A row per bucket."""
        if not self.parts:
            return []
        to, doc, th, start, lens, text = (np.concatenate([p[k] for p in self.parts]) for k in range(6))
        self.parts, self.size = [], 0
        order = np.lexsort((start, doc, to))
        begin = (np.cumsum(lens) - lens)[order]
        to, doc, th, start, lens = to[order], doc[order], th[order], start[order], lens[order]
        cuts, rows = _runs_of(to // SPLIT), []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            own = text[_expand(begin[x:y], begin[x:y] + lens[x:y])[0]]
            sizes = np.bincount(to[x:y] % SPLIT, minlength=SPLIT).astype(np.int32)
            rows.append((int(to[x]) // SPLIT, None, sizes.tobytes(), _small(doc[x:y]), _small(th[x:y]), _small(start[x:y].astype(np.int32)), _small(lens[x:y].astype(np.int32)), _small(own)))
        return rows


class _Seen:
    """Windows of hot anchors that a task has sent, by fingerprint, and the smallest document of each."""

    def __init__(self) -> None:
        self.prints, self.docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def smaller(self, prints: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which windows a smaller document of this task has; the others are remembered."""
        at = np.minimum(np.searchsorted(self.prints, prints), max(len(self.prints) - 1, 0))
        gone = (self.prints[at] == prints) & (self.docs[at] < docs) if len(self.prints) else np.zeros(len(prints), bool)
        prints, docs = np.concatenate([self.prints, prints[~gone]]), np.concatenate([self.docs, docs[~gone]])
        order = np.lexsort((docs, prints))
        first = _runs_of(prints[order])[:-1]
        self.prints, self.docs = prints[order][first], docs[order][first]
        if len(self.prints) > REMEMBERED:
            self.__init__()
        return gone


def _least(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest document of each position's bucket."""
    order = np.argsort(ids, kind="stable")
    runs = _runs_of(ids[order])
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], runs[:-1]), np.diff(runs))
    return least


def _cut_runs(batches: Iterator[pa.RecordBatch], length: int, buckets: int, fine: int, slots: int, hot: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    gathered, seen = _Gathered(), _Seen()
    for batch in batches:
        ids, ths = batch.column("did").to_numpy(zero_copy_only=False), batch.column("th").to_numpy(zero_copy_only=False)
        lists = batch.column("keys")
        offs = np.asarray(lists.offsets)
        matched = np.asarray(lists.values).view(np.uint64)
        for lo, hi, raw, at in blocks(batch.column("text"), WINDOW_BYTES):
            start, end, value, row = anchors(raw, at, length)
            key = _key(value, buckets)[1]
            own = mix(matched[offs[lo] : offs[hi]] + mix(np.repeat(np.arange(hi - lo), np.diff(offs[lo : hi + 1])).astype(np.uint64)))
            hit = np.isin(mix(key + mix(row.astype(np.uint64))), own)
            start, end, key, row = start[hit], end[hit], key[hit], row[hit]
            if not len(start):
                continue
            # windows that a smaller document of this block holds are settled here; stretches that share bytes are refined as one
            apart = np.append(True, (start[1:] >= end[:-1] + length) | (row[1:] != row[:-1]))
            first = np.flatnonzero(apart)
            many, which, same = refine(raw, start[first], np.append(end[first[1:] - 1], end[-1]) + length - 1, length)
            less = np.zeros(len(raw) + 1, bool)
            if len(many):
                doc = ids[lo + row[first[which]]]
                less[many[_least(same, doc) < doc]] = True
            pos, run = _expand(start, end)
            gone = less[pos]
            common = np.isin(key, hot)[run] if len(hot) else np.zeros(len(pos), bool)
            print_ = np.zeros(len(pos), np.uint64)
            if common.any():
                print_[common] = span_hashes(raw, pos[common], pos[common] + length)
                sent = np.flatnonzero(common & ~gone)
                gone[sent] = seen.smaller(print_[sent], ids[lo + row[run[sent]]])
            p, r = pos[gone], row[run][gone]
            a, b = _joined(p, r)
            rows = _covers(ids[lo + r[a]], ths[lo + r[a]], p[a] - at[r[a]], p[b - 1] + length - at[r[a]], slots)
            # the rest goes on: runs by anchor, windows of very common anchors by content
            rest = ~gone
            p, r, g = pos[rest], row[run][rest], run[rest]
            each = np.where(common[rest], np.arange(len(p)), -1)
            a, b = _joined(p, r, g, each)
            to = (np.where(common[rest][a], print_[rest][a], mix(key[g[a]])) % np.uint64(fine)).astype(np.int64)
            begin, stop, r = p[a], p[b - 1] + length, r[a]
            gathered.add(to, ids[lo + r], ths[lo + r], begin - at[r], stop - begin, raw[_expand(begin, stop)[0]])
            if gathered.size > most:
                rows += gathered.packed()
            if rows:
                yield _rows(rows)
    if rest := gathered.packed():
        yield _rows(rest)


def refine(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of equal ``length``-byte strings inside the stretches ``begin:end``: starts, stretch, bucket.

    Positions are first bucketed by grams of FIRST_GRAM bytes; while buckets tell fewer than ``length`` bytes
    apart, each is refined by the identifiers at a later offset, as they are after earlier refinements.
    Positions whose bucket holds nothing else are unique and left out.
    """
    width = FIRST_GRAM
    pos, which = _expand(begin, end - width + 1)
    ids = np.full(len(raw) + 1, -1, np.int64)
    gram = raw.astype(np.uint64)
    for k in (1, 2, 4):  # FIRST_GRAM bytes as one number
        gram = gram[: max(len(gram) - k, 0)] | (gram[k:] << np.uint64(8 * k))
    gram = gram[pos]
    ids[pos] = np.unique(gram, return_inverse=True)[1].reshape(-1)
    del gram
    while True:
        alone = np.bincount(ids[pos], minlength=1)[ids[pos]] < 2
        if width == length:
            return pos[~alone], which[~alone], ids[pos[~alone]]
        step = min(width, length - width)
        keep = ~alone & (pos + step + width <= end[which])
        pos, which = pos[keep], which[keep]
        if not len(pos):
            return pos, which, pos
        finer = np.unique(ids[pos] * np.int64(len(raw) + 1) + ids[pos + step], return_inverse=True)[1].reshape(-1)
        # other positions keep identifiers that no refined one has
        ids[ids >= 0] += len(pos)
        ids[pos] = finer
        width += step


def _anchors_of(raw: np.ndarray, begin: np.ndarray, length: int, most: int) -> np.ndarray:
    """The anchor of each run: all windows of a run have that of its first."""
    found, some = [np.zeros(0, np.uint64)], max(1, most // length)
    for k in range(0, len(begin), some):
        first = raw[begin[k : k + some, None] + np.arange(length)]
        found.append(anchors(first.reshape(-1), np.arange(0, first.size + 1, length), length)[2])
    return np.concatenate(found)


def _portions(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of ``most`` together; a larger one makes a range of its own."""
    total, a = np.concatenate([[0], np.cumsum(sizes)]), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, b
        a = b


def _taken(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some stretches, and where each begins and ends there."""
    stop = np.cumsum(end - begin)
    return raw[_expand(begin, end)[0]], stop - (end - begin), stop


def _repeated(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the stretches that a smaller document has, and their stretches."""
    pos, run, ids = refine(raw, begin, end, length)
    if not len(pos):
        return pos, run
    gone = _least(ids, doc[run]) < doc[run]
    return pos[gone], run[gone]


def _repeated_of_anchor(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for runs of one anchor of any size: of each document's equal windows one is refined, and stands for the others."""
    pieces = -(-(end - begin - length + 1) // most)
    nth, own = _expand(np.zeros(len(begin), np.int64), pieces)
    start = begin[own] + nth * most
    stop = np.minimum(start + most, end[own] - length + 1)
    windows = list(_portions(stop - start, most))

    def told(a: int, b: int) -> tuple[np.ndarray, ...]:
        pos, which = _expand(start[a:b], stop[a:b])
        run = own[a + which]
        low = start[a:b].min()
        prints = span_hashes(raw[low : stop[a:b].max() + length - 1], pos - low, pos - low + length)
        return pos, run, prints, mix(prints + mix(doc[run].view(np.uint64)))

    parts = []
    for a, b in windows:
        pos, run, prints, key = told(a, b)
        once = np.unique(key, return_index=True)[1]
        parts.append((pos[once], run[once], prints[once], key[once]))
    pos, run, prints, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    once = np.unique(key, return_index=True)[1]
    once = once[np.argsort(pos[once])]
    pos, run, prints, key = pos[once], run[once], prints[once], key[once]
    classes = (prints % np.uint64(max(1, -(-len(pos) * length // most)))).astype(np.int64)
    order, gone = np.argsort(classes, kind="stable"), []
    at = _runs_of(classes[order])
    for x, y in zip(at[:-1], at[1:], strict=True):
        some = order[x:y]
        p, r = pos[some], run[some]
        a, b = _joined(p, r)
        text, lo, hi = _taken(raw, p[a], p[b - 1] + length)
        found, which = _repeated(text, lo, hi, doc[r[a]], length)
        gone.append(key[some][a[which] + found - lo[which]])
    dead = np.concatenate(gone)
    for a, b in windows if len(dead) else ():
        pos, run, _, key = told(a, b)
        hit = np.isin(key, dead)
        yield pos[hit], run[hit]


def _repeated_in_portions(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for runs of any size and number, which are refined at once if they are few, else by whole anchors."""
    if len(raw) <= most:
        yield _repeated(raw, begin, end, doc, length)
        return
    anchor = mix(_anchors_of(raw, begin, length, most))
    order = np.argsort(anchor, kind="stable")
    at = _runs_of(anchor[order])
    sizes = np.add.reduceat((end - begin)[order], at[:-1])
    for a, b in _portions(sizes, most):
        own = np.sort(order[at[a] : at[b]])
        if sizes[a] > most:
            for pos, run in _repeated_of_anchor(raw, begin[own], end[own], doc[own], length, most):
                yield pos, own[run]
        else:
            text, lo, hi = _taken(raw, begin[own], end[own])
            pos, run = _repeated(text, lo, hi, doc[own], length)
            yield pos - lo[run] + begin[own[run]], own[run]


def _settle(batches: Iterator[pa.RecordBatch], length: int, most: int = PART_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """Removed stretches of each part of a bucket: document, text fingerprint, start and end."""
    for rows in _by_bucket(batches):
        held = []
        for r in rows:
            lens = _back(r["lens"], np.int32).astype(np.int64)
            cuts = np.concatenate([[0], np.cumsum(np.frombuffer(r["parts"], np.int32))])
            held.append((cuts, np.concatenate([[0], np.cumsum(lens)])[cuts], _back(r["docs"], np.int64), _back(r["ths"], np.int64), _back(r["at"], np.int32).astype(np.int64), lens, _back(r["text"], np.uint8)))
        for k in range(SPLIT):
            doc, th, at, lens = (np.concatenate([h[c][h[0][k] : h[0][k + 1]] for h in held]) for c in (2, 3, 4, 5))
            raw = np.concatenate([h[6][h[1][k] : h[1][k + 1]] for h in held])
            end = np.cumsum(lens)
            begin = end - lens
            for p, r in _repeated_in_portions(raw, begin, end, doc, length, most):
                if len(p):
                    a, b = _joined(p, r)
                    yield doc[r[a]], th[r[a]], p[a] - begin[r[a]] + at[r[a]], p[b - 1] + length - begin[r[a]] + at[r[a]]


def _remains(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        starts, ends, copies = (batch.column(c).to_pylist() for c in ("starts", "ends", "copy"))
        out = []
        for i, copy in enumerate(copies):
            data = raw[at[i] : at[i + 1]]
            if copy is None:
                kept, removed, n_spans = data.tobytes(), 0, 0
            elif copy:
                kept, removed, n_spans = b"", len(data), 1
            else:
                step = np.zeros(len(data) + 1, np.int64)
                np.add.at(step, np.frombuffer(starts[i], np.int32), 1)
                np.add.at(step, np.frombuffer(ends[i], np.int32), -1)
                gone = np.cumsum(step[:-1]) > 0
                kept, removed = data[~gone].tobytes(), int(gone.sum())
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((len(data), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(list(c), pa.int64()) for c in columns[:3]], pa.array(list(columns[3]), pa.string()), pa.array(list(columns[4]), pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
        )


def repeated_substrings(docs: DataFrame, length: int = 50, texts: bool = True, bucket_bytes: int = BUCKET_BYTES, hot_share: int = HOT_SHARE, gathered: int = GATHERED) -> DataFrame:
    """Documents without the bytes that a smaller doc_id already has in a run of ``length`` bytes.

    ``docs`` has ``doc_id`` (integer) and ``text``; other columns are ignored. Returns a row per input row:
    ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept_bytes`` (null unless ``texts``; cuts may fall inside
    a character, so the rest is bytes). Strings are judged on the input, never across documents. Null
    texts count as empty; a null doc_id is smaller than any other; rows of one doc_id don't remove from each
    other. An empty table gives an empty result. Equal strings are told by 64-bit fingerprints.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    spark = docs.sparkSession
    least = F.lit(-(2**63)).cast("long")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), least).alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    tasks = min(buckets, MOST_TASKS)  # a task takes one bucket after the other
    known = docs.select("did", "th", F.xxhash64(F.lit(length), "text").alias("th2"), F.octet_length("text").alias("n"))
    first = known.groupBy("th", "th2", "n").agg(F.min("did").alias("first"))
    copies = known.join(first, ["th", "th2", "n"]).where(f"did > first and n >= {length}")
    entries = docs.select("th", "text").mapInArrow(partial(_entries, length=length, buckets=buckets), _ENTRIES)
    matches = cut(entries.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(partial(_match, hot_share=hot_share), "th long, keys array<long>, n long"))
    # each bucket names the anchors that hold too much of it; of those, at most HOT_SHARE hold that share of all
    hot = np.array([r[0] for r in matches.where("th is null").select(F.element_at("keys", 1), "n").orderBy(F.desc("n")).limit(hot_share).collect()], np.int64).view(np.uint64)
    matched = matches.where("th is not null").groupBy("th").agg(F.flatten(F.collect_list("keys")).alias("keys"))
    one = first.join(matched, "th").select(F.col("first").alias("did"), "th", "keys")
    # the same columns as in the last join, so that Spark deals the texts out once
    runs = docs.join(one, ["did", "th"]).select("doc_id", "did", "th", "text", "keys").mapInArrow(partial(_cut_runs, length=length, buckets=buckets, fine=buckets * KEYS * SPLIT, slots=buckets * SLOTS, hot=hot, most=gathered), _FOUND)
    here = runs.repartition(tasks, F.coalesce("bucket", "slot")).sortWithinPartitions("bucket")
    covers = here.mapInArrow(partial(_settle_or_pass, length=length, slots=buckets * SLOTS), _FOUND).drop("bucket", "parts", "text")
    by_slot = covers.repartition(tasks, "slot").sortWithinPartitions("slot").mapInArrow(_by_document, "did long, th long, starts binary, ends binary")
    every = by_slot.unionByName(copies.select("did", "th", F.lit(None).cast("binary").alias("starts"), F.lit(None).cast("binary").alias("ends")))
    by_doc = every.groupBy("did", "th").agg(F.first("starts", ignorenulls=True).alias("starts"), F.first("ends", ignorenulls=True).alias("ends"), F.bool_or(F.col("starts").isNull()).alias("copy"))
    whole = docs.join(by_doc, ["did", "th"], "left").select("doc_id", "text", "starts", "ends", "copy")
    return whole.mapInArrow(partial(_remains, texts=texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")


def _settle_or_pass(batches: Iterator[pa.RecordBatch], length: int, slots: int) -> Iterator[pa.RecordBatch]:
    """Covers found earlier go through; runs are settled by bucket."""
    found: list[pa.RecordBatch] = []

    def rest() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = batch.filter(batch.column("slot").is_valid())
            if done.num_rows:
                found.append(done)
            if done.num_rows < batch.num_rows:
                yield batch.filter(batch.column("slot").is_null())

    held: list[tuple[np.ndarray, ...]] = []
    for got in _settle(rest(), length):
        held.append(got)
        while found:
            yield found.pop()
        if sum(len(x[0]) for x in held) > 1_000_000:
            yield _rows(_covers(*(np.concatenate(x) for x in zip(*held, strict=True)), slots))
            held = []
    while found:
        yield found.pop()
    if held and any(len(x[0]) for x in held):
        yield _rows(_covers(*(np.concatenate(x) for x in zip(*held, strict=True)), slots))


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covers sorted by slot to a row per document text."""
    for rows in _by_bucket(batches, "slot"):
        doc, th = (np.concatenate([_back(r[k], np.int64) for r in rows]) for k in ("docs", "ths"))
        start, lens = (np.concatenate([_back(r[k], np.int32) for r in rows]) for k in ("at", "lens"))
        order = np.lexsort((start, th, doc))
        doc, th, start, end = doc[order], th[order], start[order], (start + lens)[order]
        at = np.append(np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]))), len(doc))
        parts = [[x[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] for x in (start, end)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[at[:-1]]), pa.array(th[at[:-1]]), *[pa.array(x, pa.binary()) for x in parts]], names=["did", "th", "starts", "ends"])
