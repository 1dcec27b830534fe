"""Exhaustive comparison of groups of records by whole shingle sets, in tasks of bounded size.

A small group is one task's. A larger one is dealt to blocks, each of which meets a common pivot block: near copies end in one
part by that. Records outside a group's largest part then meet all blocks, a share of them at a time. Parts are joined by
links only, so no pair inside one part needs to be compared, and every pair of different parts is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiddenpath.llm.common import BLOCK_BYTES, SPACE_WORD, ascii_lower, blocks, cut, mix, span_hashes, word_spans
from hiddenpath.llm.graph import connected_components, split_join

#: Records and shingles that one task compares exhaustively.
NODE_RECORDS, NODE_SHINGLES = 4096, 4_000_000

_C = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C14, 0xC2B2AE3D27D4EB4E, 0x165667B19E3779F8, 0xD6E8FEB86659FD92, 0xA0761D6478BD642E)]


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle fingerprints of each row, concatenated, and their offsets.

    A row of fewer than ``width`` words has its whole word sequence as one shingle; one without words has none.
    """
    raw = ascii_lower(raw)
    s, e, first = word_spans(raw, at, SPACE_WORD)
    words = span_hashes(raw, s, e)
    count = np.diff(first)
    rolled = np.zeros(len(words), np.uint64)
    if len(words) >= width:
        n = len(words) - width + 1
        for k in range(width):
            rolled[:n] += mix(words[k : k + n] + np.uint64(k)) * _C[k % 5]
        rolled = mix(rolled)
    out, sizes = [], np.zeros(len(count), np.int64)
    for i, n in enumerate(count):
        if n >= width:
            got = np.unique(rolled[first[i] : first[i] + n - width + 1])
        elif n:
            part = words[first[i] : first[i] + n]
            got = mix((mix(part + np.arange(n, dtype=np.uint64)) * np.uint64(2 * n + 1)).sum(keepdims=True, dtype=np.uint64))
        else:
            continue
        out.append(got)
        sizes[i] = len(got)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def signatures(tokens: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sig = np.zeros((2, len(offs) - 1), np.uint64)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        sig[0, full] = np.add.reduceat(mix(tokens + _C[2]), offs[full])
        sig[1, full] = np.bitwise_xor.reduceat(mix(tokens * _C[3]), offs[full])
    return sig.view(np.int64)


def linked(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a node's records, every link of the node considered.

    Starting from each record not yet reached, records are compared with all those not yet reached whose size
    allows the similarity; what links is reached and searched from in turn.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    left, edges = order, []
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    at = np.concatenate([[0], np.cumsum(sizes)])
    flag = np.zeros(int(tokens.max()) + 1, bool)
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        i = queue.pop()
        n = sizes[i]
        near = sizes[left]
        a, b = np.searchsorted(near, -(-percent * n // 100), "left"), np.searchsorted(near, 100 * n // percent, "right")
        if a >= b:
            continue
        some = left[a:b]
        mine = tokens[at[i] : at[i + 1]]
        flag[mine] = True
        if len(some) == 1:
            common = np.array([np.count_nonzero(flag[tokens[at[some[0]] : at[some[0] + 1]]])])
        else:
            lens = sizes[some]
            begin = np.concatenate([[0], np.cumsum(lens)])
            where = np.arange(begin[-1]) + np.repeat(at[some] - begin[:-1], lens)
            common = np.add.reduceat(flag[tokens[where]].astype(np.int64), begin[:-1])
        flag[mine] = False
        hit = 100 * common >= percent * (n + sizes[some] - common)
        for j in some[hit]:
            edges.append((ids[i], ids[j]))
            queue.append(int(j))
        if hit.any():
            left = np.concatenate([left[:a], some[~hit], left[b:]])
    return edges


def crossed(ids: list[int], sets: list[np.ndarray], probe: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """All links between the probing records and the others, or among the probing ones."""
    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    tokens = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1].reshape(-1)
    at = np.concatenate([[0], np.cumsum(sizes[order])])
    flag, edges = np.zeros(int(tokens.max()) + 1, bool), []
    near = sizes[order]
    for i in np.flatnonzero(probe[order]):
        n = near[i]
        a, b = np.searchsorted(near, -(-percent * n // 100), "left"), np.searchsorted(near, 100 * n // percent, "right")
        mine = tokens[at[i] : at[i + 1]]
        flag[mine] = True
        common = np.add.reduceat(flag[tokens[at[a] : at[b]]].astype(np.int64), at[a:b] - at[a])
        flag[mine] = False
        for j in np.flatnonzero(100 * common >= percent * (n + near[a:b] - common)) + a:
            if j != i:
                edges.append((ids[order[i]], ids[order[j]]))
    return edges


def own_sets(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of batches, their rows whose text has the wanted set (a doc_id's rows may have several; any where ``sig`` is null), and those rows' tokens."""
    for batch in batches:
        for lo, hi, raw, at in blocks(batch.column("text"), most):
            part = batch.slice(lo, hi - lo)
            tokens, offs = shingle_sets(raw, at, width)
            same = offs[:-1] < offs[1:]
            if part.column("sig").null_count < part.num_rows:
                same &= signatures(tokens, offs)[0] == part.column("sig").to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(same)
            n = np.diff(offs)[rows]
            keep = np.arange(n.sum()) + np.repeat(offs[:-1][rows] - (np.cumsum(n) - n), n)
            yield part, rows, tokens[keep], np.concatenate([[0], np.cumsum(n)])


def _compare(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node to links: of all records of a node up to connection, or of its probing ones if it has others too."""
    node, ids, sets, probe = None, [], [], []

    def done() -> pa.RecordBatch:
        edges = []
        if len(ids) > 1 and any(probe):
            edges = linked(ids, sets, percent) if all(probe) else crossed(ids, sets, np.array(probe), percent)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([x for _, x in edges], pa.int64())], names=["a", "b"])

    for part, rows, tokens, offs in own_sets(batches, width, BLOCK_BYTES):
        nodes, reps, probes = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "rep", "probe"))
        for i, row in enumerate(rows.tolist()):
            if nodes[row] != node:
                yield done()
                node, ids, sets, probe = nodes[row], [], [], []
            ids.append(int(reps[row]))
            sets.append(tokens[offs[i] : offs[i + 1]])
            probe.append(bool(probes[row]))
    yield done()


def texts_of(records: DataFrame, texts: DataFrame, *names: str) -> DataFrame:
    return records.join(texts, records.rep == texts.doc_id).select("rep", "sig", *names, "text")


def links_of(nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts_of(nodes, texts, "node", "probe").repartition(parts, "node").sortWithinPartitions("node").mapInArrow(partial(_compare, width=width, percent=percent), "a long, b long")


def blocks_of(large: DataFrame, node_records: int) -> DataFrame:
    """Records of large groups dealt to blocks, two of which a task takes."""
    side = F.ceil(F.greatest(F.col("records") / node_records, F.col("s") / NODE_SHINGLES) * 2).cast("int")
    own = F.pmod(F.xxhash64("cls"), F.col("side")).cast("int")
    return cut(large.withColumn("side", side).withColumn("own", own).select("hot", "cls", "rep", "sig", "n_shingles", "side", "own"))


def pivot_links(blocked: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links inside each block and with the pivot block 0, which goes to every other block."""
    to = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("side") - 1)).otherwise(F.array("own"))
    cells = blocked.select("hot", "rep", "sig", F.explode(to).alias("cell")).select(F.xxhash64("hot", "cell").alias("node"), "rep", "sig", F.lit(True).alias("probe"))
    return cut(links_of(cells, texts, width, percent))


def rests(blocked: DataFrame, links: DataFrame, node_records: int) -> DataFrame:
    """Records of groups that links leave in several parts, with their ``part``, the group's largest, ``main``, and the number of
    shares ``turns`` of its other records."""
    found = connected_components(links)
    placed = cut(blocked.join(found, blocked.rep == found.v, "left").withColumn("part", F.coalesce("component", "rep")).drop("v", "component"))
    parts = placed.groupBy("hot", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    main = parts.groupBy("hot").agg(F.max(F.struct("n", "part", "s")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("parts > 1")
    turns = F.ceil(F.greatest((F.col("n") - F.col("top.n")) / node_records, (F.col("s") - F.col("top.s")) / NODE_SHINGLES) * 2)
    open_ = cut(main.select("hot", F.col("top.part").alias("main"), "n", F.greatest(F.lit(1), turns).cast("int").alias("turns")))
    return cut(split_join(placed, open_, ["hot"], open_.agg(F.sum("n")).first()[0] or 0))


def asked_links(rest: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of records outside the main part with all others: a share of them meets each block in a task."""
    other, turn = F.col("part") != F.col("main"), F.pmod(F.xxhash64("cls", F.lit(1)), F.col("turns")).cast("int")
    asking = rest.where(other).select("hot", "cls", "rep", "sig", turn.alias("share"), F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("cell"), F.lit(True).alias("probe"))
    asked = rest.select("hot", "cls", "rep", "sig", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("share"), F.col("own").alias("cell"), F.lit(False).alias("probe"))
    cells = asking.unionByName(asked).groupBy("hot", "cls", "rep", "sig", "share", "cell").agg(F.max("probe").alias("probe"))
    return links_of(cells.select(F.xxhash64("hot", "share", "cell", F.lit(2)).alias("node"), "rep", "sig", "probe"), texts, width, percent)
