"""MinHash near-duplicate detection by a chosen-path set similarity join.

Documents become sets of word shingles; equal sets form classes, and one record per class is joined.
In each of ``trees`` independent trees a record walks a path: every node chooses, by a hash of its own, the
minwise token of the record's set, and records that choose the same token go to the same child. Two sets
of Jaccard similarity s stay together at a node with probability s. Nodes that are small are compared
exhaustively on full sets. Records of larger ones form groups, of all that large nodes connect. A group is compared
by blocks with a pivot block if it has no more blocks than the next trees would make copies; else its records walk
new trees, deeper and so many more that they lose next to no pair. Groups left after the last depth are compared by blocks,
so depth never costs recall. Components of the confirmed links are the groups of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiddenpath.llm import large_groups
from hiddenpath.llm.common import blocks, cut, mix
from hiddenpath.llm.graph import connected_components, split_join
from hiddenpath.llm.large_groups import NODE_RECORDS, NODE_SHINGLES, linked, shingle_sets  # noqa: F401

#: Independent trees of the first levels, the last depth and the step to it: a pair of similarity 0.8 is missed by the
#: first trees with probability (1 - 0.8 ** 2) ** 16, about 7.96e-8, and by those of each later depth with LATER_MISS at most:
#: under 8e-8 in all at whatever depth a group is settled.
TREES, FIRST_DEPTH, LAST_DEPTH, STEP, LATER_MISS = 16, 2, 24, 2, 3e-11
_C = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C14, 0xC2B2AE3D27D4EB4E, 0x165667B19E3779F8, 0xD6E8FEB86659FD92, 0xA0761D6478BD642E)]


def children(tokens: np.ndarray, at: np.ndarray, node: np.ndarray, turn: int) -> np.ndarray:
    """The child that each row's set chooses at its node: the minwise token under the node's own hash."""
    own = mix(node + np.uint64(2 * turn + 1) * _C[2])
    with np.errstate(over="ignore"):
        chosen = np.minimum.reduceat((tokens ^ np.repeat(own, np.diff(at))) * _C[turn % 5], at[:-1])
    return mix(chosen + own)


def _sets(batches: Iterator[pa.RecordBatch], width: int, trees: int) -> Iterator[pa.RecordBatch]:
    roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * _C[0])
    for batch in batches:
        for lo, hi, raw, at in blocks(batch.column("text")):
            tokens, offs = shingle_sets(raw, at, width)
            sizes = np.diff(offs)
            full = np.flatnonzero(sizes)
            some = np.append(offs[:-1][full], offs[-1])
            keys = np.zeros((len(full), trees), np.uint64)
            sig = np.zeros((2, hi - lo), np.uint64)
            if len(full):
                for t in range(trees):
                    node = np.full(len(full), roots[t], np.uint64)
                    for _ in range(FIRST_DEPTH):
                        node = children(tokens, some, node, 0)
                    keys[:, t] = node
                sig[0, full] = np.add.reduceat(mix(tokens + _C[3]), some[:-1])
                sig[1, full] = np.bitwise_xor.reduceat(mix(tokens * _C[4]), some[:-1])
            offsets = np.zeros(hi - lo + 1, np.int32)
            offsets[1:] = np.cumsum(np.where(sizes > 0, trees, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(sizes), pa.array(sig[0].view(np.int64)), pa.array(sig[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))],
                names=["doc_id", "n_shingles", "sig_a", "sig_b", "keys"],
            )


def trees_at(depth: int, percent: int) -> int:
    """Trees of ``depth`` levels that lose a pair of similarity ``percent`` with a probability of at most LATER_MISS."""
    return math.ceil(math.log(LATER_MISS) / math.log1p(-((percent / 100) ** depth))) if percent < 100 else 1


def _regrow(batches: Iterator[pa.RecordBatch], width: int, trees: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Records to their nodes at ``depth`` in ``trees`` trees that no other depth has."""
    roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * _C[0] + np.uint64(depth) * _C[3])
    for batch in batches:
        for lo, hi, raw, at in blocks(batch.column("text")):
            tokens, offs = shingle_sets(raw, at, width)
            for root in roots:
                node = np.full(hi - lo, root, np.uint64)
                for _ in range(depth):
                    node = children(tokens, offs, node, 0)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column("rep").slice(lo, hi - lo), batch.column("n_shingles").slice(lo, hi - lo)], names=["node", "rep", "n_shingles"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = TREES, node_records: int = NODE_RECORDS) -> DataFrame:
    """Groups of near-duplicate documents: ``doc_id, n_shingles, component_id, kept``, a row per input row.

    ``docs`` has ``doc_id`` (integer) and ``text``; other columns are ignored. Words are
    ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, shingles ``width`` words. Documents are linked when
    100 * intersection >= ``percent`` * union. Null, empty and blank texts have no shingles and are their own
    component. Rows that share a doc_id are one document. A null doc_id can't name a component: its
    component_id is null and it is kept. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    own = cut(docs.mapInArrow(partial(_sets, width=width, trees=trees), "doc_id long, n_shingles long, sig_a long, sig_b long, keys array<long>"))
    some = own.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    nodes = classes.select(F.explode("keys").alias("node"), "rep", "n_shingles").where("node is not null")
    texts = docs.where("doc_id is not null and text is not null")
    small: list[DataFrame] = []
    blocked: list[DataFrame] = []
    depth = FIRST_DEPTH
    while True:
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("members"), F.min("rep").alias("least")).where("n > 1")
        sizes = cut(sizes).withColumn("large", (F.col("n") > node_records) | (F.col("s") > NODE_SHINGLES) & (F.col("n") > 2))
        # nodes of several trees with the same members need one comparison, and join the same records to a group
        once = sizes.groupBy("n", "s", "members", "large", "least").agg(F.min("node").alias("node"))
        members = cut(split_join(nodes, once.select("node", "large", "least", "n"), ["node"], sizes.agg(F.sum("n")).first()[0] or 0))
        small.append(members.where("not large").select("node", "rep"))
        large = members.where("large")
        if large.isEmpty():
            break
        found = connected_components(large.select(F.col("rep").alias("a"), F.col("least").alias("b")))
        hot = cut(large.select("rep", "n_shingles").distinct().join(found, F.col("rep") == found.v).select("rep", "n_shingles", F.col("component").alias("hot")))
        side = F.ceil(F.greatest(F.count("*") / node_records, F.sum("n_shingles") / NODE_SHINGLES) * 2).cast("int")
        hot = cut(split_join(hot, hot.groupBy("hot").agg(side.alias("k"), F.count("*").alias("n")), ["hot"], hot.count()))
        depth += STEP
        more = trees_at(depth, percent)
        whole = F.lit(depth > LAST_DEPTH) | (F.col("k") <= more)
        deal = F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")
        blocked.append(cut(hot.where(whole).select("hot", F.col("rep").alias("cls"), "rep", F.lit(None).cast("long").alias("sig"), "n_shingles", F.col("k").alias("side"), deal.alias("own"))))
        left = hot.where(~whole)
        if left.isEmpty():
            break
        nodes = cut(left.join(texts, left.rep == texts.doc_id).select("rep", "n_shingles", "text").mapInArrow(partial(_regrow, width=width, trees=more, depth=depth), "node long, rep long, n_shingles long").distinct())
    pairs = small[0]
    for x in small[1:]:
        pairs = pairs.unionByName(x)
    edges = large_groups.links_of(pairs.select("node", "rep", F.lit(None).cast("long").alias("sig"), F.lit(True).alias("probe")), texts, width, percent)
    for x in blocked:
        links = large_groups.pivot_links(x, texts, width, percent)
        edges = edges.unionByName(links).unionByName(large_groups.asked_links(large_groups.rests(x, links, node_records), texts, width, percent))
    # rows that share a doc_id are one vertex: each class of such a row links to it
    twins = split_join(some.select("sig_a", "sig_b", "doc_id"), classes.select("sig_a", "sig_b", "rep", "n"), ["sig_a", "sig_b"], some.count())
    links = edges.unionByName(twins.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = connected_components(links)
    joined = own.select("doc_id", "n_shingles").join(found, own.doc_id == found.v, "left")
    group = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", group.alias("component_id"), F.coalesce(group == F.col("doc_id"), F.lit(True)).alias("kept"))
