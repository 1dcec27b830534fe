"""N-gram Jaccard join by partition of the universe and the pigeonhole principle.

Equal shingle sets form classes; one record of each is joined. Sizes fall into bands. For the band of the smaller set of a
pair, hashing deals all tokens to segments, more than two linked sets can differ in: H bounds their symmetric difference.
So for every record any segments whose allowances sum up to H + 1 suffice: one linked to it either equals it in a
segment of allowance 1 or is at most one token away in one of allowance 2, for which the neighbourhoods of one deletion
are looked up.

Which segments a record uses is decided by their cost, the records it would meet. Segments that nobody else has cost nothing,
and a record with H + 1 of those has no partner and leaves; the others use their rarest segments. Records that
the used segments connect are compared exhaustively, a group to a task; larger groups by blocks with a common pivot block, which
leaves thousands of near copies in one part. What is in no such part would have to meet all blocks. Where that costs more than
deletion neighbourhoods do, these cut the group down first. Every link comes from whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiddenpath.llm.common import blocks, cut, mix
from hiddenpath.llm.graph import connected_components, split_join
from hiddenpath.llm.large_groups import NODE_RECORDS, NODE_SHINGLES, asked_links, blocks_of, links_of, own_sets, pivot_links, rests, shingle_sets, signatures, texts_of

#: Shares of a group's rest that are taken to all blocks at once; a larger rest pays for deletion neighbourhoods.
CHEAP_TURNS = 2
#: Rounds in which records that others leave without partners leave too.
PEELS = 2
_C = [np.uint64(x | 1) for x in (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC6BC279692B5C323)]


@cache
def size_bands(percent: int) -> np.ndarray:
    """The least sizes of the bands, up to 2 ** 40. Partners' sizes differ by half a band's breadth at most, so that
    about every other set is in one band only: fewer, narrower bands cost most sets two."""
    least = [1, 2**40] if percent == 100 else [1]  # where only equal sets link, sizes don't matter
    while least[-1] < 2**40:
        least.append(max(least[-1] + 1, (least[-1] - 1) * 10_000 // percent**2 + 1))
    return np.array(least, np.int64)


def allowed(bands: np.ndarray, band: np.ndarray, percent: int) -> np.ndarray:
    """H: the largest symmetric difference of linked sets whose smaller one is in the band.

    100 * intersection >= percent * union gives union - intersection <= intersection * (100 - percent) / percent.
    """
    return (bands[band + 1] - 1) * (100 - percent) // percent


def segments(tokens: np.ndarray, offs: np.ndarray, percent: int) -> dict[str, np.ndarray]:
    """Every row once for each band it can be in a pair of, and its tokens dealt to the band's segments.

    ``row, band, need, m`` by entry; ``base`` its first cell; ``cell, value`` by token; ``sums, counts, salt`` by cell.
    A cell's sum of values names its content. Bands whose linked sets are equal have no entries.
    """
    bands = size_bands(percent)
    sizes = np.diff(offs)
    own = np.searchsorted(bands, sizes, "right") - 1
    lowest = np.searchsorted(bands, -(-percent * sizes // 100), "right") - 1
    times = np.where(sizes > 0, own - lowest + 1, 0)
    row = np.repeat(np.arange(len(sizes)), times)
    band = np.repeat(lowest, times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    most = allowed(bands, band, percent)
    row, band, most = row[most > 0], band[most > 0], most[most > 0]
    m = most + 2 + most // 8  # a few more than needed, for those that are empty or frequent
    base = np.concatenate([[0], np.cumsum(m)])
    n = sizes[row]
    entry = np.repeat(np.arange(len(row)), n)
    x = tokens[np.arange(len(entry)) + np.repeat(offs[row] - (np.cumsum(n) - n), n)]
    dealt = mix(x + (band.astype(np.uint64) * _C[0])[entry]) >> np.uint64(32)
    cell = base[entry] + ((dealt * m.astype(np.uint64)[entry]) >> np.uint64(32)).astype(np.int64)
    value = mix(x ^ _C[1])
    sums, counts = np.zeros(base[-1], np.uint64), np.bincount(cell, minlength=base[-1])
    np.add.at(sums, cell, value)
    place = np.arange(base[-1]) - np.repeat(base[:-1], m)
    salt = mix(np.repeat(band, m).astype(np.uint64) * _C[2] + place.astype(np.uint64) * _C[3])
    return {"row": row, "band": band, "need": most + 1, "m": m, "base": base, "cell": cell, "value": value, "sums": sums, "counts": counts, "salt": salt}


def _sets(batches: Iterator[pa.RecordBatch], width: int, percent: int | None) -> Iterator[pa.RecordBatch]:
    """Size and signature of each row's set, and with ``percent`` the contents of its segments by band."""
    for batch in batches:
        for lo, hi, raw, at in blocks(batch.column("text")):
            tokens, offs = shingle_sets(raw, at, width)
            sig = signatures(tokens, offs)
            columns = {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_shingles": pa.array(np.diff(offs)), "sig_a": pa.array(sig[0]), "sig_b": pa.array(sig[1])}
            if percent is not None:
                s = segments(tokens, offs, percent)
                full = s["counts"] > 0
                keys = mix(s["sums"] + s["salt"])[full].view(np.int64)
                of_entry = np.concatenate([[0], np.cumsum(full)])[s["base"]].astype(np.int32)
                of_row = np.searchsorted(s["row"], np.arange(hi - lo + 1)).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(s["band"].astype(np.int32)), pa.array(s["need"]), pa.ListArray.from_arrays(pa.array(of_entry), pa.array(keys))], names=["band", "need", "keys"])
                columns["parts"] = pa.ListArray.from_arrays(pa.array(of_row), parts)
            yield pa.RecordBatch.from_pydict(columns)


def _neighbourhoods(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """A row for the content of each segment, empty ones too, and (``gone``) for what is left of it without one of its tokens."""
    for part, rows, tokens, offs in own_sets(batches, width, 500_000):
        s = segments(tokens, offs, percent)
        entry = np.repeat(np.arange(len(s["row"])), s["m"])
        cells = np.concatenate([np.arange(len(s["sums"])), s["cell"]])
        keys = mix(np.concatenate([s["sums"], s["sums"][s["cell"]] - s["value"]]) + s["salt"][cells])
        cls, groups = (part.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("cls", "hot"))
        of = entry[cells]
        yield pa.RecordBatch.from_arrays(
            [pa.array(groups[s["row"]][of]), pa.array(keys.view(np.int64)), pa.array(cls[s["row"]][of]), pa.array(s["band"].astype(np.int32)[of]), pa.array(s["need"][of].astype(np.int32)), pa.array((cells - s["base"][of]).astype(np.int32)), pa.array(np.arange(len(cells)) >= len(s["sums"]))],
            names=["hot", "key", "cls", "band", "need", "place", "gone"],
        )


def _lists(rows: DataFrame) -> DataFrame:
    """``rows`` (``cls, band, key``) of keys that several records have, with the number ``size`` of these."""
    shared = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    return split_join(rows, shared.select("key", "n", F.col("n").alias("size")), ["key"], shared.agg(F.sum("n")).first()[0] or 0)


def _star_edges(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each record of a list with the list's smallest record."""
    least = cut(rows.groupBy(*key).agg(F.min("cls").alias("least"), F.count("*").alias("n")).where("n > 1"))
    return split_join(rows, least, key, least.agg(F.sum("n")).first()[0] or 0).select(F.col("cls").alias("a"), F.col("least").alias("b"))


def _groups(edges: DataFrame, classes: DataFrame, node_records: int) -> DataFrame:
    """The records that edges connect: ``cls, rep, sig, n_shingles``, their group ``hot`` and its number of ``records`` and shingles ``s``."""
    found = connected_components(edges)
    placed = cut(found.join(classes, found.v == classes.cls).select("cls", "rep", F.col("sig_a").alias("sig"), "n_shingles", F.col("component").alias("hot")))
    stats = cut(placed.groupBy("hot").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")))
    stats = stats.withColumn("records", F.col("n")).withColumn("large", (F.col("n") > node_records) | (F.col("s") > NODE_SHINGLES) & (F.col("n") > 2))
    return cut(split_join(placed, stats, ["hot"], placed.count()))


def _first_level(classes: DataFrame) -> DataFrame:
    """Edges among records that use a segment in common, chosen by the length of its list."""
    entries = classes.select("cls", F.inline("parts"))
    rows = entries.select("cls", "band", F.explode("keys").alias("key"))
    need = entries.select("cls", "band", (F.col("need") - F.size("keys")).alias("short"))  # plus the shared ones: what the free ones leave open
    for _ in range(PEELS):
        rows = cut(_lists(rows.select("cls", "band", "key")))
        left = rows.groupBy("cls", "band").agg(F.count("*").alias("c")).join(need, ["cls", "band"]).select("cls", "band", (F.col("short") + F.col("c")).alias("k")).where("k > 0")
        rows = cut(rows.join(left, ["cls", "band"]).select("cls", "band", "key", "size", "k"))
    # what left in the last round makes lists shorter, which only makes them cheaper
    rank = F.row_number().over(Window.partitionBy("cls", "band").orderBy("size", "key"))
    used = rows.withColumn("rank", rank).where("rank <= k").groupBy("key").agg(F.count("*").alias("probes"))
    total = cut(rows.groupBy("key").agg(F.count("*").alias("n")).join(used, "key").select("key", "n"))
    return _star_edges(split_join(rows.select("key", "cls"), total, ["key"], total.agg(F.sum("n")).first()[0] or 0), ["key"])


def _second_level(large: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges among records of large groups, with allowance 2 where that costs less."""
    wanted = cut(texts_of(large, texts, "cls", "hot"))
    # computed anew where they are needed: a row per token is more than the texts
    rows = wanted.mapInArrow(partial(_neighbourhoods, width=width, percent=percent), "hot long, key long, cls long, band int, need int, place int, gone boolean")
    met = rows.groupBy("hot", "key").agg(F.count("*").alias("n"), F.count_if(~F.col("gone")).alias("whole"))
    met = cut(met.where("n > 1").withColumn("without", F.col("n") - F.col("whole")))
    near = cut(split_join(rows, met, ["hot", "key"], met.agg(F.sum("n")).first()[0] or 0))
    # records met with allowance 1: the same content; with 2 also content with one token more or less
    same, more = F.col("whole") - 1, F.when(F.col("gone"), F.col("whole")).otherwise(F.col("without"))
    costs = near.groupBy("cls", "band", "place").agg(F.sum(F.when(~F.col("gone"), same).otherwise(0)).alias("one"), F.sum(more).alias("two"))
    entries = rows.where("not gone").select("cls", "band", "need", "place").join(costs, ["cls", "band", "place"], "left")
    entries = entries.withColumn("one", F.coalesce("one", F.lit(0))).withColumn("two", F.coalesce("two", F.lit(0)))
    # the second unit of a segment comes after its first, so it never costs less than that
    units = entries.select("cls", "band", "need", "place", F.inline(F.array(F.struct(F.lit(1).alias("unit"), F.col("one").alias("cost")), F.struct(F.lit(2).alias("unit"), F.greatest("one", "two").alias("cost")))))
    rank = F.row_number().over(Window.partitionBy("cls", "band").orderBy("cost", "unit", "place"))
    chosen = units.withColumn("rank", rank).where("rank <= need and cost > 0").groupBy("cls", "band", "place").agg(F.max("unit").alias("allowance"))
    probes = near.join(chosen, ["cls", "band", "place"]).where("allowance = 2 or not gone")
    used = probes.groupBy("hot", "key").agg((F.max("allowance") == 2).alias("wide"))
    used = cut(met.join(used, ["hot", "key"]).select("hot", "key", "n", "wide"))
    met_rows = split_join(near.select("hot", "key", "cls", "gone"), used, ["hot", "key"], used.agg(F.sum("n")).first()[0] or 0).where("wide or not gone")
    return _star_edges(met_rows.select("hot", "key", "cls"), ["hot", "key"])


def _whole_groups(groups: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    return links_of(groups.where("not large").select(F.xxhash64("hot", F.lit(0)).alias("node"), "rep", "sig", F.lit(True).alias("probe")), texts, width, percent)


def _large_links(large: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int, node_records: int) -> DataFrame:
    """Links of groups of more records than a task takes."""
    blocked = blocks_of(large, node_records)
    links = pivot_links(blocked, texts, width, percent)
    rest = rests(blocked, links, node_records)
    out = links.unionByName(asked_links(rest.where(F.col("turns") <= CHEAP_TURNS), texts, width, percent))
    dear = rest.where(F.col("turns") > CHEAP_TURNS)
    if dear.isEmpty():
        return out
    groups = _groups(_second_level(dear, texts, width, percent), classes, node_records)
    out = out.unionByName(_whole_groups(groups, texts, width, percent))
    still = groups.where("large")
    if not still.isEmpty():
        blocked = blocks_of(still, node_records)
        links = pivot_links(blocked, texts, width, percent)
        out = out.unionByName(links).unionByName(asked_links(rests(blocked, links, node_records), texts, width, percent))
    return out


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80, node_records: int = NODE_RECORDS) -> DataFrame:
    """Documents linked by the exact Jaccard similarity of word shingles: ``doc_id, n_shingles, component_id``, a row per input row.

    ``docs`` has ``doc_id`` (integer) and ``text``; other columns are ignored. Words are ``[^\\x20\\x09-\\x0D]+`` after
    lower-casing A-Z, shingles ``width`` words, or all of a text of fewer. Documents link when 100 * intersection >=
    ``percent`` * union (1 to 100); a component is what links reach, named by its smallest doc_id. Null, empty and blank texts have no shingles and
    are their own component. Rows that share a doc_id are one document. A null doc_id can't name a component: its
    component_id is null. An empty table gives an empty result. ``node_records`` bounds a task's exhaustive comparison and
    changes no result.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = "doc_id long, n_shingles long, sig_a long, sig_b long"
    own = cut(docs.mapInArrow(partial(_sets, width=width, percent=None), fields))
    split = docs.where("doc_id is not null and text is not null").mapInArrow(partial(_sets, width=width, percent=percent), f"{fields}, parts array<struct<band:int,need:long,keys:array<long>>>")
    classes = cut(split.where("n_shingles > 0").groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("rep"), F.first("parts").alias("parts"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n")))
    # a number of its own for each class: rows of one doc_id may have several sets
    classes = classes.withColumn("cls", F.monotonically_increasing_id())
    texts = docs.where("doc_id is not null and text is not null")
    groups = _groups(_first_level(classes), classes, node_records)
    edges = _whole_groups(groups, texts, width, percent)
    large = groups.where("large")
    if not large.isEmpty():
        edges = edges.unionByName(_large_links(large, classes, texts, width, percent, node_records))
    # rows that share a doc_id are one vertex: each class of such a row links to it
    some = own.where("n_shingles > 0 and doc_id is not null").select("doc_id", "sig_a", "sig_b")
    twins = split_join(some, classes.select("sig_a", "sig_b", "rep", "n"), ["sig_a", "sig_b"], some.count())
    found = connected_components(edges.unionByName(twins.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    joined = own.select("doc_id", "n_shingles").join(found, F.col("doc_id") == found.v, "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
