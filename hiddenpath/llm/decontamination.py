"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Items are cut into windows of words. The words of a window are ordered by rarity in the documents; a window that is
contained in a document must share every word, so the prefix that must be joined is its rarest word alone.
Document words join that index; where they match, length and position bounds leave those places at which a whole
window fits, and the window is then compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiddenpath.llm.common import cut

WINDOW = 10
#: Bytes of windows that may be broadcast; a larger index is joined by shuffling.
MOST_BROADCAST = 48_000_000
#: Places of a word in one part of a shuffled join; commoner words are split. At most HOT_SHARE words are.
PART_PLACES, HOT_SHARE = 1_000_000, 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z alone; none of a null text."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: ``window_id, tokens, items``; an item of fewer words is one window."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    parts = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("tokens"))
    return parts.groupBy("tokens").agg(F.collect_set("item_id").alias("items")).withColumn("window_id", F.xxhash64("tokens"))


def _fitting(hit: DataFrame, near: str, first: Column | int, n_words: Column) -> DataFrame:
    """Matches of prefix words whose whole window fits into the text and stands there, word for word; ``near`` holds the
    text's words from place ``first`` on."""
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.size("tokens") <= n_words)
    same = F.slice(near, start - first + 1, F.size("tokens")) == F.col("tokens")
    return hit.where(fits).where(same).withColumn("start", start)


def _beside(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The places of windows by an index that every task holds; words stay in their row."""
    at = rows.select("doc_id", "th", "w", F.posexplode("w").alias("pos", "prefix"))
    return _fitting(at.join(F.broadcast(index), "prefix"), "w", 0, F.size("w"))


def _shuffled(rows: DataFrame, index: DataFrame, rarity: DataFrame, window: int) -> DataFrame:
    """The same by a shuffle of places, each with the words that a window around it can hold; common words go to several parts."""
    total = rarity.agg(F.sum("n")).first()[0] or 0
    part = max(PART_PLACES, total // HOT_SHARE)
    # at most HOT_SHARE words can have more places than total / HOT_SHARE
    hot = index.where(F.col("n") > part).select("prefix", F.ceil(F.col("n") / part).cast("int").alias("parts")).distinct()
    at = rows.select("doc_id", "th", "w", F.posexplode("w").alias("pos", "prefix"))
    first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    near = at.select("doc_id", "th", "pos", "prefix", F.size("w").alias("n_words"), first.alias("first"), F.slice("w", first + 1, 2 * window - 1).alias("near"))
    near = near.join(F.broadcast(hot), "prefix", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "th", "pos"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    dealt = index.join(F.broadcast(hot), "prefix", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return _fitting(near.join(dealt, ["prefix", "part"]), "near", F.col("first"), F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words of documents that lie inside an occurrence of a benchmark window, a row per input row.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``; other columns are ignored. Returns
    ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, text_hash`` (spans: start and number of words of
    windows; text_hash: ``xxhash64`` of the text, by which rows that share a doc_id are told apart).
    Null and empty texts have no words; items without words have no window; an item_id that is null is not
    counted or listed; rows that repeat give the same result each. An empty table of documents gives an empty
    result, an empty benchmark hits nothing. Texts of one doc_id are told by 64-bit fingerprints.
    """
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    windows = cut(item_windows(benchmark, window))
    n_bytes = windows.agg(F.sum(F.octet_length(F.concat_ws(" ", "tokens")) + 8 * F.size("items"))).first()[0] or 0
    small = n_bytes <= MOST_BROADCAST
    bounded = F.broadcast if small else lambda df: df
    vocabulary = windows.select(F.explode("tokens").alias("word")).distinct()
    every = rows.select(F.explode("w").alias("word"))
    # a vocabulary that is not sent to all tasks meets words that are counted already
    counts = every.join(bounded(vocabulary), "word").groupBy("word").count() if small else every.groupBy("word").count().join(vocabulary, "word")
    rarity = cut(vocabulary.join(counts, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("n")))
    placed = windows.select("window_id", "tokens", F.posexplode("tokens").alias("offset", "word")).join(rarity, "word")
    index = placed.groupBy("window_id").agg(F.min(F.struct("n", "word", "offset", "tokens")).alias("p")).select("window_id", F.col("p.n").alias("n"), F.col("p.word").alias("prefix"), F.col("p.offset").alias("offset"), F.col("p.tokens").alias("tokens"))
    index = cut(index.where("n > 0"))
    found = (_beside(rows, index) if small else _shuffled(rows, index, rarity, window)).select("doc_id", "th", "window_id", "start", F.size("tokens").alias("n"))
    named = found.join(bounded(windows.select("window_id", "items")), "window_id")
    by_doc = named.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.start + s.n - F.greatest(a.end, s.start))).alias("n"), F.greatest(a.end, s.start + s.n).alias("end")),
    )
    by_doc = by_doc.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "spans", "items", covered.n.cast("long").alias("hit"))
    out = rows.select("doc_id", "th", F.size("w").cast("long").alias("n_words")).join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    names = F.array_join(F.sort_array(F.coalesce(F.transform("items", lambda i: i.cast("string")), F.array().cast("array<string>"))), ",")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans", F.col("th").alias("text_hash"))
