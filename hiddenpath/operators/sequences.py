"""Sequence sets as DataFrames: building, choosing, joining, and figures over all their items.

The canonical form has a row per sequence: ``seq_id``, ``obs`` (an array) and, if wanted, ``weight``. Long form has a row per
item: ``seq_id, t, x``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build(items: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """One sequence per ``key``, its values in the order of the columns ``order`` (nulls first). One shuffle."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return items.groupBy(F.col(key).alias("seq_id")).agg(packed.alias("_items")).select("seq_id", F.transform("_items", lambda r: r["_value"]).alias("obs"))


def from_lists(spark: SparkSession, rows: list[list], kind: str = "int") -> DataFrame:
    """Sequences given as lists, numbered from 0."""
    return spark.createDataFrame([(i, list(r), 1.0) for i, r in enumerate(rows)], f"seq_id long, obs array<{kind}>, weight double")


def to_long(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id", F.posexplode("obs").alias("t", "x"))


def from_long(items: DataFrame) -> DataFrame:
    return build(items, "seq_id", ["t"], "x")


def subset(seqs: DataFrame, positions: list) -> DataFrame:
    """The named sequences with their own weights, a row for each mention, and ``pos``, its place in the list."""
    wanted = seqs.sparkSession.createDataFrame([(i, s) for i, s in enumerate(positions)], f"pos int, seq_id {seqs.schema['seq_id'].dataType.simpleString()}")
    return seqs.join(F.broadcast(wanted), "seq_id")


def merge(*sets: DataFrame) -> DataFrame:
    """All sequences of all sets; duplicates stay."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out


def truncate(seqs: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Leading items kept: ceil(length * (1 - share * u)) of them, u from a hash of the id; a share of -1 keeps none."""
    if share == -1:
        return seqs.withColumn("obs", F.slice("obs", 1, 0))
    u = F.pmod(F.xxhash64(F.lit(seed), "seq_id"), F.lit(1_000_000)) / 1_000_000
    return seqs.withColumn("obs", F.slice("obs", F.lit(1), F.ceil(F.size("obs") * (1 - share * u)).cast("int")))


def partition(seqs: DataFrame, ratio: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A training part of about ``ratio`` of the sequences, and the rest, by a hash of the id."""
    first = F.pmod(F.xxhash64(F.lit(seed), "seq_id"), F.lit(1_000_000)) < ratio * 1_000_000
    return seqs.where(first), seqs.where(~F.coalesce(first, F.lit(False)))


def track_slices(seqs: DataFrame, start: int, length: int) -> DataFrame:
    """Sequences of several tracks (``obs``: an array of tracks) cut to ``length`` items from place ``start`` (from 0) on in all of them."""
    return seqs.withColumn("obs", F.transform("obs", lambda track: F.slice(track, start + 1, length)))


def to_reals(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("obs", F.transform("obs", lambda x: x.cast("double")))


def to_integers(seqs: DataFrame) -> DataFrame:
    """Items rounded to the nearest whole number of their absolute value."""
    return seqs.withColumn("obs", F.transform("obs", lambda x: F.round(F.abs(x)).cast("int")))


def all_words(spark: SparkSession, length: int, size: int) -> DataFrame:
    """All words of ``length`` symbols 0 to ``size`` - 1 in lexicographic order."""
    digits = F.array(*[F.expr(f"cast(id div {size ** (length - 1 - k)} % {size} as int)") for k in range(length)])
    return spark.range(size**length).select(F.col("id").alias("seq_id"), digits.alias("obs"))


def mean_sequence(seqs: DataFrame) -> DataFrame:
    """Sum at each position over the number of sequences: ``t, mean``."""
    total = seqs.agg(F.count("*").alias("n"))
    return to_long(seqs).groupBy("t").agg(F.sum("x").alias("s")).join(F.broadcast(total)).select("t", (F.col("s") / F.col("n")).alias("mean"))


def scatter_matrix(seqs: DataFrame, most: int | None = None) -> DataFrame:
    """Covariances of positions: ``k, l, value`` for k <= l, and l < ``most`` if given.

    Each sequence gives the products of its own positions, added up before they are shuffled; means and counts are
    of the sequences that reach the later position.
    """
    x = F.col("obs") if most is None else F.slice("obs", 1, most)
    cells = seqs.select(F.posexplode(x).alias("k", "a"), x.alias("v")).select("k", "a", F.posexplode("v").alias("l", "b")).where("k <= l")
    return cells.groupBy("k", "l").agg((F.avg(F.col("a") * F.col("b")) - F.avg("a") * F.avg("b")).alias("value"))


def extremes(seqs: DataFrame) -> DataFrame:
    """One row: ``n, total_weight, longest, items, least, most``."""
    w = F.sum("weight") if "weight" in seqs.columns else F.count("*").cast("double")
    return seqs.agg(F.count("*").alias("n"), w.alias("total_weight"), F.max(F.size("obs")).alias("longest"), F.sum(F.size("obs")).alias("items"), F.min(F.array_min("obs")).alias("least"), F.max(F.array_max("obs")).alias("most"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """How often symbols of ``x`` and ``y`` stand side by side: ``a, b, n``."""
    return pairs.select(F.explode(F.arrays_zip("x", "y")).alias("z")).groupBy(F.col("z.x").alias("a"), F.col("z.y").alias("b")).agg(F.count("*").alias("n"))


def background_estimate(seqs: DataFrame, size: int, order: int = 0) -> DataFrame:
    """Share of each symbol after each history of ``order`` symbols, one added to every count: ``history, symbol, p``."""
    code: Column = F.lit(0)
    for k in range(order):
        code = code * size + F.get("obs", F.col("t") - order + k)
    grams = seqs.select("obs", F.posexplode("obs").alias("t", "symbol")).where(F.col("t") >= order).select(code.cast("int").alias("history"), "symbol")
    counts = grams.groupBy("history", "symbol").agg(F.count("*").alias("n"))
    spark = seqs.sparkSession
    every = spark.range(size ** (order + 1)).select(F.expr(f"cast(id div {size} as int)").alias("history"), F.expr(f"cast(id % {size} as int)").alias("symbol"))
    full = every.join(counts, ["history", "symbol"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    return full.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("history"))).drop("n")


def transitions_of(seqs: DataFrame) -> DataFrame:
    """Counts of neighbouring symbols: ``src, dst, n``."""
    steps = seqs.select("obs", F.posexplode("obs").alias("t", "dst")).where("t > 0")
    return steps.groupBy(F.get("obs", F.col("t") - 1).alias("src"), "dst").agg(F.count("*").alias("n"))
