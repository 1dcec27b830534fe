"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiddenpath.llm.common import cut


#: Rows that a task of a round takes at least: a small graph on many shuffle partitions would be mostly empty files.
TASK_ROWS = 250_000
#: Keys of more rows than this, and than one in SHARE of all rows, are joined without a shuffle: at most SHARE keys.
MANY, SHARE = 500, 5000


def split_join(rows: DataFrame, of_key: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` inner-joined to ``of_key``, which has one row per key and in ``n`` the number of ``rows`` of the key.

    ``total`` is the number of ``rows``. The keys that hold a large share of them, SHARE at most, are sent to all tasks, so that no
    task gets all rows of a hot key; the others are joined by a shuffle. ``n`` is left out of the result.
    """
    many = F.col("n") > max(MANY, total // SHARE)
    hot = F.broadcast(of_key.where(many).drop("n"))
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(of_key.where(many).select(*keys)), keys, "left_anti").join(of_key.where(~many).drop("n"), keys))


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` of longs to ``(v, component)``: each vertex with the smallest vertex it reaches.

    Every round is two grouped minima and two joins on the edge table, those of vertices with many edges without a
    shuffle, so no component or vertex is ever held by one task or the driver. Nulls and loops are ignored; an empty table gives an empty table. Rounds end
    when the edges no longer change, which takes about log2 of the longest path.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct())
    before = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if tuple(sums) == before or not sums[0]:
            break
        before, tasks = tuple(sums), 2 * sums[0] // TASK_ROWS + 1
        both = now.unionByName(now.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # large star: larger neighbours of u go to the smallest vertex around u
        large = split_join(both, least, ["u"], 2 * sums[0]).where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w"))
        large = cut(large.coalesce(tasks).distinct().coalesce(tasks))
        # small star: the smaller neighbours of u, and u, go to the smallest of them
        small = large.groupBy("u").agg(F.min("w").alias("m"), F.count("*").alias("n"))
        hang = split_join(large, small, ["u"], sums[0]).select(F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w")
        now = cut(hang.unionByName(small.select("u", F.col("m").alias("w"))).coalesce(tasks).distinct().coalesce(tasks))
    return now.groupBy("u").agg(F.min("w").alias("component")).select(F.col("u").alias("v"), "component").unionByName(now.select(F.col("w").alias("v"), F.col("w").alias("component")).distinct())
