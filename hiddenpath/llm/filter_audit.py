"""Filter interaction audit: every order of five document filters, replayed over every document.

Each document's failures are five bits. They are crossed with the 120 orders, which are broadcast, and with the five steps
of an order; the first step whose filter fails removes the document. Conditional sums by part, order and step are
combined in the tasks before the shuffle.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiddenpath.llm.common import cut
from hiddenpath.llm.graph import MANY, SHARE

#: Filters in order of their bits: short, repetitive, shouting, symbols, copy.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failures(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that ``text`` fails. Words are maximal runs of ``[^\\x20\\x09-\\x0D]``."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    fails = [
        F.size(words) < LEAST_WORDS,
        F.size(F.array_distinct(words)) * F.lit(100).cast("long") < F.size(words) * F.lit(LEAST_DISTINCT_PERCENT).cast("long"),
        F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) * F.lit(100).cast("long") > F.char_length(text) * F.lit(MOST_CAPITALS_PERCENT).cast("long"),
        text.rlike(SYMBOLS),
    ]
    return sum((f.cast("int") * 2**k for k, f in enumerate(fails)), F.lit(0))


def flag_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, part, fails`` of each row of ``docs`` (``doc_id``, ``text``, ``source``): the bits of the filters it fails.

    A null text is empty, a null source the part "". Filter E fails where a row of a smaller doc_id has the same text;
    rows of one doc_id aren't copies of each other, a null doc_id is neither smaller nor larger than another.
    Texts are told by SHA-256; the digests of frequent texts are joined without a shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), failures(text).alias("fails"), F.unhex(F.sha2(text, 256)).alias("digest")))
    copied = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null"))
    many = F.col("n") > max(MANY, (copied.agg(F.sum("n")).first()[0] or 0) // SHARE)  # SHARE digests at most
    hot, rare = copied.where(many).select("digest", "least"), copied.where(~many).select("digest", "least")
    joined = rows.join(F.broadcast(hot), "digest").unionByName(rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rare, "digest", "left"))
    copy = F.coalesce((F.col("least") < F.col("doc_id")).cast("int"), F.lit(0)) * 2**4
    return joined.select("doc_id", "part", (F.col("fails") + copy).alias("fails"))


def orders() -> list[tuple[str, int]]:
    """The 120 orders, and the bits of their filters, five to a step from the lowest on."""
    return [("".join(p), sum(1 << FILTERS.index(f) << 5 * step for step, f in enumerate(p))) for p in permutations(FILTERS)]


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step: ``part, filter_order, step``, the COUNTS and ``shapley``.

    ``docs`` has ``doc_id, text, source``, ``labels`` has ``doc_id, quality, toxic``; other columns are ignored. A doc_id that has several
    labels is good or toxic if one of them says so; one without labels is neither. Every row of ``docs`` counts as a
    document. Parts are the values of ``source``; an empty table gives no rows.
    """
    flagged = flag_documents(docs)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    unnamed = flagged.where("doc_id is null").select("part", "fails", no.alias("good"), no.alias("toxic"))
    named = flagged.where("doc_id is not null").join(known, "doc_id", "left").select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    table = docs.sparkSession.createDataFrame(orders(), "filter_order string, bits int")

    def bit(step: Column | int) -> Column:
        at = step - 1 if isinstance(step, Column) else F.lit(step - 1)
        return F.call_function("shiftright", F.col("bits"), at * 5).bitwiseAND(31)

    first = F.coalesce(*[F.when(F.col("fails").bitwiseAND(bit(k)) != 0, k) for k in range(1, 6)], F.lit(6))
    replay = named.unionByName(unnamed).crossJoin(F.broadcast(table)).withColumn("first", first).withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(1, 6)])))
    here = F.col("first") == F.col("step")
    fails_it = F.col("fails").bitwiseAND(bit(F.col("step"))) != 0
    conditions = [F.col("first") > F.col("step"), here, fails_it & (F.col("first") < F.col("step")), F.col("fails") == bit(F.col("step")), here & F.col("good"), here & F.col("toxic")]
    sums = [F.sum(c.cast("long")).alias(n) for n, c in zip(COUNTS, conditions, strict=True)]
    found = replay.groupBy("part", "filter_order", "step").agg(*sums).withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    found = cut(found)
    shapley = found.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return found.join(shapley, ["part", "letter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
