"""Quality rules: length, repetition, and divergence of histograms from language references.

DataFrame functions only. References are learned from all documents of a language: the median share of each
character class, and the shares of its commonest words. A document is rejected when the Jensen-Shannon
distance of its character classes, or of its common words, from its language's reference is too large; short
documents, whose histograms say little, are spared the tests by minimum lengths. References rest on exact counts, so
they are the same in every run on the same documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiddenpath.llm.common import cut

WINDOW = 8
#: Words of a probe, and the places, modulo PROBE_EVERY, where one stands: their differences are all numbers modulo PROBE_EVERY, and
#: PROBE_EVERY - 1 + PROBE is at most WINDOW, so a document that holds a window twice holds a probe twice.
PROBE, PROBE_EVERY, PROBE_AT = 4, 5, (0, 1, 2)
#: Fewest words of a document, and most percent of its words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Largest distance of the character classes, and of both histograms together: the second bound is this and, since
#: the histograms of n words stray from their source by about 1 / sqrt(n), so much more over sqrt(n).
MOST_CHAR_DISTANCE, MOST_BOTH, BOTH_NOISE = 0.25, 0.2, 3.0
#: Fewest words for the character and the common-word test.
CHAR_GUARD, WORD_GUARD = 40, 40
#: Common words of a language, letters of the longest that is counted by name, and documents that a language's reference needs.
COMMON_WORDS, LONGEST, LEAST_DOCUMENTS = 24, 32, 20
#: Shares are counted in so many steps.
STEPS = 10_000

CLASSES = ("upper", "digit", "symbol", "loud", "point", "blank", "rest")


@dataclass
class References:
    """Shares per language: of the character classes, and of the common words (and of the rest at the end).

    ``pooled`` has the character classes of all documents, for those of languages without reference.
    """

    chars: dict[str, list[float]]
    words: dict[str, list[str]]
    shares: dict[str, list[float]]
    pooled: list[float] | None = None


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _without_blanks(text: Column) -> Column:
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), " \t\n\x0b\x0c\r", text)


def _plain_words(text: Column) -> Column:
    """Runs of letters in lower case."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def _marks(text: Column) -> Column:
    """The characters of ``text`` that are counted one by one. Most characters go by a plain range; the costlier class, and the counts, look at few."""
    return F.regexp_replace(F.regexp_replace(text, r"[a-z ]+", ""), r"""[^\p{Lu}0-9!?.,;:'"()\-#*$%&|<>]+""", "")


def _class_counts(length: Column, blanks: Column, marks: Column) -> Column:
    """Characters of each class, in the order of CLASSES."""
    upper, digit, loud, point = [F.regexp_count(marks, F.lit(p)) for p in (r"\p{Lu}", r"[0-9]", r"[!?]", r"""[.,;:'"()-]""")]
    known = [upper, digit, _count_symbols(marks), loud, point, blanks]
    return F.array(*[x.cast("double") for x in known], (length - reduce(lambda a, b: a + b, known)).cast("double"))


def _count_symbols(marks: Column) -> Column:
    return F.regexp_count(marks, F.lit(r"[#*$%&|<>]"))


def _language(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(""))


def learn_references(docs: DataFrame) -> References:
    """References of every language of ``docs`` (``text, lang``) with LEAST_DOCUMENTS documents of LEAST_WORDS words.

    All documents count, in one pass: words by name, and the steps of the documents' class shares, are the keys of one
    exact count. A class's share is the middle of the step that holds the (lower) median. Rows without lang share a
    reference of their own. The result has COMMON_WORDS words for each language.
    """
    rows = docs.where("text is not null").select(_language(F.col("lang")).alias("lang"), "text")
    counted = rows.select("lang", F.char_length("text").cast("long").alias("n"), (F.char_length("text") - F.char_length(_without_blanks(F.col("text")))).alias("blanks"), _marks(F.col("text")).alias("marks"), _plain_words(F.col("text")).alias("plain"))
    classes = _class_counts(F.col("n"), F.col("blanks"), F.col("marks"))
    counted = counted.select("lang", "n", "plain", F.when(F.col("blanks") >= LEAST_WORDS - 1, classes).alias("classes"))
    # names of words are letters alone, so the keys of shares and of all longer words are told from them
    steps = F.transform("classes", lambda c, i: F.concat_ws(":", i, F.floor(STEPS * c / F.col("n"))))
    keys = F.concat("plain", F.coalesce(steps, F.array().cast("array<string>")))
    named = counted.select("lang", F.explode(keys).alias("key")).where("key <> ''").select("lang", F.when(F.length("key") <= LONGEST, F.col("key")).otherwise("*").alias("key"))
    counts = cut(named.groupBy("lang", "key").count())

    shares = counts.where(F.col("key").contains(":")).select("lang", F.substring_index("key", ":", 1).cast("int").alias("class"), F.substring_index("key", ":", -1).cast("int").alias("step"), "count")
    pooled = shares.groupBy("class", "step").agg(F.sum("count").alias("count")).select(F.lit(None).cast("string").alias("lang"), "class", "step", "count")
    of_class = Window.partitionBy("lang", "class")
    below = F.sum("count").over(of_class.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    placed = shares.unionByName(pooled).select("lang", "class", "step", below.alias("below"), F.sum("count").over(of_class).alias("docs"))
    medians = placed.where(f"2 * below >= docs and docs >= {LEAST_DOCUMENTS}").groupBy("lang", "class").agg(F.min("step").alias("step")).collect()
    chars: dict[str | None, list[float]] = {}
    for r in medians:
        chars.setdefault(r["lang"], [0.0] * len(CLASSES))[r["class"]] = (r["step"] + 0.5) / STEPS
    chars = {lang: [x / sum(v) for x in v] for lang, v in chars.items()}
    all_chars = chars.pop(None, None)
    if not chars:
        return References({}, {}, {}, all_chars)
    words = counts.where(~F.col("key").contains(":") & F.col("lang").isin(list(chars)))
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("count").alias("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "key"))
    top = words.where("key <> '*'").select("lang", "key", "count", rank.alias("rank")).where(f"rank <= {COMMON_WORDS}").collect()
    common: dict[str, list[str]] = {lang: [] for lang in chars}
    shares_of: dict[str, list[float]] = {lang: [] for lang in chars}
    for lang, w, n, _ in sorted(top, key=lambda r: (r[0], r[3])):
        common[lang].append(w)
        shares_of[lang].append(n / totals[lang])
    for x in shares_of.values():
        x.append(max(0.0, 1.0 - sum(x)))
    return References(chars, common, shares_of, all_chars)


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays that sum to one, from 0 to 1 (square root of bits); null if one of them is."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    parts = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    bits = F.aggregate(parts, F.lit(0.0), lambda x, y: x + y) / 2
    return F.sqrt(F.when(bits > 0, bits).when(bits.isNotNull(), 0.0))


def _by_language(values: dict[str, list], kind: str) -> Column:
    """The array of the row's language, null where there is none."""
    if not values:
        return F.lit(None).cast(f"array<{kind}>")
    pairs = [x for lang, v in values.items() for x in (F.lit(lang), F.array(*[F.lit(y) for y in v]) if v else F.array().cast(f"array<{kind}>"))]
    return F.try_element_at(F.create_map(*pairs), F.col("language"))


def apply_quality_rules(docs: DataFrame, references: References | None = None) -> DataFrame:
    """All columns of ``docs`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_distance, word_distance, kept`` in a struct ``quality``, the last column; where ``docs`` has a column of that name,
    underscores are added to it.

    ``docs`` has ``text`` and ``lang``. Words are ``[^\\x20\\x09-\\x0D]+``. ``base_failed``: under LEAST_WORDS words, or over
    MOST_REPEATED percent of the words in repeated windows of WINDOW words. ``kept``: not base_failed, and no distance
    over its bound (MOST_CHAR_DISTANCE, and MOST_BOTH + BOTH_NOISE / sqrt(n_words) for the sum). A distance is null, and its
    test passed, for documents under its word guard; documents of languages without reference are held against the character classes
    of all documents. References are learned from ``docs`` unless given. Null and empty texts have no words and fail; rows that repeat
    are judged each. An empty table gives an empty result. Windows are compared by 64-bit fingerprints.
    """
    ref = learn_references(docs) if references is None else references
    known = sorted({w for v in ref.words.values() for w in v})
    all_chars = F.array(*[F.lit(x) for x in ref.pooled]) if ref.pooled else F.lit(None).cast("array<double>")
    name = "quality"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    # few steps, as each one that has a lambda copies the arrays that it passes on
    t, w = F.col("t"), F.col("w")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("t"), _language(F.col("lang")).alias("language"))
    plain = F.array_remove(_plain_words(t), "")
    x = base.select("*", _words(t).alias("w"), plain.alias("plain"), _marks(t).alias("marks"))
    x = x.select("*", F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"))
    lines = F.filter(F.split(t, "\n"), lambda a: a.rlike(r"[^\x20\x09-\x0D]"))

    def prints(starts: Column, width: int) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, width)))

    # of two places with one window, some offset in it has both among the probed places, with a probe inside the window
    probed = F.concat(*[F.sequence(F.lit(k), F.size(w) - PROBE, F.lit(PROBE_EVERY)) for k in PROBE_AT])
    common = F.concat(F.lit("|"), F.array_join(F.filter("plain", lambda a: a.isin(known)) if known else F.array(), "||"), F.lit("|"))
    x = x.select(
        "row",
        "language",
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        _count_symbols(F.col("marks")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        "w",
        F.when(F.size(w) > WINDOW, prints(probed, PROBE)).alias("probes"),
        F.char_length(t).alias("n_text"),
        _class_counts(F.char_length(t), F.char_length(t) - F.col("word_chars"), F.col("marks")).alias("counts"),
        F.size("plain").alias("n_plain"),
        common.alias("common"),
    )
    # only documents that hold a probe twice look at all windows, and only those that hold a window twice sort them
    windows = F.when(F.size(F.array_distinct("probes")) < F.size("probes"), prints(F.sequence(F.lit(0), F.size(w) - WINDOW), WINDOW))
    x = x.select("*", windows.alias("h")).drop("w", "probes")
    order = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda v, i: F.struct(v.alias("h"), i.alias("i")))))
    found = F.transform(_by_language(ref.words, "string"), lambda c: (F.char_length("common") - F.char_length(F.replace(F.col("common"), F.concat(F.lit("|"), c, F.lit("|"))))) / (F.char_length(c) + 2))
    chars = F.transform("counts", lambda v: F.try_divide(v, F.col("n_text")))
    x = x.select("*", order.alias("s"), found.alias("found"), chars.alias("chars")).drop("h", "common", "counts")
    again = F.filter(F.transform("s", lambda v, k: F.when((v.h == F.get("s", k - 1).h) | (v.h == F.get("s", k + 1).h), v.i)), lambda i: i.isNotNull())
    covered = F.aggregate(
        F.sort_array(again),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a.n + WINDOW - F.greatest(a.end - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end")),
    )
    rest = F.col("n_plain") - F.aggregate("found", F.lit(0.0), lambda a, b: a + b)
    shares = F.transform(F.concat("found", F.array(rest)), lambda v: F.try_divide(v, F.col("n_plain")))
    x = x.select("*", F.coalesce(covered.n, F.lit(0)).cast("long").alias("n_repeat_words"), shares.alias("shares")).drop("s", "found")
    x = x.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    x = x.withColumn("char_distance", F.when(F.col("n_words") >= CHAR_GUARD, _distance(F.col("chars"), F.coalesce(_by_language(ref.chars, "double"), all_chars))))
    x = x.withColumn("word_distance", F.when((F.col("n_words") >= WORD_GUARD) & (F.col("n_plain") > 0), _distance(F.col("shares"), _by_language(ref.shares, "double"))))
    near_chars = F.coalesce("char_distance", F.lit(0.0)) <= MOST_CHAR_DISTANCE
    both = F.col("char_distance") + F.col("word_distance")
    near = near_chars & F.coalesce(both <= MOST_BOTH + BOTH_NOISE / F.sqrt("n_words"), F.lit(True))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance"]
    # a filter on the verdict must not be pushed down: it would copy the nested expressions above many times over; it
    # doesn't pass a generator
    return x.select("row.*", F.explode(F.array(F.struct(*names, (~F.col("base_failed") & near).alias("kept")))).alias(name))
