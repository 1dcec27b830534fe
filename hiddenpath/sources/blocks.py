"""Block text sets as a data source: byte ranges of a file are read by tasks of their own.

A range begins behind the first mark (``;``, ``{`` or ``}``) that ends a statement after its first whole line, and goes on
to where the next range begins, so every statement is read once. Which block a range begins in only the ranges before it tell:
each range is summed up in a row, and running sums over those few rows number blocks and sequences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "sequence_blocks"
#: Bytes of a range.
RANGE_BYTES = 32_000_000
_MARK = re.compile(r"[;{}]")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def statements(path: str, start: int, end: int) -> Iterator[tuple[str, str]]:
    """Statements of a range with the marks that end them; remarks are left out and blanks joined."""
    system, name = _opened(path)
    with system.open_input_file(name) as raw:
        offset = 0
        if start:
            raw.seek(start - 1)
        lines = _lines(raw)
        if start:
            offset = start - 1 + len(next(lines, b""))
        begun, parts = start == 0, []
        for line in lines:
            last = offset >= end  # a line of the next range: up to its first mark
            offset += len(line)
            text = line.decode("utf-8", "replace").split("#", 1)[0]
            at = 0
            for m in _MARK.finditer(text):
                if begun:
                    yield " ".join(" ".join([*parts, text[at : m.start()]]).split()), m[0]
                begun, parts, at = True, [], m.end()
                if last:
                    return
            parts.append(text[at:])


def _lines(raw, chunk: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while data := raw.read(chunk):
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            yield line + b"\n"
    if rest:
        yield rest


class BlockReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        system, name = _opened(self.path)
        info = system.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(name)) if f.is_file and f.base_name[:1] not in "._"]
        head = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        return [Range(head + f.path, k, min(k + self.size, f.size)) for f in sorted(files, key=lambda f: f.path) for k in range(0, f.size, self.size)]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # no file, or none but empty ones
            return
        inside, sets, pos = None, 0, 0
        for k, (text, mark) in enumerate(statements(partition.path, partition.start, partition.end)):
            if mark == "{":
                m = re.search(r"(\w+)\s*=$", text)
                name = m[1] if m else ""
                inside, pos = name, 0
                sets += name in ("O", "L")
                yield partition.path, partition.start, k, "open", name, inside, sets, 0
            else:
                if text:
                    yield partition.path, partition.start, k, "row", text, inside, sets, pos
                    pos += 1
                if mark == "}":
                    inside, pos = "", 0
                    yield partition.path, partition.start, k, "close", "", "", sets, 0


class BlockSource(DataSource):
    """Options: ``path`` of a file or folder, ``rangebytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, start long, k long, kind string, text string, inside string, sets int, pos long"

    def reader(self, schema: object) -> BlockReader:
        return BlockReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


def _placed(events: DataFrame) -> DataFrame:
    """Statements with the block they stand in, also where an earlier range opened it: ``file, set_id, pos, text, inside``."""
    by_range = events.groupBy("file", "start").agg(
        F.max("sets").alias("opened"),
        F.max_by("inside", F.when(F.col("kind") != "row", F.col("k"))).alias("left"),
        F.count_if((F.col("kind") == "row") & F.col("inside").isNull()).alias("head"),
        F.max(F.when(F.col("kind") != "row", F.col("k"))).alias("turn"),
    )
    tails = events.where("kind = 'row' and inside is not null").groupBy("file", "start").agg(F.max_by(F.struct("inside", "pos", "k"), "k").alias("tail"))
    w = Window.partitionBy("file").orderBy("start")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    s = by_range.join(tails, ["file", "start"], "left")
    after = F.when(F.coalesce(F.col("tail.k") > F.col("turn"), F.lit(False)), F.col("tail.pos") + 1).otherwise(0)  # rows behind the last mark of a block
    s = s.withColumn("sum", F.sum("head").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("mark", F.when(F.col("turn").isNotNull(), after - F.col("sum")))
    carried = s.select(
        F.col("file").alias("f"), F.col("start").alias("s"),
        F.coalesce(F.sum("opened").over(earlier), F.lit(0)).alias("before"),
        F.last("left", ignorenulls=True).over(earlier).alias("within"),
        (F.coalesce(F.last("mark", ignorenulls=True).over(earlier), F.lit(0)) + F.col("sum") - F.col("head")).alias("passed"),
    )
    rows = events.where("kind = 'row'").join(carried, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))
    unknown = F.col("inside").isNull()
    return rows.select("file", (F.col("before") + F.col("sets") - 1).cast("int").alias("set_id"), F.when(unknown, F.col("passed") + F.col("pos")).otherwise(F.col("pos")).cast("int").alias("pos"), "text", F.when(unknown, F.col("within")).otherwise(F.col("inside")).alias("inside"))


def _head(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")).cast("double")


def read_blocks(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Block text sets, ``SEQ = {...}`` of whole numbers or ``SEQD = {...}`` of reals: ``set_id, pos, obs`` (reals), ``label, id, weight``.

    ``path`` is a file or a folder of files, by a local path or an address that Arrow's file systems know. Each row of ``O = {...}`` may
    start with ``<label>``, ``(id)`` and ``|weight|``; ``L = {seq_len = n; symb = m;}`` stands for all words of n symbols 0 to
    m - 1 in lexicographic order. ``set_id`` counts the blocks of a file, ``pos`` the rows of a block. ``#`` starts a remark. A task reads
    about ``range_bytes`` of a file, and more only where one line is longer. Empty files have no rows.
    """
    spark.dataSource.register(BlockSource)
    rows = _placed(spark.read.format(NAME).option("path", path).option("rangebytes", range_bytes).load())
    words = F.split(F.regexp_replace("text", r"<[^>]*>|\([^)]*\)|\|[^|]*\|", " "), r"[\s,]+")
    values = F.transform(F.filter(words, lambda x: x != ""), lambda x: x.cast("double"))
    listed = rows.where("inside = 'O'").select("set_id", "pos", values.alias("obs"), _head(r"<\s*([^>]*?)\s*>").alias("label"), _head(r"\(\s*([^)]*?)\s*\)").alias("id"), F.coalesce(_head(r"\|\s*([^|]*?)\s*\|"), F.lit(1.0)).alias("weight"))
    sizes = rows.where("inside = 'L'").groupBy("file", "set_id").agg(*[F.max(F.regexp_extract("text", rf"^{name}\s*=\s*(\d+)", 1).try_cast("int")).alias(name) for name in ("seq_len", "symb")])
    every = sizes.where("seq_len > 0 and symb > 0").select("set_id", "seq_len", "symb", F.explode(F.sequence(F.lit(0), F.pow("symb", "seq_len").cast("long") - 1)).alias("word"))
    digits = F.expr("transform(sequence(1, seq_len), k -> cast(word div cast(pow(symb, seq_len - k) as bigint) % symb as double))")
    none = F.lit(None).cast("double")
    return listed.unionByName(every.select("set_id", F.col("word").cast("int").alias("pos"), digits.alias("obs"), none.alias("label"), none.alias("id"), F.lit(1.0).alias("weight")))
