"""The corpus pipeline: quality rules, near-dedup, decontamination, secret masking, packing.

Each stage works on all that its predecessor kept, which is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiddenpath.llm import decontamination, near_dedup, packing, quality, secret_scan
from hiddenpath.llm.common import cut, table, use_shared_dir


def _new_name(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores added until ``docs`` has no such column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    found = quality.apply_quality_rules(docs)
    verdict = found.columns[-1]
    return found.where(F.col(f"`{verdict}`.kept")).drop(verdict)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 on five-word shingles: that of the smallest doc_id.

    Documents are rows, also where a doc_id repeats or is null; of rows with one doc_id and text, one stays. Rows are told
    by 64-bit fingerprints of both.
    """
    row = _new_name(docs, "row_print")
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = near_dedup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), width=5, percent=80)
    own = rows.groupBy(row).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    placed = cut(own.join(found.select(F.col("doc_id").alias(row), "component_id").distinct(), row))
    best = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", row)).alias("best"))
    stays = best.select(F.col(f"best.{row}").alias(row), F.lit(True).alias("stays"))
    # what is to be done with a row: few rows have an entry
    todo, n = placed.join(stays, row, "left").where("stays is null or n > 1").select(row, F.col("stays").isNull().alias("gone"), "n"), _new_name(docs, "n_rows")
    todo = todo.withColumnRenamed("n", n)
    gone = _new_name(docs, "is_gone")
    kept = rows.join(todo.withColumnRenamed("gone", gone), row, "left").where(f"{gone} is null or not {gone}")
    return kept.where(f"{n} is null").unionByName(kept.where(f"{n} is not null").dropDuplicates([row])).select(*[f"`{c}`" for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10).where("contaminated")
    text = _new_name(docs, "text_print")
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    rows = docs.withColumn(text, F.xxhash64("text"))
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows[text] == gone["gone_text"]), "left_anti").drop(text)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars counted again."""
    found = secret_scan.scan_secrets(docs)
    new = {"text": F.col("masked"), "n_chars": F.char_length("masked").cast("long")}
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: SQL has no tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage wrote is removed when the next one has written. The last is read by the result."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{use_shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _remove(spark, f"{folder}/{k - 1}")
    return docs
