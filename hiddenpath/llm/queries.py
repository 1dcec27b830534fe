"""One query per operator over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiddenpath.llm import decontamination, filter_audit, html_extract, lang_id, license_scan, near_dedup, packing, quality, secret_scan, set_join, suffix_dedup, toxicity, whitening
from hiddenpath.llm.common import table
from hiddenpath.llm.oracles import ORACLE_SQL  # noqa: F401

TOKENIZER = "word_bpe_49k.json"


def fold(of: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``of``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_cross_parsing_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from the three quarters whose fold is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(fold(4) != 2).select("doc_id", "text", "lang"))
    return lang_id.identify_languages(docs, model).select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), size=2048, ids=False).drop("ids")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base figures and the verdict of every document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.apply_quality_rules(docs).select("doc_id", *[f"quality.{x}" for x in names])


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict."""
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("row.doc_id", F.explode("findings").alias("x")).select("doc_id", "x.*")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word windows of benchmark items."""
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).drop("spans", "text_hash")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of every document that may be a licence notice, with its family."""
    return license_scan.scan_licences(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents of Jaccard similarity 0.8 or more on four-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without strings of 50 bytes that a smaller doc_id has."""
    return suffix_dedup.repeated_substrings(table(spark, sf_dir, "documents"), length=50, texts=False).drop("kept_bytes")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of the four fifths whose fold is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return toxicity.score_toxicity(docs, model).select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders over all documents, by source and step."""
    return filter_audit.audit_filters(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 leading whitened components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=16)


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents of Jaccard similarity 0.85 or more on four-word shingles."""
    return set_join.jaccard_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_cross_parsing_language_id, op2_best_fit_packing, op3_quality_rules, op4_html_extraction, op5_secret_scans, op6_benchmark_decontamination, op7_license_scans, op8_minhash_near_dedup, op9_suffix_array_dedup, op10_toxicity, op11_filter_interaction_audit, op12_embedding_whitening, op13_ngram_jaccard_join)
}
