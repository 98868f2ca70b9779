"""Contract queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import byte_cnn, class_model, decontaminate, jaccard_join, license_scan, oracles, packing, quality_rules, suffix_dedup, token_counts, toxicity
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model.score_texts(table(spark, sf_dir, "documents"), parts=10, held_out=0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.filter_quality(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"), k=4, pct=85).select("doc_id", "n_shingles", "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_and_report(table(spark, sf_dir, "documents"), length=400, passage=250, words=51))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can state."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def ngram_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL can state."""
    return op2_class_ngrams(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_class_ngrams": op2_class_ngrams,
    "op3_decontamination": op3_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "pipeline": corpus_pipeline.run,
    "license_base": license_base,
    "ngram_base": ngram_base,
}

ORACLES: dict[str, str] = {
    "op4_quality_rules": quality_rules.oracle(),
    "op5_jaccard_join": oracles.jaccard_components(),
    "op10_suffix_dedup": oracles.repeated_bytes(),
    "license_base": oracles.license_base(),
    "ngram_base": oracles.ngram_base(),
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
