"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``docs``.

Stages 2 and 4 decide by row, whatever its id; rows without an id come last.
Repeated rows of one id and text are one document, of which stage 2 keeps one.
Null and empty texts are scored by stage 1 like any other; what it keeps of
them links with nothing, holds no passage and no benchmark item, and is packed
as an end token. Very long texts are read whole by every stage. Extra columns
are carried along, whatever their names. An empty table passes through as an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataview.llm import byte_cnn, decontaminate, jaccard_join, packing, suffix_dedup
from strataview.llm.common import small_enough, table, written
from strataview.llm.suffix_dedup import KEY

#: Bytes of a passage that stage 3 removes from later documents: under 50 words of common length.
PASSAGE_BYTES = 250
#: Words of a passage that stage 3 removes however few bytes it has: over 50.
PASSAGE_WORDS = 51


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose KEY is not in ``keys`` (broadcast only if counted small)."""
    keys = keys.select(KEY).distinct()
    return keyed.join(F.broadcast(keys) if small_enough(keys, 1_000_000) else keys, KEY, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects. They are scored as
    the rejected keys are written, where Python's batches of texts are bounded;
    whoever reads the result starts no Python."""
    model = byte_cnn.train(docs, table(spark, sf_dir, "labels"))
    keyed = suffix_dedup.with_key(docs, "doc_id", "text")
    rejected, _ = written(keyed.filter(~(byte_cnn.quality_score(F.col("text"), model) >= 0.5)).select(KEY), "rejected", 250, 2 << 20)
    return _without(keyed, rejected).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five words, 0.8) keep the smallest id."""
    keyed = suffix_dedup.with_key(docs, "doc_id", "text")
    linked, _ = written(jaccard_join.link_documents(keyed, k=5, pct=80, id_col=KEY).select(F.col("doc_id").alias(KEY), "component_id"), "linked")
    kept = _without(keyed, linked.filter(F.col(KEY) != F.col("component_id")))
    known = docs.filter("doc_id is not null")
    if known.groupBy("doc_id").count().filter("count > 1").limit(1).count():  # equal texts of one id are one document, also those without words
        kept = kept.filter("doc_id is null").unionByName(kept.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document (or place) has; the first stays."""
    return suffix_dedup.cut_documents(docs, PASSAGE_BYTES, keep_first=True, words=PASSAGE_WORDS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    keyed = suffix_dedup.with_key(docs, "doc_id", "text")
    leaks, _ = written(decontaminate.find_leaks(keyed, table(spark, sf_dir, "benchmark"), id_col=KEY).select(F.col("doc_id").alias(KEY)), "leaks")
    return _without(keyed, leaks).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    return packing.pack(docs, capacity=1024, end_id=2)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packed", packed),
]

#: SQL cannot express a trained network, suffix arrays or a packing search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
