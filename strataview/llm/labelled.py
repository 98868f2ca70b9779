"""Bounded, reproducible samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def training_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``rows`` labelled texts outside the held-out fold: ``text, label,
    spot`` (``spot``: a hash in [0, 1000) that splits the sample).

    Labels that are null, or whose id is null, are not used; of several labels
    of one id the smallest counts, and of several texts of one id the least
    (null before all), so the bound holds for rows however often an id repeats.
    The chosen ids are broadcast: there are no more than ``rows`` of them.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label")).filter("__id is not null and __label is not null")
    known = known.filter(fold(F.col("__id"), parts) != held_out).groupBy("__id").agg(F.min("__label").alias("__label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    d = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    one = d.join(F.broadcast(chosen), "__id").groupBy("__id", "__label").agg(F.min(F.struct("text"))["text"].alias("text"))
    return one.select("text", F.col("__label").alias("label"), F.pmod(F.xxhash64(F.lit("spot"), "__id"), F.lit(1000)).cast("int").alias("spot"))
