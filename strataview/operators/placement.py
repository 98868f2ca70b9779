"""Weighted rendezvous placement: owners, candidates, replicas, ring changes.

Rings are small by nature (members of a cluster); :func:`bounded_ring` counts
before broadcasting and leaves larger tables to a shuffled join. Placements
are ranked once per distinct placement, never per block row, by ``max_by``
(one partial aggregate, no sort) where only the owner is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import portable, portable_score

MOST_MEMBERS = 10_000


def bounded_ring(ring: DataFrame) -> DataFrame:
    return F.broadcast(ring) if ring.limit(MOST_MEMBERS + 1).count() <= MOST_MEMBERS else ring


def name_of(key: Column, chunk: Column, node: Column) -> Column:
    return F.concat(key, F.lit("#"), F.coalesce(chunk, F.lit(-1)).cast("string"), F.lit("@"), node.cast("string"))


def scored(places: DataFrame, ring: DataFrame, uniform: bool = False) -> DataFrame:
    """Every placement with every member and its score; a uniform ring compares
    draws alone and needs no logarithm."""
    text = name_of(F.col("key"), F.col("chunk"), F.col("node_id"))
    return places.crossJoin(bounded_ring(ring)).withColumn("score", portable(text) if uniform else portable_score(text, F.col("weight")))


def owners(places: DataFrame, ring: DataFrame, uniform: bool = False) -> DataFrame:
    """``key, chunk, node_id`` of the owner: highest score, ties to the larger id."""
    best = F.max_by("node_id", F.struct("score", "node_id")).alias("node_id")
    return scored(places, ring, uniform).groupBy("key", "chunk").agg(best)


INLINE_MEMBERS = 32


def with_owner(rows: DataFrame, ring: DataFrame, uniform: bool = False) -> DataFrame:
    """``rows`` (with key and chunk) and their ``node_id``. A ring of few
    members becomes one expression a row, without a shuffle; for a larger one
    distinct placements are ranked once and joined back."""
    members = ring.select("node_id", "weight").limit(INLINE_MEMBERS + 1).collect()
    if len(members) <= INLINE_MEMBERS:
        if not members:
            return rows.withColumn("node_id", F.lit(None).cast("long"))
        text = lambda m: name_of(F.col("key"), F.col("chunk"), F.lit(m["node_id"]))
        score = lambda m: portable(text(m)) if uniform else portable_score(text(m), F.lit(m["weight"]))
        best = F.array_max(F.array(*[F.struct(score(m).alias("score"), F.lit(m["node_id"]).cast("long").alias("node_id")) for m in members]))
        return rows.withColumn("node_id", best["node_id"])
    o = owners(rows.select("key", "chunk").distinct(), ring, uniform)
    o = o.select(F.col("key").alias("__k"), F.col("chunk").alias("__c"), "node_id")
    return rows.join(o, (F.col("key") == F.col("__k")) & F.col("chunk").eqNullSafe(F.col("__c"))).drop("__k", "__c")


def candidates(places: DataFrame, ring: DataFrame, uniform: bool = False) -> DataFrame:
    """All members in order of preference, ``rank`` from 1."""
    w = Window.partitionBy("key", "chunk").orderBy(F.desc("score"), F.desc("node_id"))
    return scored(places, ring, uniform).withColumn("rank", F.row_number().over(w)).drop("score")


def moves(places: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Placements whose owner differs between two rings."""
    a = owners(places, before).withColumnRenamed("node_id", "old_node")
    b = owners(places, after).withColumnRenamed("node_id", "new_node")
    same = a["key"].eqNullSafe(b["key"]) & a["chunk"].eqNullSafe(b["chunk"])
    return a.join(b, same).select(a["key"], a["chunk"], "old_node", "new_node").filter("old_node <> new_node")


def replicas(places: DataFrame, ring: DataFrame, k: int) -> DataFrame:
    """The ``k`` members after the owner."""
    return candidates(places, ring).filter(F.col("rank").between(2, k + 1))


def best_healthy(ranked: DataFrame, avoided: DataFrame) -> DataFrame:
    """The first candidate that is not avoided, or the first of all."""
    a = bounded_ring(avoided.select("node_id").distinct().withColumn("avoided", F.lit(1)))
    r = ranked.join(a, "node_id", "left").withColumn("avoided", F.coalesce("avoided", F.lit(0)))
    return r.groupBy("key", "chunk").agg(F.min_by("node_id", F.struct("avoided", "rank")).alias("node_id"))
