"""Stateless forms of the stateful cache operators, as window queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def doorkeeper_exact(reads: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Second-read admission with an exact set (valid while the window never
    rotates): the first read of a block is refused, later ones pass."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return reads.withColumn("admitted", F.row_number().over(w) > 1)


def hot_windows(reads: DataFrame, keys: list[str], ts_ms: str, window_ms: int, threshold: int) -> DataFrame:
    """Placements read at least ``threshold`` times in a clock-aligned window."""
    start = (F.floor(F.col(ts_ms) / window_ms) * window_ms).cast("long")
    return reads.groupBy(*keys, start.alias("window_start")).agg(F.count(F.lit(1)).alias("reads")).filter(F.col("reads") >= threshold)


def home_fresh(ttl: Column, validated: Column, arrived: Column, stale: Column) -> Column:
    """Metadata at its home: immutable, or within its time to live (inclusive); a reported stale tag forces a check."""
    return F.coalesce(~stale, F.lit(True)) & (ttl.isNull() | (validated + ttl >= arrived))


def gateway_fresh(ttl: Column, gateway_ttl: Column, purge_window: Column, validated: Column, received: Column, arrived: Column) -> Column:
    return F.when(ttl.isNull(), received + purge_window >= arrived).otherwise((validated + ttl >= arrived) & (received + gateway_ttl >= arrived))


def lookup_class(age: Column, ttl: int, grace: int, failed: Column) -> Column:
    """Stale-while-revalidate: fresh, refresh (past half its life), grace (only after a failed lookup), expired."""
    return F.when(age <= ttl // 2, "fresh").when(age <= ttl, "refresh").when(failed & (age <= ttl + grace), "grace").otherwise("expired")


def signed_valid(now: Column, signed_at: Column, expires: Column, presigned: Column) -> Column:
    """Signed within 15 minutes; presigned: not before then, nor after expiry of 1 to 604800 seconds."""
    header = F.abs(now - signed_at) <= 900
    return F.when(presigned, expires.between(1, 604_800) & (now + 900 >= signed_at) & (now <= signed_at + expires)).otherwise(header)
