"""Workload generation as column arithmetic over ``spark.range``."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import portable


def scatter_multiplier(count: int) -> int:
    """An odd multiplier near the golden ratio that shares no factor with ``count``."""
    m = 0x9E3779B97F4A7C15 % max(count, 1) | 1
    while count > 1 and gcd(m, count) != 1:
        m += 2
    return m


def scatter(rank: Column, count: int) -> Column:
    """Spread ranks over keys so that popular ones are not neighbours."""
    return (rank.cast("decimal(38,0)") * F.lit(scatter_multiplier(count)).cast("decimal(20,0)") % F.lit(count)).cast("long")


def sequential_key(next_: Column, window: int, passes: int, host: int, hosts: int, keys: int) -> Column:
    """A host's share of keys, strided, read in windows of ``window`` keys ``passes`` times each."""
    share = -(-max(keys - host, 0) // hosts)
    if not share:
        return F.lit(host % keys).cast("long")
    within = next_ % (share * passes)
    start = F.floor(within / (window * passes)) * window
    length = F.least(F.lit(window), F.lit(share) - start)
    return ((start + (within - start * passes) % length) * hosts + host).cast("long")


def weighted_pick(unit: Column, weights: list[float]) -> Column:
    """Index of the first cumulative weight above ``unit`` times the sum."""
    total, at, out = sum(weights), 0.0, None
    for i, w in enumerate(weights[:-1]):
        at += w
        c = unit * total < at
        out = F.when(c, i) if out is None else out.when(c, i)
    return F.lit(0) if out is None else out.otherwise(len(weights) - 1)


def open_loop_latency(due: Column, sent: Column, first_byte: Column) -> Column:
    """Latency from when a request was due, so a slow answer also counts against those it held up."""
    return F.greatest(F.lit(0), sent - due) + first_byte


def random_requests(rows: DataFrame, index: str, keys: int, span: int) -> DataFrame:
    """Seeded requests from row numbers: each field is drawn from its own hash,
    so any part of the sequence can be made alone. A sixth each of valid,
    open, suffix and invalid ranges; conditions are current in a tenth, stale
    in a twentieth; 15 % are HEAD."""
    draw = lambda field, below: portable(F.concat(F.col(index), F.lit(field))) % below
    k, a, b = draw("range", 6), draw("a", span), draw("b", span)
    text = lambda first, last: F.concat(F.lit("bytes="), first, F.lit("-"), last)
    none = F.lit("")
    ranges = F.when(k == 0, text(a, a + b)).when(k == 1, text(a, none)).when(k == 2, text(none, a + 1)).when(k == 5, text(a + 1 + b, a))
    tag = lambda field: F.when(draw(field, 20) < 2, "current").when(draw(field, 20) == 2, "stale")
    return rows.select(index, draw("key", keys).alias("key"), F.when(draw("method", 100) < 15, "HEAD").otherwise("GET").alias("method"), ranges.alias("range"), tag("if").alias("if_match"), tag("ifn").alias("if_none_match"))
