"""Recovery: what a restarted node makes of its slot records and logs, and
what it does with blocks it cannot trust yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .history import latest


def restored(records: DataFrame, block: list[str], slot: str, most: int) -> DataFrame:
    """Records with ``restored``: sound ones (``valid``) of at most ``most``
    bytes, the first slot of each block; and ``verify``: a restored record not
    ``trusted``, whose checksum the first hit must check. All others are cleared.
    One partial aggregate finds the first slots; nothing is sorted."""
    sound = F.col("valid") & F.col("len").between(1, most)
    first = records.filter(sound).groupBy(*block).agg(F.min(slot).alias("__first"))
    j = records.join(first, block, "left").withColumn("restored", F.coalesce(sound & (F.col(slot) == F.col("__first")), F.lit(False)))
    return j.withColumn("verify", F.col("restored") & ~F.col("trusted")).drop("__first")


def replayed(log: DataFrame, keys: list[str], order: list[str], columns: list[str], synced: Column) -> DataFrame:
    """The state a log gives after a crash: the last entry of each key among
    those that were durable (``synced``)."""
    return latest(log.filter(synced), keys, order, columns)


def open_purges(log: DataFrame, keys: list[str], order: list[str], nodes: str) -> DataFrame:
    """Purges still waiting: the last record of each holds the nodes it waits on; none means done."""
    return latest(log, keys, order, [nodes]).filter(F.size(nodes) > 0)


def hits(reads: DataFrame, index: DataFrame, block: list[str], order: list[str]) -> DataFrame:
    """Outcome of each read of a block against the restored ``index`` (``block``,
    ``verify``, ``intact``): the first hit of an untrusted block checks it
    (``verified``, or ``corrupt``: it is dropped, a miss); reads after that are
    hits, or misses of a block that is gone."""
    w = Window.partitionBy(*block).orderBy(*order)
    j = reads.join(index.select(*block, "verify", "intact"), block, "left").withColumn("__n", F.row_number().over(w))
    out = F.when(F.col("verify").isNull(), "miss").when(~F.col("verify"), "hit").when(F.col("__n") == 1, F.when(F.col("intact"), "verified").otherwise("corrupt")).when(F.col("intact"), "hit").otherwise("miss")
    return j.select(*reads.columns, out.alias("outcome"))


def found_in_store(state: Column, readable: Column, in_flight: Column, unwritten: Column) -> Column:
    """What serves a block: its slot if it is ready, or filling, not fetched
    any more and not of a failed write (awaiting the write unless readable);
    else a fetch under way is joined; else it is fetched."""
    filling = (state == "filling") & ~in_flight & ~unwritten
    return F.when(state == "ready", "slot").when(filling, F.when(readable, "slot").otherwise("await")).when(in_flight, "join").otherwise("miss")


def fill_source(moved: Column, held: Column, valid: Column, remembered: Column) -> Column:
    """Where an owner gets a block it lacks: of the owner before it, if that
    holds it; a copy that fails its check is fetched again from the origin into
    the same slots, if it would be admitted (a peer's copy always is)."""
    again = F.when(remembered, "refill").otherwise("refill-unstored")
    return F.when(~moved, "origin").when(~held, "origin").when(valid, "peer").otherwise(again)


def matches(mode: Column, sent: Column, truth: Column, edge: int) -> Column:
    """Whether an answer checks out: ``full`` compares all, ``edges`` the first
    and last ``edge`` units of it, ``none`` nothing."""
    head = F.substring(sent, 1, edge) == F.substring(truth, 1, edge)
    tail = F.right(sent, F.lit(edge)) == F.right(truth, F.lit(edge))
    return F.when(mode == "full", sent == truth).when(mode == "edges", head & tail & (F.length(sent) == F.length(truth))).otherwise(F.lit(True))
