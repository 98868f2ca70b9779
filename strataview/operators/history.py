"""History: versions, as-of lookups, change logs, rings and purges over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(probes: DataFrame, states: DataFrame, key: str, at: str, since: str, value: str, tie: str) -> DataFrame:
    """The last state at or before each probe, by one sort per key: both sides
    are laid in one time line and the value is carried forward. Hot keys sort
    in one partition each; no pairs are formed. ``tie`` orders states of one time."""
    null = lambda of: F.lit(None).cast(of)
    s = states.select(key, F.col(since).alias("__t"), F.lit(0).alias("__probe"), F.col(tie).alias("__o"), F.struct(F.col(since).alias("since"), F.col(value).alias("v")).alias("__s"))
    p = probes.select(key, F.col(at).alias("__t"), F.lit(1).alias("__probe"), null(s.schema["__o"].dataType).alias("__o"), null(s.schema["__s"].dataType).alias("__s"), F.struct(*probes.columns).alias("__row"))
    s = s.withColumn("__row", null(p.schema["__row"].dataType))
    w = Window.partitionBy(key).orderBy("__t", "__probe", "__o").rowsBetween(Window.unboundedPreceding, 0)
    line = p.unionByName(s).withColumn("__last", F.last("__s", ignorenulls=True).over(w)).filter("__probe = 1")
    return line.select("__row.*", F.col("__last.since").alias("state_since"), F.col("__last.v").alias("state_value"))


def held_during(probes: DataFrame, states: DataFrame, key: str, at: str, span: int, since: str, until: str, value: str) -> DataFrame:
    """``probes`` with ``states``, how many states held at some time of
    [at, at + span], and ``live``, how many of those have a value. ``until`` is
    null or not before ``since``, so these are the states begun by the end of
    the interval less those over by its start: two running sums in one sort per
    key, and no pairs are formed. Probes without key or time are left out."""
    live = F.col(value).isNotNull().cast("int")
    none = F.lit(0)
    known = states.filter(F.col(since).isNotNull())
    mark = lambda t, begun, over, some: some.select(key, F.col(t).alias("__t"), begun.alias("__begun"), (begun * live).alias("__begun_live"), over.alias("__over"), (over * live).alias("__over_live"))
    line = mark(since, F.lit(1), none, known).unionByName(mark(until, none, F.lit(1), known.filter(F.col(until).isNotNull())))
    line = line.withColumn("__row", F.lit(None).cast(probes.select(F.struct(*probes.columns).alias("r")).schema["r"].dataType))
    p = probes.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    p = p.select(key, F.col(at).alias("__t"), *[none.alias(c) for c in line.columns[2:-1]], F.struct(*probes.columns).alias("__row"))
    w = Window.partitionBy(key).orderBy("__t")
    ahead, by_now = w.rangeBetween(Window.unboundedPreceding, span), w.rangeBetween(Window.unboundedPreceding, 0)
    held = lambda kind: F.sum(f"__begun{kind}").over(ahead) - F.sum(f"__over{kind}").over(by_now)
    return line.unionByName(p).select("__row", held("").alias("states"), held("_live").alias("live")).filter("__row is not null").select("__row.*", "states", "live")


def latest(log: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last entry of each key in a change log, by a partial aggregate."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__e")).select(*keys, "__e.*")


def intervals(events: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """Each event with the time of the next one of its key (null: still valid)."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))


def islands(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping [start, end] intervals of a key merged, with the number in each."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    numbered = rows.withColumn("__new", new).withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__i").agg(F.min(start).alias("flight_start"), F.max(end).alias("flight_end"), F.count(F.lit(1)).alias("members")).drop("__i")
