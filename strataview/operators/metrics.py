"""Metric analytics: histograms, percentiles, counters, scrapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.units import fixed_bucket, loglinear_bucket, loglinear_highest


def fixed_histogram(df: DataFrame, by: list[str], seconds: Column) -> DataFrame:
    """Counts of each bucket, and the cumulative counts a scrape exposes."""
    counts = df.groupBy(*by, fixed_bucket(seconds).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("cumulative", F.sum("n").over(w))


def loglinear_histogram(df: DataFrame, by: list[str], value: Column, bits: int) -> DataFrame:
    """Sparse histogram rows (``bucket, n``) and the largest value; mergeable by sum and max."""
    return df.groupBy(*by, loglinear_bucket(value, bits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("max_value"))


def merge_histograms(h: DataFrame, by: list[str]) -> DataFrame:
    return h.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.max("max_value").alias("max_value"))


def percentiles(h: DataFrame, by: list[str], shares: list[float], bits: int) -> DataFrame:
    """Value of rank ceil(share * n): its bucket's highest value, never above the largest."""
    every = Window.partitionBy(*by)
    run = every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    c = h.withColumn("seen", F.sum("n").over(run)).withColumn("total", F.sum("n").over(every)).withColumn("top", F.max("max_value").over(every))
    s = F.explode(F.array(*[F.struct(F.lit(x).alias("share")) for x in shares]))
    c = c.withColumn("s", s).withColumn("share", F.col("s.share"))
    rank = F.least(F.greatest(F.ceil(F.col("share") * F.col("total")), F.lit(1)), F.col("total"))
    hit = c.filter(F.col("seen") >= rank).groupBy(*by, "share").agg(F.min("bucket").alias("bucket"), F.first("top").alias("top"))
    return hit.select(*by, "share", F.least(loglinear_highest(F.col("bucket"), bits), F.col("top")).alias("percentile"))


def exact_quantile(df: DataFrame, by: list[str], value: str, share: float, bits: int = 7) -> DataFrame:
    """Element floor(n * share) of the sorted values (the last, at most), which
    are whole numbers from 0 on. A histogram finds the bucket that holds it and
    how many lie before; only that bucket's distinct values are then put in
    order. Both passes are partial aggregates, and no group meets in one task."""
    h = loglinear_histogram(df, by, F.col(value), bits)
    every = Window.partitionBy(*by)
    h = h.withColumn("__seen", F.sum("n").over(every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("n").over(every))
    at = F.least(F.floor(F.col("__n") * share), F.col("__n") - 1)
    place = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)])  # nulls are groups too: compared as one value
    target = h.filter((F.col("__seen") > at) & (F.col("__seen") - F.col("n") <= at)).select(place.alias("__t"), F.col("bucket").alias("__tb"), (at - (F.col("__seen") - F.col("n"))).alias("__at"))
    rows = df.select(*by, F.col(value).alias("__v"), place.alias("__k"), loglinear_bucket(F.col(value), bits).alias("__b"))
    inside = rows.join(target, F.col("__k").eqNullSafe(F.col("__t")) & (F.col("__b") == F.col("__tb")))
    counts = inside.groupBy(*by, "__at", "__v").agg(F.count(F.lit(1)).alias("__c"))
    seen = F.sum("__c").over(every.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("__seen", seen).filter(F.col("__seen") > F.col("__at")).groupBy(*by).agg(F.min("__v").alias("quantile"))


def counter_growth(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Growth between two scrapes: ``moment`` before/after, ``started``. A
    process that restarted counts from zero; one that is gone counts nothing."""
    before = samples.filter("moment = 'before'").select(*keys, F.col("started").alias("b_started"), F.col("value").alias("b_value"))
    after = samples.filter("moment = 'after'").select(*keys, "started", "value")
    j = after.join(before, keys, "left")
    return j.select(*keys, (F.col("value") - F.when(F.col("b_started") == F.col("started"), F.col("b_value")).otherwise(0)).alias("growth"))


def parse_exposition(lines: Column) -> Column:
    """``struct<name, labels, value>`` of one exposition line; null for comments and junk."""
    series = F.regexp_extract(lines, r"^(.*) [^ ]*$", 1)
    value = F.regexp_extract(lines, r"^.* ([^ ]*)$", 1).try_cast("double")
    name = F.substring_index(series, "{", 1)
    inner = F.regexp_replace(F.when(series.contains("{"), F.substring(series, F.length(name) + 2, F.length(series))).otherwise(""), r"\}+$", "")
    pairs = F.filter(F.split(inner, ","), lambda p: p.contains("="))
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(F.substring(p, F.instr(p, "=") + 1, F.length(p)), '^"+|"+$', "").alias("value"))))
    ok = ~lines.startswith("#") & (F.trim(lines) != "") & value.isNotNull()
    return F.when(ok, F.struct(name.alias("name"), labels.alias("labels"), value.alias("value")))


def labelled_sum(samples: DataFrame, name: str, labels: dict[str, str]) -> DataFrame:
    """Sum of samples of a name whose labels match; a value ending in * is a prefix."""
    test = F.col("name") == name
    for k, v in labels.items():
        found = F.col("labels")[k]
        test &= found.startswith(v[:-1]) if v.endswith("*") else (found == v)
    return samples.filter(test).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


def render_exposition(samples: DataFrame) -> DataFrame:
    """Lines of exposition text from name, label text and value."""
    return samples.select(F.concat("name", F.when(F.col("label_text") == "", "").otherwise(F.concat(F.lit("{"), "label_text", F.lit("}"))), F.lit(" "), F.col("value").cast("string")).alias("line"))
