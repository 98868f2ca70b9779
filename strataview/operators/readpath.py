"""The read path beyond ranges: headers, read-ahead, owner groups, fills, invalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Headers of an object that its answers carry.
OBJECT_HEADERS = [
    "cache-control",
    "content-disposition",
    "content-encoding",
    "content-language",
    "content-type",
    "expires",
    "last-modified",
    "x-amz-object-lock-legal-hold",
    "x-amz-object-lock-mode",
    "x-amz-object-lock-retain-until-date",
    "x-amz-replication-status",
    "x-amz-restore",
    "x-amz-server-side-encryption",
    "x-amz-server-side-encryption-aws-kms-key-id",
    "x-amz-server-side-encryption-bucket-key-enabled",
    "x-amz-storage-class",
    "x-amz-tagging-count",
    "x-amz-version-id",
    "x-amz-website-redirect-location",
]


def kept_headers(headers: Column, status: Column, checksums: Column, overrides: Column) -> Column:
    """Headers an answer shows: the object's own, checksums only of a whole
    object and if asked, and on success the request's overrides in place of
    headers of their names. Arrays of ``struct<name,value>``; order and
    repeats stay."""
    name = lambda h: F.lower(h["name"])
    sums = lambda h: name(h).startswith("x-amz-checksum-")
    own = F.filter(headers, lambda h: name(h).startswith("x-amz-meta-") | sums(h) | F.array_contains(F.array(*map(F.lit, OBJECT_HEADERS)), name(h)))
    shown = F.when(checksums & (status == 200), own).otherwise(F.filter(own, lambda h: ~sums(h)))
    rest = F.filter(shown, lambda h: ~F.exists(overrides, lambda o: F.lower(o["name"]) == name(h)))
    return F.when(status.between(200, 299), F.concat(rest, overrides)).otherwise(shown)


def read_ahead(runs: DataFrame, by: list[str], order: str, length: str, window: int) -> DataFrame:
    """Runs asked for at once: in order while their sum stays within the
    window, and the first in any case."""
    w = Window.partitionBy(*by).orderBy(order)
    total = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("asked", (F.row_number().over(w) == 1) | (total <= window))


def owner_groups(runs: DataFrame, by: list[str], most: int) -> DataFrame:
    """Adjacent runs of one node merged while their sum is at most ``most``:
    a fold over each request's runs, which its object's size bounds.
    ``runs``: ``by``, ``lo``, ``node``, ``len``."""
    none = F.expr("cast(array() as array<struct<node:bigint,lo:bigint,runs:int,bytes:bigint>>)")

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        merged = F.struct(r["node"].alias("node"), last["lo"].alias("lo"), (last["runs"] + 1).alias("runs"), (last["bytes"] + r["len"]).alias("bytes"))
        fresh = F.struct(r["node"].alias("node"), r["lo"].alias("lo"), F.lit(1).alias("runs"), r["len"].alias("bytes"))
        joins = (F.size(acc) > 0) & (last["node"] == r["node"]) & (last["bytes"] + r["len"] <= most)
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(fresh)))

    rs = F.array_sort(F.collect_list(F.struct(F.col("lo").cast("long").alias("lo"), F.col("node").cast("long").alias("node"), F.col("len").cast("long").alias("len"))))
    folded = runs.groupBy(*by).agg(rs.alias("rs")).withColumn("g", F.aggregate("rs", none, step))
    return folded.select(*by, F.posexplode("g").alias("part", "g")).select(*by, "part", "g.*")


def fill_runs(missing: DataFrame, by: list[str], chunk_blocks: int) -> DataFrame:
    """Runs of missing blocks of one placement, at most a chunk each."""
    w = Window.partitionBy(*by).orderBy("block_index")
    c = F.coalesce("chunk", F.lit(-1))
    new = ~(F.coalesce((F.lag("block_index").over(w) == F.col("block_index") - 1) & (F.lag(c).over(w) == c), F.lit(False)))
    m = missing.withColumn("__i", F.sum(new.cast("int")).over(w))
    k = F.floor((F.row_number().over(Window.partitionBy(*by, "__i").orderBy("block_index")) - 1) / chunk_blocks)
    return m.withColumn("__k", k).groupBy(*by, "__i", "__k").agg(F.min("block_index").alias("lo"), F.count(F.lit(1)).alias("blocks")).drop("__i", "__k")


def round_robin(reads: DataFrame, by: list[str], order: list[str], nodes: int) -> DataFrame:
    """Reads of a hot placement dealt to its nodes in turn."""
    return reads.withColumn("turn", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) % nodes)


def last_write_before(lines: DataFrame, by: list[str]) -> Column:
    """Time of the last write of a key strictly before each row of a time line
    with ``ts_ms`` and ``method``."""
    w = Window.partitionBy(*by).orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -1)
    return F.max(F.when(F.col("method") == "PUT", F.col("ts_ms"))).over(w)


def text_blocks(docs: DataFrame, text: str, size: int) -> DataFrame:
    """One row per block of ``size`` units of each text (``block_index``,
    ``block``; the last may be shorter), in one pass over it; empty and null
    texts have none."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(blocks).alias("block_index", "block"))
