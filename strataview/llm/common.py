"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, the separator of the word contracts.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches(spark: SparkSession, rows: int, size: int):
    """While this holds, Python gets Arrow batches of at most ``rows`` rows and
    about ``size`` bytes, so that a worker's memory is bounded."""
    before = {k: spark.conf.get(k, None) for k in (ROWS, BYTES)}
    spark.conf.set(ROWS, rows)
    spark.conf.set(BYTES, size)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, batch_rows: int = 1000, batch_bytes: int = 8 << 20) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet in the shared folder and read it back: the
    lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = folder(spark, name)
    schema = df.schema
    with batches(spark, batch_rows, batch_bytes):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by :func:`written` that nothing will read again."""
    for p in paths:
        jp = spark._jvm.org.apache.hadoop.fs.Path(p)
        jp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jp, True)


def release() -> None:
    """Give memory that a finished task has freed back to the system: workers
    are used again for other work, and would hold each task's peak."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows (counted, not guessed)."""
    return df.limit(most_rows + 1).count() <= most_rows


def semi_by(df: DataFrame, keys: DataFrame, on: str, most_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys``. ``keys`` is broadcast only if
    its counted size is within the bound; beyond it both sides are shuffled."""
    keys = keys.select(on).distinct()
    return df.join(F.broadcast(keys) if small_enough(keys, most_rows) else keys, on, "left_semi")


#: Rows of one key from which on a join does not shuffle them to one task.
HOT_ROWS = 500_000


def join_counted(left: DataFrame, keys: DataFrame, on: list[str], count: str, how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """``left`` joined with ``keys``, one row a key with the ``count`` of its
    rows in ``left``. Keys of more than ``hot_rows`` rows are joined by
    broadcast, where their rows lie: there are at most ``rows / hot_rows`` of
    them, and that they are few is counted. All others are shuffled."""
    hot_rows = hot_rows or HOT_ROWS
    hot = keys.filter(F.col(count) > hot_rows)
    if not hot.limit(1).count() or not small_enough(hot, 100_000):
        return left.join(keys, on, how)
    few = F.broadcast(hot.select(*on))
    cold = left.join(few, on, "left_anti").join(keys.filter(F.col(count) <= hot_rows), on, how)
    return cold.unionByName(left.join(F.broadcast(hot), on).select(*cold.columns))
