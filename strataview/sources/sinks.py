"""Sinks: states of objects that writes pass through, and CSV reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_states(writes: DataFrame, path: str, batch: int) -> None:
    """Append a batch of passed writes to the table of states. A batch owns its
    folder, so that one that is tried again replaces itself."""
    writes.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def pass_writes(requests: DataFrame, path: str, checkpoint: str):
    """A stream of requests: those that change objects are passed on and appended, each batch once."""
    changes = requests.filter(F.col("method").isin("PUT", "DELETE", "POST"))
    return changes.writeStream.foreachBatch(lambda df, epoch: append_states(df, path, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
