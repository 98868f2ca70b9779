"""Where files of jobs go: a folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session that runs on this machine alone
    may do without: it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        old = spark.sparkContext._jsc.sc().getCheckpointDir()
        if old.isDefined():
            found = old.get()
        elif not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            found = f"file://{tempfile.mkdtemp(prefix='strataview-')}"
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{root(spark)}/strataview/{name}-{uuid.uuid4().hex}"
