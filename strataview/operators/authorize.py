"""Grants: which requests a client's credentials cover.

A grant matches by client, by bucket or wildcard, and by key prefix. The join
is an equi-join on the client, so it shuffles on one key and never compares
all requests with all grants; prefix and level are its residual condition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covered(requests: DataFrame, grants: DataFrame, how: str) -> DataFrame:
    """``how``: left_semi for allowed requests, left_anti for denied ones.
    ``requests``: client, bucket, key, need (1 read, 2 write, 3 admin)."""
    r, g = requests.alias("r"), grants.alias("g")
    ok = (
        (F.col("r.client") == F.col("g.client"))
        & (F.col("g.bucket").isin("*") | (F.col("g.bucket") == F.col("r.bucket")))
        & (F.col("g.level") >= F.col("r.need"))
        & F.col("r.key").startswith(F.col("g.prefix"))
    )
    return r.join(g, ok, how)
