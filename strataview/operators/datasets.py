"""Generated datasets: keys, sizes and bytes from seeds; Zipf ranks.

Arithmetic is modulo 2^64, which SQL types lack, so these run in Arrow batches
over ``spark.range`` with numpy; nothing depends on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer (public domain constants)."""
    z = z.astype(U)
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def object_seeds(name: str, indexes: np.ndarray, seed: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(f"{name}/{i}".encode(), seed=seed) for i in indexes.tolist()], U)


def objects(spark: SparkSession, prefix: str, name: str, count: int, seed: int, low: int, high: int, extension: str = "") -> DataFrame:
    """``index, key, size, seed`` of a set whose sizes are log-uniform in [low, high]."""

    def make(index: pd.Series) -> pd.DataFrame:
        s = object_seeds(name, index.to_numpy(), seed)
        spread = mix(s) >> U(48)
        unit = (mix(s ^ U(0x5EED)) >> U(11)).astype(float) / float(1 << 53)
        size = np.clip(np.exp(np.log(low) + (np.log(high) - np.log(low)) * unit).astype(np.int64), low, high)
        keys = [f"{prefix}/{name}/{int(p):04x}/{int(i):09d}{extension}" for p, i in zip(spread, index, strict=True)]
        return pd.DataFrame({"key": keys, "size": size, "seed": s.view(np.int64)})

    made = F.pandas_udf(make, "key string, size long, seed long")
    return spark.range(count).select(F.col("id").alias("index"), made("id").alias("o")).select("index", "o.*")


def content(seed: int, offset: int, length: int) -> bytes:
    """An object's bytes from ``offset``: words ``mix(seed ^ i * phi)``, little-endian."""
    first, last = offset // 8, (offset + length + 7) // 8
    i = np.arange(first, last, dtype=U)
    words = mix(U(seed & (1 << 64) - 1) ^ (i * U(0x9E3779B97F4A7C15)))
    raw = words.astype("<u8").tobytes()
    return raw[offset - first * 8 : offset - first * 8 + length]


def zipf(units: np.ndarray, count: int, exponent: float) -> np.ndarray:
    """Ranks 1..count by rejection-inversion (Hörmann and Derflinger 1996), in
    constant memory. ``units``: rows of uniform numbers, one a try; a row whose
    tries are all rejected takes its last."""
    e = exponent

    def log_ratio(x):  # (exp(x) - 1) / x
        return np.where(np.abs(x) > 1e-8, np.expm1(x) / np.where(x == 0, 1, x), 1 + x / 2)

    def integral(x):
        return log_ratio((1 - e) * np.log(x)) * np.log(x)

    def inverse(y):
        t = np.maximum(y * (1 - e), -1.0)
        return np.exp(np.where(np.abs(t) > 1e-8, np.log1p(t) / np.where(t == 0, 1, t), 1 - t / 2) * y)

    def h(x):
        return np.exp(-e * np.log(x))

    top, bottom = integral(count + 0.5), integral(1.5) - 1
    near = 2 - inverse(integral(2.5) - h(2.0))
    rank = np.zeros(len(units), np.int64)
    for c in range(units.shape[1]):
        u = top + units[:, c] * (bottom - top)
        x = inverse(u)
        k = np.clip(np.floor(x + 0.5), 1, count)
        ok = (k - x <= near) | (u >= integral(k + 0.5) - h(k))
        rank = np.where((rank == 0) & (ok | (c == units.shape[1] - 1)), k, rank).astype(np.int64)
    return rank


def zipf_draws(spark: SparkSession, n: int, count: int, exponent: float, seed: int, tries: int = 8) -> DataFrame:
    """``n`` draws, reproducible from their numbers alone."""

    def draw(index: pd.Series) -> pd.Series:
        i = index.to_numpy().astype(U)
        base = (i * U(tries))[:, None] + np.arange(tries, dtype=U)[None, :] + U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return pd.Series(zipf((mix(base) >> U(11)).astype(float) / float(1 << 53), count, exponent))

    return spark.range(n).select(F.col("id").alias("draw"), F.pandas_udf(draw, "long")("id").alias("rank"))
