"""Byte sizes, durations, and histogram buckets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = [0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
BYTES = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40}
MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}


def _scaled(text: Column, table: dict[str, int]) -> Column:
    number = F.regexp_extract(F.trim(text), r"^(\d+)\s*([A-Za-z]*)$", 1).try_cast("long")
    unit = F.regexp_extract(F.trim(text), r"^(\d+)\s*([A-Za-z]*)$", 2)
    out = None
    for u, k in table.items():
        out = F.when(unit == u, number * k) if out is None else out.when(unit == u, number * k)
    return out


def parse_bytes(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^\d+$"), F.trim(text).try_cast("long")).otherwise(_scaled(text, BYTES))


def parse_duration(text: Column) -> Column:
    """Microseconds; null for anything without a known unit."""
    return _scaled(text, MICROS)


def fixed_bucket(seconds: Column, bounds: list[float] = LATENCY_BOUNDS) -> Column:
    """Place of the first bound that is at least the value; ``len(bounds)`` above all."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(seconds <= bounds[i], i).otherwise(out)
    return out


def power_of(value: Column) -> Column:
    """Floor of log2, exactly, from the binary text."""
    return F.length(F.bin(value)) - 1


def loglinear_bucket(value: Column, bits: int) -> Column:
    """Exact below 2^(bits+1); above, 2^bits buckets a power of two."""
    shift = power_of(value) - bits
    top = F.floor(value / F.pow(F.lit(2.0), shift)).cast("long")
    return F.when(value < (2 << bits), value).otherwise((shift + 1) * (1 << bits) + top - (1 << bits)).cast("long")


def loglinear_highest(bucket: Column, bits: int) -> Column:
    shift = F.floor(bucket / (1 << bits)) - 1
    width = F.pow(F.lit(2.0), shift).cast("long")
    return F.when(bucket < (2 << bits), bucket).otherwise((bucket % (1 << bits) + (1 << bits)) * width + width - 1).cast("long")


def size_class(length: Column, least: int, most: int) -> Column:
    """Slot size: the next power of two, within [least, most]."""
    up = F.pow(F.lit(2.0), F.length(F.bin(length - 1))).cast("long")
    return F.least(F.greatest(F.when(length <= 1, F.lit(1)).otherwise(up), F.lit(least)), F.lit(most)).cast("long")
