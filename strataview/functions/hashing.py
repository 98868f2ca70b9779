"""Placement hashes in two modes.

``portable`` is a 52-bit number from MD5 that SQL engines share; it stays in
the JVM. ``xxh3`` is the faithful encoding, in an Arrow-batched UDF.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Portable hashes are below 2^52, so they are exact in a double.
PORTABLE_BITS = 52


def portable(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def portable_score(text: Column, weight: Column) -> Column:
    """Weighted rendezvous score: weight / -ln(u), u uniform from the hash."""
    return weight / -F.ln((portable(text) + F.lit(0.5)) / F.lit(float(1 << PORTABLE_BITS)))


def named(bucket: str, key: str) -> bytes:
    b, k = bucket.encode(), key.encode()
    return struct.pack("<I", len(b)) + b + struct.pack("<I", len(k)) + k


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def placement_hash(bucket: str, key: str, chunk: int | None) -> int:
    import xxhash

    raw = named(bucket, key)
    return xxhash.xxh3_64_intdigest(raw if chunk is None else raw + struct.pack("<Q", chunk))


def draw(placement: int, node: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(struct.pack("<Q", placement), seed=node) >> 11


def xxh3_placement(bucket: Column, key: Column, chunk: Column) -> Column:
    """Signed 64-bit pattern of the placement hash; a null chunk is the home."""

    def run(b: pd.Series, k: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([_signed(placement_hash(x, y, None if z is None or z != z else int(z))) for x, y, z in zip(b, k, c, strict=True)], dtype="int64")

    return F.pandas_udf(run, "long")(bucket, key, chunk.cast("long"))


def xxh3_draw(placement: Column, node: Column) -> Column:
    """53-bit draw of a node for a placement: exact in a double."""

    def run(p: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([draw(x & (1 << 64) - 1, int(y)) for x, y in zip(p, n, strict=True)], dtype="int64")

    return F.pandas_udf(run, "long")(placement, node)


def version_id(bucket: str, key: str, etag: str) -> tuple[int, str]:
    """(64-bit key hash, 128-bit version hash as hex)."""
    import xxhash

    raw, e = named(bucket, key), etag.encode()
    return xxhash.xxh3_64_intdigest(raw), xxhash.xxh3_128_hexdigest(raw + struct.pack("<I", len(e)) + e)


def ring_version(members: list[tuple[int, int]]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b"".join(struct.pack("<QI", i, w) for i, w in sorted(members)))
