"""Where Parquet, ORC and safetensors files keep their metadata: detection by
key, the bytes to read first, and the span those bytes name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 64 << 20


def detect(key: Column) -> Column:
    k = F.lower(key)
    return F.when(k.endswith(".parquet"), "parquet").when(k.endswith(".orc"), "orc").when(k.endswith(".safetensors"), "safetensors")


def spot(fmt: Column, size: Column) -> Column:
    """``struct<start,end>`` of the bytes that locate the metadata; null fields if the file is too small."""
    start = F.when((fmt == "parquet") & (size >= 12), size - 8).when((fmt == "orc") & (size >= 4), F.greatest(size - 256, F.lit(0))).when((fmt == "safetensors") & (size >= 8), F.lit(0))
    end = F.when((fmt == "parquet") & (size >= 12), size).when((fmt == "orc") & (size >= 4), size).when((fmt == "safetensors") & (size >= 8), F.lit(8))
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while shift < 64:
        b = raw[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7
    raise ValueError("varint too long")


def _orc(raw: bytes) -> tuple[int, int]:
    """Footer and metadata lengths of an ORC postscript (protobuf fields 1 and 5; field 8000 must say ORC)."""
    fields: dict[int, int | bytes] = {}
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        if tag & 7 == 0:
            value, at = _varint(raw, at)
        elif tag & 7 == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
            if at > len(raw):
                raise ValueError("field too long")
        else:
            raise ValueError("unknown field")
        if tag >> 3 != 8000 or value == b"ORC":
            fields[tag >> 3] = value
    if fields.get(8000) != b"ORC":
        raise ValueError("not ORC")
    return int(fields[1]), int(fields.get(5, 0))


def metadata_span(fmt: str | None, size: int, raw: bytes) -> tuple[int, int] | None:
    """[start, end) of the metadata, or None if the bytes name no sensible span."""
    try:
        if fmt == "parquet":
            if len(raw) != 8 or raw[4:] != b"PAR1":
                return None
            span = (size - 8 - int.from_bytes(raw[:4], "little"), size - 8)
            least = 4
        elif fmt == "orc":
            n = raw[-1]
            if n > len(raw) - 1:
                return None
            footer, meta = _orc(raw[len(raw) - 1 - n : -1])
            span = (size - 1 - n - footer - meta, size - 1 - n)
            least = 3
        elif fmt == "safetensors":
            if len(raw) != 8:
                return None
            span = (8, 8 + int.from_bytes(raw, "little"))
            least = 8
        else:
            return None
    except (IndexError, ValueError, KeyError):
        return None
    return span if least <= span[0] < span[1] <= size and span[1] - span[0] <= MOST else None


def spans(fmt: Column, size: Column, raw: Column) -> Column:
    """``struct<start,end>`` by Arrow batches (ORC needs a varint reader)."""

    def run(f: pd.Series, n: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [metadata_span(x, int(y), bytes(z)) if z is not None else None for x, y, z in zip(f, n, b, strict=True)]
        return pd.DataFrame({"start": pd.array([g and g[0] for g in got], dtype="Int64"), "end": pd.array([g and g[1] for g in got], dtype="Int64")})

    return F.pandas_udf(run, "start long, end long")(fmt, size, raw)
