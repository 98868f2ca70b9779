"""Slot table: a binary table of fixed 64-byte records behind a 4 KiB header,
as a Python Data Source: read with one partition per part of a file, and
written with one file a task into a folder, in Arrow batches both ways.

Record layout (little-endian): version key u64, version hash 16 bytes, block
index u64, length u64, placement u64, extent u32, slot offset u64 (kept in
units of 4 KiB as u32), check u32 = low half of XXH3-64 over the first 60
bytes. A record of zeros is an empty slot; a torn one fails its check.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

HEADER, RECORD = 4096, 64
MASK = (1 << 64) - 1
LAYOUT = struct.Struct("<Q16sQQQII4x")
#: The same layout as an array of records.
RECORDS = np.dtype([("version_key", "<u8"), ("version_hash", "S16"), ("block_index", "<u8"), ("len", "<u8"), ("placement", "<u8"), ("extent", "<u4"), ("offset", "<u4"), ("zero", "<u4"), ("check", "<u4")])
#: Records that are read and given at once.
BATCH = 65_536
SCHEMA = "slot long, version_key long, version_hash string, block_index long, len long, placement long, extent int, offset long, valid boolean"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def encode(version_key: int, version_hash: bytes, index: int, length: int, placement: int, extent: int, offset: int) -> bytes:
    import xxhash

    body = LAYOUT.pack(version_key, version_hash, index, length, placement, extent, offset >> 12)
    return body + struct.pack("<I", xxhash.xxh3_64_intdigest(body) & 0xFFFFFFFF)


def decode(raw: bytes) -> tuple | None:
    """A record's fields and whether its check holds; None for an empty slot."""
    import xxhash

    if not any(raw):
        return None
    key, version, index, length, placement, extent, units = LAYOUT.unpack(raw[:60])
    good = struct.unpack("<I", raw[60:])[0] == xxhash.xxh3_64_intdigest(raw[:60]) & 0xFFFFFFFF
    return _signed(key), version.hex(), _signed(index), _signed(length), _signed(placement), extent, units << 12, good


def checks(raw: bytes) -> np.ndarray:
    """The check of each 64-byte record, of its first 60 bytes."""
    import xxhash

    digest, view = xxhash.xxh3_64_intdigest, memoryview(raw)
    return np.fromiter((digest(view[i : i + RECORD - 4]) & 0xFFFFFFFF for i in range(0, len(raw), RECORD)), "<u4", len(raw) // RECORD)


def encode_batch(b) -> bytes:
    """:func:`encode` for an Arrow batch of SCHEMA; a row that is not ``valid`` gets a spoilt check."""
    import pyarrow as pa

    out = np.zeros(b.num_rows, RECORDS)
    for name in ("version_key", "block_index", "len", "placement", "extent", "offset", "version_hash"):
        if b.column(name).null_count:
            raise ValueError(f"a slot record has no {name}")
    whole = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("version_key", "block_index", "len", "placement", "extent", "offset")}
    for name, least, end in (("block_index", 0, 1 << 63), ("len", 0, 1 << 63), ("extent", 0, 1 << 32), ("offset", 0, 1 << 44)):
        if b.num_rows and (whole[name].min() < least or whole[name].max() >= end):
            raise ValueError(f"{name} of a slot record out of range")
    for name in ("version_key", "block_index", "len", "placement", "extent"):
        out[name] = whole[name].astype(out[name].dtype)
    out["offset"] = whole["offset"] >> 12
    names = b.column("version_hash").cast(pa.string()).to_pylist()
    hashes = bytes.fromhex("".join(names))
    if any(len(x) != 32 for x in names) or len(hashes) != 16 * len(names):
        hashes = b"".join(bytes.fromhex(x)[:16].ljust(16, b"\0") for x in names)
    raw = out.view(np.uint8).reshape(-1, RECORD)
    raw[:, 8:24] = np.frombuffer(hashes, np.uint8).reshape(-1, 16)
    valid = b.column("valid").fill_null(False).to_numpy(zero_copy_only=False)
    out["check"] = checks(raw.tobytes()) ^ np.where(valid, 0, 1 << 24).astype("<u4")  # the last byte is spoilt
    return out.tobytes()


def decode_batch(raw: bytes, first: int):
    """:func:`decode` for records that begin at slot ``first``, as an Arrow batch of SCHEMA; empty slots are left out."""
    import pyarrow as pa

    rows = np.frombuffer(raw, RECORDS)
    used = np.flatnonzero(np.frombuffer(raw, "<u8").reshape(-1, RECORD // 8).any(axis=1))
    good = (rows["check"] == checks(raw))[used]
    hashes = np.frombuffer(raw, np.uint8).reshape(-1, RECORD)[used, 8:24].tobytes().hex().encode()
    rows, n = rows[used], len(used)
    text = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * 32), pa.py_buffer(hashes))
    long = lambda name: pa.array(rows[name].astype(np.int64))
    columns = [pa.array(used + first), long("version_key"), text, long("block_index"), long("len"), long("placement"), pa.array(rows["extent"]).cast(pa.int32()), pa.array(rows["offset"].astype(np.int64) << 12), pa.array(good)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class Part(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class SlotTableReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.part = int(options.get("partrecords", 1 << 20))

    def partitions(self) -> list[Part]:
        import glob
        import os

        files = sorted(glob.glob(os.path.join(self.path, "*.slots"))) if os.path.isdir(self.path) else [self.path]
        parts = []
        for f in files:
            n = max(0, os.path.getsize(f) - HEADER) // RECORD
            parts += [Part(f, i, min(i + self.part, n)) for i in range(0, n, self.part)]
        return parts or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator:
        if part.first == part.last:
            return
        with open(part.path, "rb") as f:
            f.seek(HEADER + part.first * RECORD)
            for at in range(part.first, part.last, BATCH):
                yield decode_batch(f.read(min(BATCH, part.last - at) * RECORD), at)


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class SlotTableWriter(DataSourceArrowWriter):
    """One file a task, named after its attempt; only files of a committed job
    get the ending that readers look for. A row that is not ``valid`` is
    written torn: its check is spoilt."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, batches: Iterator) -> Written:
        import os
        import uuid

        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"part-{uuid.uuid4().hex}.tmp")
        with open(name, "wb") as f:
            f.write(bytes(HEADER))
            for b in batches:
                f.write(encode_batch(b))
        return Written(name)

    def commit(self, messages: list) -> None:
        import os

        for m in messages:
            if m is not None:
                os.replace(m.path, m.path.removesuffix(".tmp") + ".slots")

    def abort(self, messages: list) -> None:
        import os

        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class SlotTable(DataSource):
    """``spark.read.format("slot_table").load(path)``; the file must be on a path every worker mounts."""

    @classmethod
    def name(cls) -> str:
        return "slot_table"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SlotTableReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SlotTableWriter(self.options)
