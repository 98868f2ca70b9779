"""Token counts from flat, unindexed token streams.

A stream is a run of ids with an end-of-document id after each document and no
index. It is read in blocks of fixed size; each block is searched for the end
id with one vectorised comparison, and a document that crosses blocks is put
together by a prefix scan over block summaries (tokens, separators, last
separator). The scan has two levels, blocks within a chunk and chunks within a
file, so one very long file does not meet in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, written
from .tokens import default_vocabulary, encode

STREAM = "file_id long, block_no long, payload binary, ordinal long, doc_id long"


def to_streams(docs: DataFrame, vocabulary: str, end_id: int, block_tokens: int, id_col: str, text_col: str) -> DataFrame:
    """Encode whole texts into one flat stream a partition, as uint16 blocks
    (rows with ``payload``), and list which document ends at which separator
    (rows with ``ordinal``). One pass gives both."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        file_id, block, ordinal, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        names = [f.split()[0] for f in STREAM.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

        def rows(cols: list[list]):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        def blocks(last: bool) -> list[bytes]:
            nonlocal held, size
            flat = np.concatenate(held) if held else np.zeros(0, "<u2")
            cut = len(flat) if last else len(flat) // block_tokens * block_tokens
            held, size = [flat[cut:]], len(flat) - cut
            return [flat[i : min(i + block_tokens, cut)].tobytes() for i in range(0, cut, block_tokens)]

        for b in batches:
            ids = b.column(0).to_pylist()
            full: list[bytes] = []
            for text in b.column(1):
                got = encode(text.as_py(), vocabulary)
                held += [got.astype("<u2"), np.array([end_id], "<u2")]
                size += len(got) + 1
                if size >= 64 * block_tokens:
                    full += blocks(False)
            full += blocks(False)
            n, m = len(full), len(ids)
            yield rows([[file_id] * (n + m), [*range(block, block + n), *[None] * m], full + [None] * m, [None] * n + [*range(ordinal, ordinal + m)], [None] * n + ids])
            block, ordinal = block + n, ordinal + m
        if rest := blocks(True):
            yield rows([[file_id] * len(rest), [*range(block, block + len(rest))], rest, [None] * len(rest), [None] * len(rest)])
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, STREAM)


def read_token_files(spark: SparkSession, path: str, block_bytes: int = 1 << 17, blocks_each: int = 64) -> DataFrame:
    """Flat token files of any size as blocks. Spark lists the files and their
    sizes; each task then reads byte ranges of its own, so a file is never one
    row or one task. Files are opened through ``pyarrow.fs`` (local, HDFS, S3,
    GCS paths), like any file a worker opens itself."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    span = block_bytes * blocks_each
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / span)).cast("long"))).alias("k")
    ranges = files.select(F.xxhash64("path").alias("file_id"), "path", "length", at).repartition(F.col("path"), F.col("k"))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for file_id, name, length, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                scheme, _, rest = name.partition(":")
                where, inner = fs.FileSystem.from_uri(f"{scheme}://{quote(re.sub('^//', '', rest))}")
                with where.open_input_file(inner) as f:
                    flat = f.read_at(min(span, length - k * span), k * span)
                parts = [flat[i : i + block_bytes] for i in range(0, len(flat), block_bytes)] or [b""]
                first = k * blocks_each
                yield pa.RecordBatch.from_arrays([pa.array([file_id] * len(parts)), pa.array(range(first, first + len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["file_id", "block_no", "payload"])

    return ranges.mapInArrow(read, "file_id long, block_no long, payload binary")


def count_tokens(blocks: DataFrame, end_id: int, dtype: str = "<u2", chunk: int = 256) -> DataFrame:
    """One row per document of each file: ``file_id, ordinal, n_tokens,
    terminated``. Tokens after a file's last separator are a document of their
    own (``terminated`` false). A null or empty payload holds no token."""

    def search(payload: pd.Series) -> pd.DataFrame:
        seps = [np.flatnonzero(np.frombuffer(p or b"", dtype) == end_id).astype(np.int64) for p in payload]
        return pd.DataFrame({"n": [len(p or b"") // np.dtype(dtype).itemsize for p in payload], "seps": seps})

    found = F.pandas_udf(search, "n long, seps array<long>")
    b = blocks.select("file_id", "block_no", F.floor(F.col("block_no") / chunk).alias("chunk"), found("payload").alias("f"))
    b = b.select("file_id", "block_no", "chunk", F.col("f.n").alias("n"), F.col("f.seps").alias("seps"), F.size("f.seps").cast("long").alias("m"))
    within = Window.partitionBy("file_id", "chunk").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).withColumn("k", F.coalesce(F.sum("m").over(within), F.lit(0)))
    b = b.withColumn("last", F.max(F.col("at") + F.try_element_at("seps", F.lit(-1))).over(within))
    sums = b.groupBy("file_id", "chunk").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max(F.col("at") + F.try_element_at("seps", F.lit(-1))).alias("end"), F.max("block_no").alias("final"))
    over = Window.partitionBy("file_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_id")
    c = sums.withColumn("c_at", F.coalesce(F.sum("n").over(over), F.lit(0))).withColumn("c_k", F.coalesce(F.sum("m").over(over), F.lit(0)))
    c = c.withColumn("c_last", F.max(F.col("c_at") + F.col("end")).over(over)).withColumn("final", F.max("final").over(whole))
    b = b.join(c.select("file_id", "chunk", "c_at", "c_k", "c_last", "final"), ["file_id", "chunk"])
    base = F.col("c_at") + F.col("at")
    before = F.coalesce(F.col("c_at") + F.col("last"), F.col("c_last"), F.lit(-1))
    ends = F.transform("seps", lambda s: s + base)
    lengths = F.transform(F.arrays_zip(ends.alias("e"), F.concat(F.array(before), ends).alias("p")), lambda x: F.struct((x["e"] - x["p"] - 1).alias("n_tokens"), F.lit(True).alias("terminated")))
    tail = F.when((F.col("block_no") == F.col("final")) & (base + F.col("n") - 1 > F.coalesce(F.element_at(F.concat(F.array(before), ends), -1), F.lit(-1))), F.array(F.struct((base + F.col("n") - 1 - F.element_at(F.concat(F.array(before), ends), -1)).alias("n_tokens"), F.lit(False).alias("terminated"))))
    docs = F.concat(F.filter(lengths, lambda x: x["n_tokens"].isNotNull()), F.coalesce(tail, F.expr("cast(array() as array<struct<n_tokens:bigint,terminated:boolean>>)")))
    return b.select("file_id", F.posexplode(docs).alias("i", "d"), (F.col("c_k") + F.col("k")).alias("k0")).select("file_id", (F.col("k0") + F.col("i")).alias("ordinal"), "d.n_tokens", "d.terminated")


def document_token_counts(docs: DataFrame, vocabulary: str | None = None, end_id: int = 50256, block_tokens: int = 65536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` to flat streams, scan them, and give ``doc_id, n_tokens``
    (without the end id) per input row. Null or empty text: 0. Very long texts
    are encoded whole and cross blocks. Repeated rows and rows without an id
    count like any other; ids are cast to long; other columns are ignored; an
    empty table gives no rows."""
    stream, _ = written(to_streams(docs, vocabulary or default_vocabulary(), end_id, block_tokens, id_col, text_col), "streams")
    counts = count_tokens(stream.filter("payload is not null").select("file_id", "block_no", "payload"), end_id)
    names = stream.filter("ordinal is not null").select("file_id", "ordinal", "doc_id")
    return names.join(counts, ["file_id", "ordinal"]).select("doc_id", "n_tokens")
