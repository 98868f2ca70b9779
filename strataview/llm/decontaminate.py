"""Benchmark decontamination: SimHash over item-sized windows.

Every text is slid over in windows as long as each benchmark item. A window's
fingerprint is looked up in a multi-index: its 512 bits fall into 128 blocks of
4, and two fingerprints within a Hamming radius ``r`` agree on at least
``128 - r`` blocks, as each differing bit spoils one block at most. So the
items that agree on that many blocks hold all items within the radius, and of
unrelated items, which agree on 8 blocks on average, next to none. Candidates
are then measured exactly, as the weighted Jaccard similarity of their shingle
counts.

A window that holds too few of the benchmark's shingles cannot reach the
threshold with any item; only the others are fingerprinted. An index is built
of one shard of the benchmark, whose bytes are bounded. Where there are several
shards, the documents are read once, against a bitmap of fixed size of all
shards' shingles, and only texts with a window that could match go on to the
shards.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written
from .shingles import ODD, PUNCTUATION, shingle_hashes, word_hashes

LANES, BLOCK_BITS = 8, 4
BITS = 64 * LANES
BLOCKS = BITS // BLOCK_BITS
#: At similarity 0.8 the expected distance is 78 with a deviation of 8.
RADIUS = 108
#: Bits of the bitmap of shingles, and of one of its segments.
MAP_BITS, SEGMENT_BITS = 1 << 27, 1 << 19
FOUND = "doc_id long, item_id long, start_word int, n_words int, similarity double, distance int"


def tokens(text: str | None) -> np.ndarray:
    """Hashes of words: lower-case runs of letters, digits and non-ASCII characters."""
    return word_hashes((text or "").encode("utf-8", "surrogatepass").lower().translate(PUNCTUATION).split())


def bit_sums(h: np.ndarray) -> np.ndarray:
    """Running sums of the BITS bits that stand for each shingle, one row more
    than shingles (16 bits wide: at most 65,535 shingles)."""
    lanes = (h[:, None] ^ ODD[:LANES]) * np.roll(ODD[:LANES], -3)
    lanes = (lanes ^ (lanes >> np.uint64(32))) * np.roll(ODD[:LANES], -5)
    lanes ^= lanes >> np.uint64(29)
    bits = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")
    sums = np.zeros((len(h) + 1, BITS), np.uint16)
    np.cumsum(bits, axis=0, out=sums[1:], dtype=np.uint16)
    return sums


def majorities(sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """SimHash (LANES numbers of 64 bits) of ``n`` shingles from each place."""
    up = (sums[at + n] - sums[at]) > n // 2
    return np.packbits(up, axis=1, bitorder="little").view(np.uint64)


#: Starts of windows, and lengths, that share running sums; longer windows are summed in parts.
SEGMENT = 4096


def fingerprints(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the ``n`` shingles from each of ``starts``; repeated shingles
    weigh as often as they occur. A window is a difference of running sums."""
    out = np.zeros((len(starts), LANES), np.uint64)
    if n <= SEGMENT:
        lo = 0
        while lo < len(starts):
            hi = int(np.searchsorted(starts, starts[lo] + SEGMENT, "left"))
            first = int(starts[lo])
            out[lo:hi] = majorities(bit_sums(h[first : int(starts[hi - 1]) + n]), starts[lo:hi] - first, n)
            lo = hi
        return out
    # a long window: the sum of its segments, then what neighbours lose and gain
    count, before = np.zeros(BITS, np.int64), None
    ones = lambda part: bit_sums(part)[-1].astype(np.int64)
    for i, s in enumerate(starts.tolist()):
        if before is not None and s - before <= n // 2:
            for lo in range(0, s - before, SEGMENT):
                step = min(SEGMENT, s - before - lo)
                count = count - ones(h[before + lo : before + lo + step]) + ones(h[before + n + lo : before + n + lo + step])
        else:
            count = sum(ones(h[lo : min(lo + SEGMENT, s + n)]) for lo in range(s, s + n, SEGMENT))
        out[i] = np.packbits(count > n // 2, bitorder="little").view(np.uint64)
        before = s
    return out


def blocks_of(prints: np.ndarray) -> np.ndarray:
    """The 4-bit blocks of fingerprints, as columns."""
    raw = np.ascontiguousarray(prints).view(np.uint8)
    return np.stack([raw & 15, raw >> 4], axis=2).reshape(len(prints), BLOCKS)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class MultiIndex:
    """Fingerprints by block and block value; each list holds the places of its items."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.least = prints, radius, max(1, BLOCKS - radius)
        keys = blocks_of(prints).astype(np.int64) + np.arange(BLOCKS) * (1 << BLOCK_BITS)
        order = np.argsort(keys.ravel(), kind="stable")
        self.ids = (order // BLOCKS).astype(np.int32)
        self.ends = np.searchsorted(keys.ravel()[order], np.arange((BLOCKS << BLOCK_BITS) + 1)).astype(np.int64)

    def candidates(self, values: np.ndarray) -> np.ndarray:
        """(row, place) of all items that agree with a row of block values on
        enough blocks: all within the radius, and few others."""
        n = len(self.prints)
        rows = max(1, (1 << 20) // n)
        found = []
        for lo in range(0, len(values), rows):
            at = values[lo : lo + rows].astype(np.int64) + np.arange(BLOCKS) * (1 << BLOCK_BITS)
            first, lens = self.ends[at].ravel(), (self.ends[at + 1] - self.ends[at]).ravel()
            total = int(lens.sum())
            idx = np.repeat(first - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(total)
            row = np.repeat(np.repeat(np.arange(len(at)), BLOCKS), lens)
            agree = np.bincount(row * n + self.ids[idx], minlength=len(at) * n)
            hit = np.flatnonzero(agree >= self.least)
            found.append(np.stack([hit // n + lo, hit % n], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def near(self, prints: np.ndarray) -> np.ndarray:
        """(row, place, distance) of all items within the radius of each row of prints."""
        c = self.candidates(blocks_of(prints))
        d = np.bitwise_count(self.prints[c[:, 1]] ^ prints[c[:, 0]]).sum(axis=1).astype(np.int64)
        return np.column_stack([c, d])[d <= self.radius]


def _least(size: int, n: int, t: float) -> float:
    """Shingles that a window of ``n`` needs of an item of ``size``: for equal
    sizes min/(2n - min) >= t; for a text shorter than the item min/size >= t."""
    return (2 * t / (1 + t) * n if n == size else t * size) - 1e-9


def _starts(hits: np.ndarray, size: int, t: float) -> np.ndarray:
    """Starts of item-sized windows with enough hits, from running sums of hits."""
    n = min(size, len(hits) - 1)
    return np.flatnonzero(hits[n:] - hits[:-n] >= _least(size, n, t))


class BenchmarkIndex:
    """Items of one shard, a multi-index for each size."""

    def __init__(self, items: list[tuple[int, str | None]], k: int, radius: int, threshold: float):
        self.threshold = threshold
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item, text in items:
            h = shingle_hashes(tokens(text), k)
            if len(h):  # an item without words matches nothing
                by_size[len(h)].append((item, h))
        self.items = {size: [(item, Counter(h.tolist())) for item, h in some] for size, some in by_size.items()}
        self.index = {size: MultiIndex(np.concatenate([fingerprints(h, np.zeros(1, np.int64), size) for _, h in some]), radius) for size, some in by_size.items()}
        self.known = np.unique(np.concatenate([h for some in by_size.values() for _, h in some])) if by_size else np.zeros(0, np.uint64)

    def search(self, h: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """Best match of each item in a text of shingles ``h``: (item, similarity, start, size, distance)."""
        if not len(self.known) or not len(h):
            return []
        hits = self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h
        if not hits.any():
            return []
        sums = np.concatenate([[0], np.cumsum(hits)])
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}

        def measure(size: int, n: int, starts: np.ndarray, prints: np.ndarray) -> None:
            now, c = -1, None
            for row, i, d in self.index[size].near(prints).tolist():
                s = int(starts[row])
                if row != now:
                    now, c = row, Counter(h[s : s + n].tolist())
                sim = weighted_jaccard(c, self.items[size][i][1])
                if sim >= self.threshold - 1e-12 and ((size, i) not in best or (-sim, s) < (-best[size, i][0], best[size, i][1])):
                    best[size, i] = (sim, s, n, d)

        short: list[tuple[int, int, np.ndarray]] = []
        for size in self.index:
            starts = _starts(sums, size, self.threshold)
            n = min(size, len(h))
            if len(starts) and n <= SEGMENT:
                short.append((size, n, starts))
            elif len(starts):
                measure(size, n, starts, fingerprints(h, starts, n))
        # windows of all sizes in a stretch of the text share its running sums
        for lo in range(0, len(h), SEGMENT):
            some = [(size, n, x) for size, n, starts in short if len(x := starts[np.searchsorted(starts, lo) : np.searchsorted(starts, lo + SEGMENT)])]
            if some:
                first, last = min(int(x[0]) for _, _, x in some), max(int(x[-1]) + n for _, n, x in some)
                running = bit_sums(h[first:last])
                for size, n, x in some:
                    measure(size, n, x, majorities(running, x - first, n))
        return [(self.items[size][i][0], *found) for (size, i), found in sorted(best.items())]


def _bitmap(bench: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of all shingles of the benchmark (MAP_BITS bits, whatever its
    size: tasks fill their own, which are united segment by segment) and the
    distinct sizes of items."""

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa

        mine = np.zeros(MAP_BITS // 8, np.uint8)
        sizes: set[int] = set()
        for b in batches:
            for text in b.column(0).to_pylist():
                h = shingle_hashes(tokens(text), k)
                if len(h):
                    sizes.add(len(h))
                    at = h >> np.uint64(37)
                    np.bitwise_or.at(mine, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        rows = mine.reshape(-1, SEGMENT_BITS // 8)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[i].tobytes() for i in some], pa.binary()), pa.array([None] * len(some), pa.int32())], names=["segment", "bits", "size"])
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(sizes), pa.int32()), pa.array([None] * len(sizes), pa.binary()), pa.array(sorted(sizes), pa.int32())], names=["segment", "bits", "size"])

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.frombuffer(pdf["bits"].iloc[0], np.uint8)
        for x in pdf["bits"].iloc[1:]:
            out = out | np.frombuffer(x, np.uint8)
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "bits": [out.tobytes()]})

    filled, _ = written(bench.select("text").mapInArrow(fill, "segment int, bits binary, size int"), "benchmark-bits")
    got = np.zeros((MAP_BITS // SEGMENT_BITS, SEGMENT_BITS // 8), np.uint8)
    for r in filled.filter("segment is not null").groupBy("segment").applyInPandas(unite, "segment int, bits binary").collect():  # MAP_BITS in all
        got[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    sizes = [r["size"] for r in filled.filter("size is not null").select("size").distinct().collect()]
    return got.ravel(), np.array(sorted(sizes), np.int64)


def _possible(d: DataFrame, bench: DataFrame, k: int, t: float) -> DataFrame:
    """Texts with a window that holds enough shingles of the whole benchmark to
    match some item; the bitmap lets a few more through, and loses none."""
    bits = d.sparkSession.sparkContext.broadcast(_bitmap(bench, k))

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, sizes = bits.value
        for b in batches:
            on = []
            for text in b.column(1).to_pylist():
                h = shingle_hashes(tokens(text), k)
                at = h >> np.uint64(37)
                sums = np.concatenate([[0], np.cumsum(table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)])
                on.append(bool(len(h)) and any(len(_starts(sums, int(n), t)) for n in sizes))
            yield b.filter(pa.array(on, pa.bool_()))
        release()

    return written(d.mapInArrow(keep, "doc_id long, text string"), "possible")[0]


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = RADIUS, shard_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item with a window at least
    ``threshold`` similar: the best window (the first of equals), its first
    word, its length in words, the similarity, and the Hamming distance.

    Null and empty texts and items match nothing; a text shorter than an item
    is one window; very long texts and items are used whole. Repeated rows of
    documents give their rows again; of equal items each is reported. Ids are
    cast to long. Other columns are ignored. An empty table of either gives no
    rows. ``shard_bytes`` bounds (on average) the text of an index.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    shards = max(1, -(-int(bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if shards > 1:
        d = _possible(d, bench, k, threshold)
    found = None
    for s in range(shards):
        part = bench if shards == 1 else bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s)
        index = spark.sparkContext.broadcast(BenchmarkIndex([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()], k, radius, threshold))

        def run(batches: Iterator, index=index) -> Iterator:
            import pyarrow as pa

            ix = index.value
            for b in batches:
                cols: list[list] = [[] for _ in range(6)]
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for item, sim, start, n, dist in ix.search(shingle_hashes(tokens(text), k)):
                        for c, v in zip(cols, (doc, item, start, n + k - 1, sim, dist), strict=True):
                            c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])
            release()

        got = d.mapInArrow(run, FOUND)
        found = got if found is None else found.unionByName(got)
    return found
