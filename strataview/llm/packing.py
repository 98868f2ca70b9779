"""Packing documents into as few fixed-size sequences as possible.

Only lengths matter to a packing, and there are at most ``capacity`` of them,
so the search runs on the histogram of piece lengths, whose size is bounded by
the capacity and not by the corpus. Bin completion: take the largest length
left, take undominated fillings of the space beside it, the fullest of all
among them (not every one: see ``fillings``), and branch over them, best fit first; a branch ends when its waste, added to the waste already
made, exceeds what the incumbent allows. A filling is used as many times as
the histogram has it. Pieces then get their places by their rank within their
length, from counts per (length, salt), so no length lands in one task. Full pieces
stand alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written
from .tokens import default_vocabulary, encode

PIECES = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long"


def cut_into_pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """A row per piece: ids of the whole text, then ``end_id``; longer ones are
    cut into pieces of ``capacity``, of which the first takes the remainder.
    ``row_key`` numbers the rows of all tasks, so repeated rows differ in it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text, vocabulary), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                at, k = 0, 0
                size = n % capacity or capacity
                while at < n:
                    crc = zlib.crc32(ids[at : at + size].tobytes())
                    for c, v in zip(cols, (doc, row, k, at, size, crc), strict=True):
                        c.append(v)
                    at, k, size = at + size, k + 1, capacity
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "row_key", "piece", "start", "length", "ids_crc32"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def fillings(room: int, counts: np.ndarray, most: int) -> list[tuple[int, ...]]:
    """Sets of lengths (largest first) that fit ``room``, fullest first, none
    dominated by another of them, at most ``most`` and the fullest. One set
    dominates another if the other could be packed inside its pieces. This is
    a bounded search: each level tries the three largest lengths that fit and
    half the room, within ``4 * most`` nodes; where it leaves waste, the
    fullest set of all comes from a subset-sum table."""
    have = np.flatnonzero(counts)[::-1]
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [4 * most]

    def grow(room_left: int, chosen: list[int], frm: int) -> None:
        if len(found) >= most or budget[0] <= 0:
            return
        budget[0] -= 1
        fits = [int(x) for x in have[np.searchsorted(-have, -min(room_left, frm)) :] if counts[x] > chosen.count(int(x))] if room_left else []
        if not fits:
            # nothing no larger than the last can be added; it is maximal only if nothing larger could replace the waste
            found.append((room_left, tuple(chosen)))
            return
        for x in fits[:3] + ([room_left // 2] if room_left // 2 in fits[3:] else []):
            grow(room_left - x, [*chosen, x], x)

    grow(room, [], room)
    if found and min(found)[0]:
        best = fullest(room, counts)
        found.append((room - sum(best), best))
    kept: list[tuple[int, tuple[int, ...]]] = []
    for waste, c in sorted(set(found), key=lambda f: (f[0], [-x for x in f[1]])):  # fullest first; of these, the one that spares small pieces
        if not any(_dominates(k, c) for _, k in kept):
            kept.append((waste, c))
    return [c for _, c in kept]


def fullest(room: int, counts: np.ndarray) -> tuple[int, ...]:
    """Lengths (largest first) with the largest sum that fits ``room``."""
    reach, all_of = 1, (1 << (room + 1)) - 1
    before: list[tuple[int, int]] = []
    for x in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        for _ in range(min(int(counts[x]), room // x)):
            new = (reach | reach << x) & all_of
            if new == reach:
                break
            before.append((x, reach))
            reach = new
        if reach >> room:
            break
    at, out = reach.bit_length() - 1, []
    for x, had in reversed(before):
        if not had >> at & 1:
            out.append(x)
            at -= x
    return tuple(sorted(out, reverse=True))


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the lengths of ``b`` can be grouped into the lengths of ``a`` (greedy test, sufficient)."""
    room = sorted(a)
    for x in sorted(b, reverse=True):
        for i, r in enumerate(room):
            if r >= x:
                room[i] = r - x
                room.sort()
                break
        else:
            return False
    return True


def _complete(counts: np.ndarray, capacity: int, pick: list[int] | None, width: int, spare: int) -> tuple[int, list[tuple[tuple[int, ...], int]], int]:
    """One descent: at each step fill a bin around the largest length left, as
    often as the pieces allow. ``pick`` chooses another filling at given steps.
    Returns bins, patterns (none if the waste passed ``spare``) and steps."""
    left, out, bins, waste, step = counts.copy(), [], 0, 0, 0
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        options = fillings(capacity - top, left, width) or [()]
        left[top] += 1
        pattern = (top, *options[min(pick[step], len(options) - 1) if pick and step < len(pick) else 0])
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        times = min(int(left[x]) // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= k * times
        out.append((pattern, times))
        bins += times
        waste += (capacity - sum(pattern)) * times
        step += 1
        if waste > spare:
            return bins, [], step
    return bins, out, step


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on the histogram: equal pieces are placed together."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by space left
    for x in range(capacity, 0, -1):
        todo, s = int(counts[x]), x
        while todo:
            while s <= capacity and not bins.get(s):
                s += 1
            if s > capacity:
                k = capacity // x
                if todo // k:
                    bins.setdefault(capacity - k * x, []).append(((x,) * k, todo // k))
                if todo % k:
                    bins.setdefault(capacity - (todo % k) * x, []).append(((x,) * (todo % k), 1))
                break
            pattern, times = bins[s].pop()
            k = min(times, todo)
            if times > k:
                bins[s].append((pattern, times - k))
            bins.setdefault(s - x, []).append(((*pattern, x), k))
            todo -= k
            s = x  # a bin may take another piece of this length
    return [b for v in bins.values() for b in v]


def solve(counts: np.ndarray, capacity: int, width: int = 48, branches: int = 24) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with multiplicities that use up ``counts`` (index = length).

    Incumbents are best fit decreasing and the descent that takes the fullest
    filling everywhere. Further descents branch to the second or third filling
    at one of the last, wasteful steps; one is given up when its bins reach the
    incumbent's or its waste exceeds what fewer bins would leave. The search
    ends at the lower bound ceil(sum / capacity), or after ``branches``
    descents (a documented bound on the search, not on rows).
    """
    total = int((np.arange(len(counts)) * counts).sum())
    bound = -(-total // capacity)
    best = best_fit(counts, capacity)
    bins = sum(k for _, k in best)
    if bins <= bound:
        return best
    got = _complete(counts, capacity, None, width, (bins - 1) * capacity - total)
    steps = got[2]
    if got[1]:
        bins, best = got[0], got[1]
    tried = 0
    for back in range(2, steps + 1):
        for alt in (1, 2):
            if bins <= bound or tried >= branches:
                return best
            tried += 1
            b, out, s = _complete(counts, capacity, [0] * (steps - back) + [alt], width, (bins - 1) * capacity - total)
            if out:
                bins, best, steps = b, out, s
    return best


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null or empty text: one piece of the end id alone. Very long texts are
    encoded whole and cut. Repeated rows and rows without an id are packed like
    any other; ids are cast to long (what is no number is null); other columns
    are ignored. An empty table gives no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    pieces, _ = written(cut_into_pieces(docs, capacity, end_id, vocabulary, id_col, text_col).withColumn("spread", F.xxhash64("row_key", "piece")), "pieces")
    whole = pieces.filter(F.col("length") == capacity)  # each fills a sequence alone and needs no search
    pieces = pieces.filter(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # fewer than capacity rows
        counts[r["length"]] = r["count"]
    salts = int(min(1024, max(salts, counts.max() // 1_000_000)))
    pieces = pieces.withColumn("salt", F.pmod("spread", F.lit(salts)).cast("int"))
    by_salt = np.zeros((capacity + 1, salts), np.int64)
    for r in pieces.groupBy("length", "salt").count().collect():  # fewer than capacity x salts rows
        by_salt[r["length"], r["salt"]] = r["count"]
    before = np.cumsum(by_salt, axis=1) - by_salt  # rank of a salt's first piece within its length
    # slots: per length, runs of ranks that share a pattern and a place in it
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used = np.zeros(capacity + 1, np.int64)
    first_bin = 0
    for pattern, times in solve(counts, capacity):
        offset = 0
        for x in pattern:
            runs.setdefault(x, []).append((int(used[x]), times, first_bin, offset))
            used[x] += times
            offset += x
        first_bin += times
    table = {x: np.array(v, np.int64) for x, v in runs.items()}

    def place(length: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy() + before[length.to_numpy(), salt.to_numpy()]
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for x in np.unique(n):
            at, t = n == x, table[int(x)]
            k = np.searchsorted(t[:, 0], r[at], side="right") - 1
            seq[at] = t[k, 2] + r[at] - t[k, 0]
            off[at] = t[k, 3]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row_key", "piece")) - 1
    placed = F.pandas_udf(place, "sequence_id long, offset long")
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    filled = pieces.withColumn("rank", rank.cast("long")).withColumn("at", placed("length", "salt", "rank")).select(*out, "at.sequence_id", "at.offset")
    alone = whole.select(*out, (F.lit(first_bin) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return filled.unionByName(alone)
