"""Removal of long byte strings that occur more than once, by suffix arrays.

A string of ``length`` bytes has ``length - GRAM + 1`` grams of ``GRAM`` bytes;
the gram with the smallest hash (the first of equals) is its anchor. Equal
strings have equal anchors at equal distances, so anchors decide where to
look: a run of strings that share an anchor occurrence is one candidate, and
candidates whose gram occurs nowhere else are done. Of the rest, candidates
with identical bytes are merged before anything is sorted.

What is left is dealt out by anchor, in chunks of bounded size. There the
strings' suffixes are sorted by their bytes (a sparse suffix array), and
longest-previous-factor values come from the previous and next smaller
positions in suffix order: a value of at least ``length`` means an earlier
copy in text order. A group larger than one chunk sends each distinct string
once more, as a digest, to be matched across its chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, join_counted, release, written
from .shingles import shingle_hashes, word_hashes

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """Powers of BASE (or of its inverse) modulo 2^64, grown by doubling."""
    have = _powers[which]
    b = int(BASE) if which == "up" else pow(int(BASE), -1, 1 << 64)
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(b, len(have), 1 << 64))])
    _powers[which] = have
    return have[:n]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("up", len(raw)), out=out[1:])
    return out


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its least one (the first of equals)."""
    n = len(h) - width + 1
    # value and place in one comparable number: the high half of the hash, then the place. The choice depends on
    # the window's bytes alone, so equal strings choose alike
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    size, best = 1, key
    while size * 2 <= width:
        best = np.minimum(best[: len(best) - size], best[size:])
        size *= 2
    got = np.minimum(best[:n], best[width - size : width - size + n])
    return (got & np.uint64(0xFFFFFFFF)).astype(np.int64)


def smaller_neighbours(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the previous and the next smaller value (-1 if none), by
    repeated jumps of all unresolved places at once."""

    def previous(x: np.ndarray) -> np.ndarray:
        at = np.arange(-1, len(x) - 1)
        open_ = np.flatnonzero((at >= 0) & (x[np.maximum(at, 0)] > x))
        back = at.copy()
        while len(open_):
            back[open_] = back[back[open_]]
            b = back[open_]
            open_ = open_[(b >= 0) & (x[np.maximum(b, 0)] > x[open_])]
        return back

    p = previous(a)
    q = previous(a[::-1])[::-1]
    return p, np.where(q >= 0, len(a) - 1 - q, -1)


def previous_factors(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For strings of equal length in text order: how long a prefix each shares
    with an earlier one, and with any other one."""
    n, length = len(strings), len(strings[0])
    order = np.array(sorted(range(n), key=strings.__getitem__), dtype=np.int64)
    lcp = np.zeros(n + 1, np.int64)  # lcp[r]: of ranks r - 1 and r
    for lo in range(0, n - 1, 8192):
        some = np.frombuffer(b"".join(strings[i] for i in order[lo : lo + 8193]), np.uint8).reshape(-1, length)
        differs = some[1:] != some[:-1]
        lcp[lo + 1 : lo + len(some)] = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    prev, nxt = smaller_neighbours(order)

    # the common prefix of two ranks is the least lcp between them: sparse table of minima
    table = [lcp]
    while (1 << len(table)) < len(lcp):
        t, s = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(t[: len(t) - s], t[s:]))

    def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:  # inclusive places of lcp
        k = np.floor(np.log2(hi - lo + 1)).astype(np.int64)
        out = np.empty(len(lo), np.int64)
        for j in np.unique(k):
            m = k == j
            out[m] = np.minimum(table[j][lo[m]], table[j][hi[m] - (1 << j) + 1])
        return out

    r = np.arange(n)
    lpf = np.zeros(n, np.int64)
    for other in (prev, nxt):
        ok = other >= 0
        lo, hi = np.minimum(r, other)[ok] + 1, np.maximum(r, other)[ok]
        lpf[ok] = np.maximum(lpf[ok], least(lo, hi))
    any_ = np.maximum(lcp[:-1], lcp[1:])
    back = np.empty(n, np.int64)
    back[order] = r
    return lpf[back], any_[back]


#: Strings in memory at once while a bucket is matched.
PORTION = 20_000


def _portions(gram: np.ndarray, at: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (sorted by anchor) and the stretch [lo, hi) of each row's strings,
    in portions of bounded size. Equal strings share an anchor, and lie at one
    distance from it, so a portion holds whole anchors, or, of an anchor with
    many strings, all those at some distances."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(gram)) + 1, [len(gram)]])
    rows: list[np.ndarray] = []
    held = 0
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        r, n = np.arange(a, b), int(sizes[a:b].sum())
        if n > PORTION:
            far = at[r] - first[r]  # distance of a row's first string; its last one's is far - size + 1
            step = max(1, PORTION // len(r))
            for d in range(int((far - sizes[r]).min()) + 1, int(far.max()) + 1, step):
                lo, hi = np.clip(far - d - step + 1, 0, sizes[r]), np.clip(far - d + 1, 0, sizes[r])
                some = hi > lo
                yield r[some], lo[some], hi[some]
            continue
        if held + n > PORTION and rows:
            every = np.concatenate(rows)
            yield every, np.zeros(len(every), np.int64), sizes[every]
            rows, held = [], 0
        rows.append(r)
        held += n
    if rows:
        every = np.concatenate(rows)
        yield every, np.zeros(len(every), np.int64), sizes[every]


def _matches(pdf: pd.DataFrame, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, keep_first: bool) -> list[pd.DataFrame]:
    """Spans of the strings of one portion that occur before (or anywhere
    else), and, of anchors dealt out in several chunks, digests of the first of
    each distinct string."""
    if not len(rows):
        return []
    raw = pdf["bytes"].to_numpy()
    strings = [raw[r][i : i + length] for r, x, y in zip(rows.tolist(), lo.tolist(), hi.tolist(), strict=True) for i in range(x, y)]
    n = hi - lo
    row = np.repeat(rows, n)
    start = np.repeat(pdf["first"].to_numpy()[rows] + lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(row))
    lpf, anywhere = previous_factors(strings)
    doc = pdf["doc"].to_numpy()[row]
    hit = (lpf if keep_first else anywhere) >= length
    joined = hit[1:] & hit[:-1] & (row[1:] == row[:-1])
    begin = np.flatnonzero(hit & ~np.concatenate([[False], joined]))
    stop = np.flatnonzero(hit & ~np.concatenate([joined, [False]]))
    out = [pd.DataFrame({"doc": doc[begin], "s": start[begin], "e": start[stop] + length, "digest": None})] if len(begin) else []
    lone = np.flatnonzero((lpf < length) & pdf["split"].to_numpy()[row])
    if len(lone):
        out.append(pd.DataFrame({"doc": doc[lone], "s": start[lone], "e": start[lone] + length, "digest": [hashlib.blake2b(strings[i], digest_size=12).digest() for i in lone]}))
    return out


CANDIDATE = "gram long, doc bigint, at int, first int, last int, same binary"


def candidates(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors of whole texts: ``gram`` (hash), ``doc``, ``at`` (its place),
    ``first``/``last`` (starts of the strings it anchors), ``same`` (digest of
    all bytes of those strings)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        width = length - gram + 1
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            digests: list[bytes] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                flat = np.frombuffer(raw, np.uint8)
                sums = prefix_sums(flat)
                h = _mix((sums[gram:] - sums[:-gram]) * _power("down", len(sums))[: len(sums) - gram])
                anchor = sliding_argmin(h, width)
                edge = np.flatnonzero(np.diff(anchor)) + 1
                first = np.concatenate([[0], edge])
                last = np.concatenate([edge - 1, [len(anchor) - 1]])
                at = anchor[first]
                for c, v in zip(cols, (h[at].view(np.int64), np.full(len(at), doc), at, first, last), strict=True):
                    c.append(v)
                digests += [hashlib.blake2b(raw[i : j + length], digest_size=12).digest() for i, j in zip(first.tolist(), last.tolist(), strict=True)]
            if digests:
                kinds = [np.int64, np.int64, np.int32, np.int32, np.int32]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds, strict=True)), pa.array(digests, pa.binary())], names=["gram", "doc", "at", "first", "last", "same"])
        release()

    return docs.select("doc", "text").mapInArrow(run, CANDIDATE)


def repeated_spans(docs: DataFrame, length: int, keep_first: bool, gram: int | None = None, chunk_rows: int = 20_000, bucket_rows: int = 800, broadcast_rows: int = 1_000_000, words: int = 0) -> DataFrame:
    """Spans of bytes to remove: ``doc, spans array<struct<s,e>>`` (disjoint,
    sorted) from rows ``doc`` (unique long), ``text``. Text order is ``doc``,
    then place. Runs of ``words`` words (0: none) that repeat are removed also
    where they are shorter than ``length``. ``chunk_rows`` bounds the candidates of one anchor in a chunk;
    ``broadcast_rows`` bounds what may be broadcast, beyond it texts are shuffled."""
    spark = docs.sparkSession
    gram = gram or length // 2
    found, p_found = written(candidates(docs, length, gram), "anchors")
    often, p_often = written(found.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "often")
    again, p_again = written(join_counted(found, often, ["gram"], "c").drop("c"), "again")
    drop(spark, p_found, p_often)
    order = F.struct("doc", "at", "first", "last")
    merged, p_merged = written(again.groupBy("gram", "same").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("rep")), "merged")

    # 1. candidates with identical bytes: every string in them repeats
    twice, p_twice = written(merged.filter("n > 1").select("same", "gram", "n", F.col("rep.doc").alias("r_doc"), F.col("rep.at").alias("r_at")), "twice")
    copies = join_counted(again, twice, ["gram", "same"], "n")
    if keep_first:
        copies = copies.filter("doc <> r_doc or at <> r_at")
    whole = copies.select("doc", F.col("first").alias("s"), (F.col("last") + length).alias("e"))

    # 2. one representative of each, where the anchor has several: suffix arrays over their bytes
    several, p_several = written(merged.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "several")
    reps = join_counted(merged, several, ["gram"], "kinds").select("gram", "kinds", "rep.doc", "rep.at", "rep.first", "rep.last")
    wanted, p_wanted = written(reps, "wanted")
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("gram", "kinds", "at", "first", "last")).alias("w"))
    n_wanted = wanted.count()
    pieces = docs.select(F.col("doc"), "text").join(F.broadcast(per_doc) if n_wanted <= broadcast_rows else per_doc, "doc")

    def cut(text: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for t, rows in zip(text, w, strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            out.append([raw[r["first"] : r["last"] + length] for r in rows])
        return pd.Series(out)

    withbytes = pieces.select("doc", F.arrays_zip(F.col("w"), F.pandas_udf(cut, "array<binary>")("text", "w").alias("bytes")).alias("z")).select("doc", F.inline("z"))
    # anchors with few candidates share a bucket; those with many are dealt out in chunks
    buckets = max(1, n_wanted // bucket_rows)
    chunks = F.ceil(F.col("w.kinds") / chunk_rows)
    bucket = F.pmod(F.xxhash64("w.gram", F.pmod(F.xxhash64("doc", "w.at"), chunks)), F.lit(buckets))
    dealt = withbytes.select("w.gram", "doc", "w.at", "w.first", "bytes", (chunks > 1).alias("split"), bucket.alias("bucket"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gram", "doc", "at", "first"], kind="stable")
        out = [f for part in _portions(pdf["gram"].to_numpy(), pdf["at"].to_numpy(), pdf["first"].to_numpy(), pdf["bytes"].str.len().to_numpy() - length + 1) for f in _matches(pdf, *part, length, keep_first)]
        got = pd.concat(out) if out else pd.DataFrame({"doc": [], "s": [], "e": [], "digest": []})
        del out, pdf
        release()
        return got

    local, p_local = written(dealt.groupBy("bucket").applyInPandas(match, "doc long, s int, e int, digest binary"), "local")
    inside = local.filter("digest is null").select("doc", "s", "e")
    across = local.filter("digest is not null")
    shared, p_shared = written(across.groupBy("digest").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("doc", "s")).alias("f")).filter("k > 1"), "shared")
    crossed = join_counted(across, shared, ["digest"], "k")
    if keep_first:
        crossed = crossed.filter("doc <> f.doc or s <> f.s")
    spans = whole.unionByName(inside).unionByName(crossed.select("doc", "s", "e"))
    made = []
    if words:
        short, made = _short_runs(docs, words, length, keep_first, broadcast_rows)
        spans = spans.unionByName(short)
    out, _ = written(spans.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans")).select("doc", _united(F.col("spans")).alias("spans")), "spans")
    drop(spark, p_again, p_merged, p_twice, p_several, p_wanted, p_local, p_shared, *made)
    return out


def _short_runs(docs: DataFrame, words: int, length: int, keep_first: bool, broadcast_rows: int) -> tuple[DataFrame, list[str]]:
    """``doc, s, e`` of repeated runs of ``words`` words (between ASCII white
    space) under ``length`` bytes, which no string of that length can find.

    As with bytes: the anchor of a run is the gram of a quarter of its words with the
    least hash; runs that share an anchor are one candidate; candidates whose
    gram is nowhere else are done, those with equal bytes are one, and only
    the runs of the rest are compared one by one."""
    gram = max(1, words // 4)  # short grams anchor longer candidates, so that there are fewer

    def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        c = np.frombuffer(raw, np.uint8)
        turns = np.diff(np.concatenate([[0], ((c != 32) & ((c < 9) | (c > 13))).view(np.int8), [0]]))
        return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)

    def anchors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            cols: list[list] = [[], [], [], []]
            digests: list[bytes] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                s, e = word_spans(raw)
                n = len(s) - words + 1
                if n < 1 or not (short := e[words - 1 :] - s[:n] < length).any():
                    continue
                h = shingle_hashes(word_hashes(raw.split()), gram)
                anchor = sliding_argmin(h, words - gram + 1)
                first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
                some = np.logical_or.reduceat(short, first)
                last = np.append(first[1:] - 1, n - 1)[some]
                first = first[some]
                lo, hi = s[first], e[last + words - 1]
                for c, v in zip(cols, (h[anchor[first]].view(np.int64), np.full(len(first), doc), lo, hi), strict=True):
                    c.append(v)
                digests += [hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
            if digests:
                kinds = [np.int64, np.int64, np.int32, np.int32]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds, strict=True)), pa.array(digests, pa.binary())], names=["gram", "doc", "s", "e", "same"])
        release()

    def runs_of(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, w in zip(text, spans, strict=True):
            raw, rows = t.encode("utf-8", "surrogatepass"), []
            for x in w:
                s, e = word_spans(raw[x["s"] : x["e"]])
                for i, j in zip(s[: len(s) - words + 1].tolist(), e[words - 1 :].tolist(), strict=True):
                    if j - i < length:
                        at = x["s"] + i
                        rows.append({"s": at, "e": x["s"] + j, "digest": hashlib.blake2b(raw[at : x["s"] + j], digest_size=16).digest()})
            out.append(rows)
        return pd.Series(out)

    found, p_found = written(docs.select("doc", "text").mapInArrow(anchors, "gram long, doc long, s int, e int, same binary"), "run-anchors")
    often, p_often = written(found.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "run-grams")
    again, p_again = written(join_counted(found, often, ["gram"], "c").drop("c"), "runs")
    merged, p_merged = written(again.groupBy("gram", "same").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "s", "e")).alias("rep")), "run-kinds")
    twice = merged.filter("n > 1").select("gram", "same", "n", F.col("rep.doc").alias("r_doc"), F.col("rep.s").alias("r_s"))
    whole = join_counted(again, twice, ["gram", "same"], "n")
    if keep_first:
        whole = whole.filter("doc <> r_doc or s <> r_s")
    several, p_several = written(merged.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "run-several")
    wanted, p_wanted = written(join_counted(merged, several, ["gram"], "kinds").select("rep.doc", "rep.s", "rep.e"), "run-wanted")
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("w"))
    texts = docs.select("doc", "text").join(F.broadcast(per_doc) if wanted.count() <= broadcast_rows else per_doc, "doc")
    each = texts.select("doc", F.explode(F.pandas_udf(runs_of, "array<struct<s:int,e:int,digest:binary>>")("text", "w")).alias("r")).select("doc", "r.*")
    each, p_each = written(each.distinct(), "run-each")
    shared, p_shared = written(each.groupBy("digest").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("doc", "s")).alias("f")).filter("k > 1"), "run-shared")
    crossed = join_counted(each, shared, ["digest"], "k")
    if keep_first:
        crossed = crossed.filter("doc <> f.doc or s <> f.s")
    short, p_short = written(whole.select("doc", "s", "e").unionByName(crossed.select("doc", "s", "e")), "short")
    drop(docs.sparkSession, p_found, p_often, p_again, p_merged, p_several, p_wanted, p_each, p_shared)
    return short, [p_short]


def _united(spans: Column) -> Column:
    """Overlapping or touching spans joined, from spans sorted by start."""
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    done = F.aggregate(
        spans,
        F.struct(none.alias("out"), F.lit(-1).alias("s"), F.lit(-1).alias("e")),
        lambda a, x: F.when(x["s"] <= a["e"], F.struct(a["out"].alias("out"), a["s"].alias("s"), F.greatest(a["e"], x["e"]).alias("e"))).otherwise(
            F.struct(F.when(a["e"] < 0, a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).alias("out"), x["s"].alias("s"), x["e"].alias("e"))
        ),
        lambda a: F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))),
    )
    return done


def _kept(text: str | None, spans) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if spans is None or not len(spans):
        return raw
    out, at = [], 0
    for x in spans:
        out.append(raw[at : x["s"]])
        at = x["e"]
    return b"".join([*out, raw[at:]])


KEY = "__sv_doc"


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a unique long KEY in the order of ids: the id itself where
    ids are unique; else rows are numbered, in a written copy."""
    seen = docs.groupBy(id_col).count().agg(F.max("count").alias("most"), F.count(F.when(F.col(id_col).isNull(), 1)).alias("nulls")).first()
    if (seen["most"] or 0) <= 1 and not seen["nulls"]:
        return docs.withColumn(KEY, F.col(id_col).cast("long"))
    return written(docs.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(text_col)).withColumn(KEY, F.monotonically_increasing_id()), "keyed")[0]


def _with_spans(docs: DataFrame, length: int, keep_first: bool, id_col: str, text_col: str, more: dict) -> DataFrame:
    d = with_key(docs, id_col, text_col)
    spans = repeated_spans(d.select(F.col(KEY).alias("doc"), F.col(text_col).alias("text")), length, keep_first, **more)
    spans = spans.select(F.col("doc").alias(KEY), F.col("spans").alias("__sv_spans"))
    few = (spans.agg(F.sum(F.size("__sv_spans") + 2)).first()[0] or 0) <= more.get("broadcast_rows", 1_000_000)
    return d.join(F.broadcast(spans) if few else spans, KEY, "left")


def remove_repeats(docs: DataFrame, length: int = 400, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row per input row: ``doc_id, text, spans, kept`` (the bytes left).

    Removes every byte of a string of ``length`` bytes that also starts
    elsewhere (``keep_first`` false), or at an earlier place in order of id
    and position (``keep_first`` true). Strings never cross documents and are
    judged on the input. Null or empty text: nothing is removed and ``kept``
    is empty. Very long texts are read whole. Repeated rows count as documents
    of their own; rows without an id come last; ids keep their type. Other
    columns are ignored; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _with_kept(_with_spans(d, length, keep_first, "doc_id", "text", more).withColumnRenamed("__sv_spans", "spans"))


def _with_kept(joined: DataFrame, *more: str) -> DataFrame:
    left = F.pandas_udf(lambda t, s: pd.Series([_kept(a, b) for a, b in zip(t, s, strict=True)], dtype=object), "binary")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return joined.select("doc_id", "text", "spans", *more, F.when(F.col("spans").isNull(), text).otherwise(left(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans"))).alias("kept"))


def remove_and_report(docs: DataFrame, length: int = 400, passage: int = 250, words: int = 51, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """:func:`remove_repeats` with ``keep_first`` false, and ``passages``: the
    spans of strings of ``passage`` bytes (under ``length``), and of runs of
    ``words`` words in fewer, that also start elsewhere; they are reported, not
    removed. Both places of a repeated string of ``length`` bytes lie in
    passages, so only texts with passages are searched for such strings."""
    bound = more.get("broadcast_rows", 1_000_000)
    d = with_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    rows = d.select(F.col(KEY).alias("doc"), "text")
    passages = repeated_spans(rows, passage, False, words=words, **more)
    some = passages.select("doc")
    n = some.count()
    repeats = repeated_spans(rows.join(F.broadcast(some) if n <= bound else some, "doc", "left_semi"), length, False, **more)
    both = passages.withColumnRenamed("spans", "passages").join(repeats, "doc", "left").select(F.col("doc").alias(KEY), "spans", "passages")
    both, _ = written(both, "both")
    few = (both.agg(F.sum(F.size("passages") + F.coalesce(F.size("spans"), F.lit(0)) + 2)).first()[0] or 0) <= bound
    return _with_kept(d.join(F.broadcast(both) if few else both, KEY, "left"), "passages")


def cut_documents(docs: DataFrame, length: int, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` with all its columns, repeats cut from the text. Cuts shrink to
    whole characters; ``n_chars``, if there, follows the new text."""
    joined = _with_spans(docs, length, keep_first, id_col, text_col, more)
    cut = F.pandas_udf(lambda t, s: pd.Series([_kept_text(a, b) for a, b in zip(t, s, strict=True)], dtype=object), "string")
    new = F.when(F.col("__sv_spans").isNull(), F.col(text_col)).otherwise(cut(F.when(F.col("__sv_spans").isNotNull(), F.col(text_col)), F.col("__sv_spans")))
    out = joined.withColumn(text_col, new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__sv_spans").isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _kept_text(text: str | None, spans) -> str | None:
    if text is None or spans is None:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    whole = []
    for x in spans:
        s, e = x["s"], x["e"]
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        whole.append({"s": s, "e": e})
    return _kept(text, whole).decode("utf-8", "surrogatepass")


def covered(spans: Column) -> Column:
    """Bytes in disjoint spans; none for null."""
    return F.aggregate(F.coalesce(spans, F.expr("cast(array() as array<struct<s:int,e:int>>)")), F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])


def digest(result: DataFrame) -> DataFrame:
    """Sizes, number of removed runs, the SHA-256 of the bytes kept, and the
    bytes in repeated passages if they were looked for."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    more = [covered(F.col("passages")).alias("n_passage_bytes")] if "passages" in result.columns else []
    return result.select("doc_id", size.alias("n_bytes"), covered(F.col("spans")).alias("n_removed"), F.when(F.col("spans").isNull(), F.lit(0)).otherwise(F.size("spans")).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), *more)
