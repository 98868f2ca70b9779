"""Exact n-gram Jaccard join that returns connected documents.

1. Equal sets are one class (an aggregate; a hot group of copies costs one row).
2. Sets are in hash order. If two sets link, their prefixes of
   ``n - ceil(t n) + l`` shingles share the ``l`` least common ones. Classes
   with too few prefix shingles held by any other class cannot link and are
   dropped; no pair is formed for this.
3. The shingles of the few that are left are counted and put in order from rare
   to common, so that passages many texts share come last. Prefixes of
   ``n - ceil(t n) + 1`` in this order connect classes into clusters, which are
   dealt out in blocks of bounded size.
4. In a block pair an inverted index gives overlaps. Lists are ordered by set
   size, and each search skips the parts of a list whose sizes cannot reach the
   threshold; and a set that differs little from the one before takes that
   one's overlaps, corrected by the lists of the shingles in which they differ.
   Only links that join two parts are passed on.
5. Blocks hold sets of a band of sizes, and sets link only within a band or to
   the next. Each block is compared with itself and with the first of its own
   and the next band; that connects groups of copies. Of all other block pairs
   only those are compared that share a prefix shingle held by sets not
   connected yet, so no link between different texts is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, join_counted, release, small_enough, written
from .components import connected
from .shingles import shingle_hashes, word_hashes

BLOCK = 256


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a whole
    text (A-Z lower-cased, words between ASCII white space); of all words if
    there are fewer than ``k``; nothing without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(word_hashes(words), k))


def _at_least(n, pct: int):
    """Least overlap of a set of ``n`` with any set it links to."""
    return -(-n * pct // 100)


def _extra(n):
    return np.maximum(1, -(-n // 20))


def _sets(docs: DataFrame, k: int, pct: int, whole: bool) -> DataFrame:
    """``doc_id, n, cls`` and the extended prefix of each set (or all of it)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            n, cls, kept, sizes = [], [], [], [0]
            for text in b.column(1).to_pylist():
                s = shingle_set(text, k)
                m = len(s)
                n.append(m)
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if m else None)
                kept.append(s if whole else s[: m - int(_at_least(m, pct)) + int(_extra(m))] if m else s)
                sizes.append(sizes[-1] + len(kept[-1]))
            flat = np.concatenate([*kept, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(cls, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))], names=["doc_id", "n", "cls", "toks"])
        release()

    return docs.mapInArrow(run, "doc_id long, n int, cls binary, toks array<long>")


class Inverted:
    """Inverted lists over ``other``: for each shingle the places of its sets in
    order of size, one sorted run of numbers (list, place). ``read`` counts the
    entries that searches have read."""

    def __init__(self, other: list[np.ndarray]):
        size = np.array([len(s) for s in other])
        self.by_size = np.argsort(size, kind="stable")
        self.sizes = size[self.by_size]
        self.n = len(other)
        rank = np.empty(self.n, np.int64)
        rank[self.by_size] = np.arange(self.n)
        self.names, lists = np.unique(np.concatenate(other), return_inverse=True)
        self.entries = np.sort(lists * self.n + np.repeat(rank, size))
        self.read = 0

    def counts(self, t: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How many of the shingles ``t`` each set at places [lo, hi) has. Of
        each list only that stretch is read: its ends are found by bisection."""
        at = np.searchsorted(self.names, t)
        at = at[(at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == t)] * self.n
        first = np.searchsorted(self.entries, at + lo)
        lens = np.searchsorted(self.entries, at + hi) - first
        some = lens > 0
        at, first, lens = at[some], first[some], lens[some]
        if not len(at):
            return np.zeros(self.n, np.int64)
        total = int(lens.sum())
        self.read += total
        idx = np.repeat(first - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(total)
        return np.bincount(self.entries[idx] - np.repeat(at, lens), minlength=self.n)


def overlaps(sets: list[np.ndarray], other: list[np.ndarray], pct: int, index: Inverted | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``sets``, the places of the sets of ``other`` it links to.

    A search reads, of each inverted list, only the stretch whose sizes can
    link; a set close to the one before it starts from that one's overlaps and
    reads only the lists of the shingles in which the two differ."""
    ix = index or Inverted(other)
    last, got, span = None, None, (0, 0)
    for i in sorted(range(len(sets)), key=lambda j: (len(sets[j]), sets[j].tobytes()[:64])):
        s = sets[i]
        lo = int(np.searchsorted(ix.sizes, _at_least(len(s), pct), "left"))
        hi = int(np.searchsorted(ix.sizes, len(s) * 100 // pct, "right"))
        gone = np.setdiff1d(last, s, assume_unique=True) if last is not None else None
        if gone is not None and span[0] <= lo and hi <= span[1] and len(gone) * 3 < len(s):
            o = got - ix.counts(gone, *span) + ix.counts(np.setdiff1d(s, last, assume_unique=True), *span)
        else:
            # sets come by size: room above for the overlaps to serve the next ones too
            span = (lo, int(np.searchsorted(ix.sizes, len(s) * 110 // pct, "right")))
            o = ix.counts(s, *span)
        last, got = s, o
        hit = np.flatnonzero(100 * o[lo:hi] >= pct * (len(s) + ix.sizes[lo:hi] - o[lo:hi])) + lo
        yield i, ix.by_size[hit]


def _links(pdf: pd.DataFrame, pct: int) -> pd.DataFrame:
    """Links that join parts, within one block (all of side 0) or between its two sides."""
    pdf = pdf.sort_values(["side", "cid"], kind="stable")
    cids = pdf["cid"].to_numpy()
    sets = [np.asarray(t, np.int64).view(np.uint64) for t in pdf["toks"]]
    part = np.unique(pdf["comp"].to_numpy(), return_inverse=True)[1]
    a = np.flatnonzero(pdf["side"].to_numpy() == 0)
    b = np.flatnonzero(pdf["side"].to_numpy() == 1)
    if not len(b):
        b = a
    out = []
    for i, hits in overlaps([sets[j] for j in a], [sets[j] for j in b], pct):
        me = a[i]
        for p in np.unique(part[b[hits]]):
            if p != part[me]:
                to = b[hits][part[b[hits]] == p][0]
                out.append((cids[me], cids[to]))
                part[part == p] = part[me]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _compare(members: DataFrame, pairs: DataFrame, pct: int) -> DataFrame:
    """Compare block pairs (``cluster, left, right, pair``) of ``members`` (``cluster, block, cid, comp, toks``)."""
    cols = ["pair", "side", "cid", "comp", "toks"]
    l = members.join(pairs.select("cluster", F.col("left").alias("block"), "pair"), ["cluster", "block"]).withColumn("side", F.lit(0))
    r = members.join(pairs.filter(F.col("left") != F.col("right")).select("cluster", F.col("right").alias("block"), "pair"), ["cluster", "block"]).withColumn("side", F.lit(1))
    return l.select(*cols).unionByName(r.select(*cols)).groupBy("pair").applyInPandas(lambda p: _links(p, pct), "u long, v long")


def _band(n: Column, pct: int) -> Column:
    """Bands of sizes; sets that link are in one band or in neighbouring ones
    (bands are a little wider than the ratio, so that rounding loses none)."""
    return F.floor(F.log(n.cast("double")) / (math.log(100 / pct) * 1.001 + 1e-6)).cast("int")


def _open_pairs(lists: DataFrame, placed: DataFrame) -> tuple[DataFrame, list[str]]:
    """Block pairs (``cluster, left, right``) that share a shingle of ``lists``
    (``cid, tok``) held by sets of different components. Of shingles held by
    the very same blocks one stands for all, and no set is gathered."""
    held, p_held = written(lists.join(placed.select("cluster", "cid", "comp", "block"), "cid").select("cluster", "tok", "comp", "block"), "open-held")
    hash_of = lambda seed: F.xxhash64(F.lit(seed), "block")
    of_tok = held.groupBy("cluster", "tok", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    by_tok = of_tok.groupBy("cluster", "tok").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_xor(hash_of("x")).alias("x"), F.bit_xor(hash_of("y")).alias("y"), F.count(F.lit(1)).alias("c"))
    chosen = by_tok.filter("lo < hi").groupBy("cluster", "x", "y", "c").agg(F.min("tok").alias("tok")).select("cluster", "tok")
    held, p_kept = written(held.select("cluster", "tok", "block").distinct().join(chosen, ["cluster", "tok"]), "open-blocks")
    both = held.select("cluster", "tok", F.col("block").alias("left")).join(held.select("cluster", "tok", F.col("block").alias("right")), ["cluster", "tok"])
    can = (F.col("left") <= F.col("right")) & (F.abs(F.col("left.band") - F.col("right.band")) <= 1) & ((F.col("left.part") != F.col("right.part")) | (F.col("left.part") == -1))
    return both.filter(can).select("cluster", "left", "right").distinct(), [p_held, p_kept]


def link_documents(docs: DataFrame, k: int = 4, pct: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, class_key``.

    Two texts link if ``100 * |intersection| >= pct * |union|`` of their
    shingle sets. ``component_id`` is the smallest id reachable by links. Null
    texts and texts without words have no shingles and link with nothing (their
    component is their own id). Very long texts are read whole. Repeated rows
    are copies. Rows without an id take part; their component is the smallest
    id of those they are linked with, or null. Ids are cast to long (what is no
    number is null). Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, p_rows = written(_sets(d, k, pct, False), "sets")
    classes = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("toks").alias("toks"), F.count(F.lit(1)).alias("rows"))
    classes, p_classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    slim, _ = written(rows.select("doc_id", "n", "cls"), "rows")
    drop(spark, p_rows)

    # classes that share enough of their prefix with any others, twice over
    need: Column = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * pct / 100) / 20))
    live, made = classes.select("cid", "n", F.explode("toks").alias("tok")), []
    for _ in range(2):
        common, p = written(live.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "common")
        held, p1 = written(join_counted(live, common, ["tok"], "c").drop("c"), "held")
        able, p2 = written(held.groupBy("cid").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).filter(F.col("c") >= need).select("cid"), "able")
        live = held.join(able, "cid", "left_semi")
        made += [p, p1, p2]
    few, p_few = written(able.join(classes.select("cid", "cls", "rep", "n"), "cid"), "few")

    # whole sets of those
    ids = few.filter("rep is not null").select(F.col("rep").alias("doc_id"))
    again = d.join(F.broadcast(ids) if small_enough(ids, 1_000_000) else ids, "doc_id", "left_semi").unionByName(d.filter("doc_id is null"))
    full = _sets(again, k, pct, True).filter("n > 0").select("cls", "toks").join(few.select("cls", "cid", "n"), "cls").dropDuplicates(["cid"])
    full, p_full = written(full.select("cid", "n", "toks"), "full")

    # shingles from rare to common; a class with too few that any other holds is out
    each = full.select("cid", "n", F.explode("toks").alias("tok"))
    often, p_often = written(each.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "often")
    ranked, p_ranked = written(join_counted(each, often, ["tok"], "c", "left").select("cid", "n", "tok", F.coalesce("c", F.lit(1)).alias("c")), "ranked")
    least = F.ceil(F.col("n") * pct / 100)
    full = ranked.groupBy("cid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("t")).filter(F.size(F.filter("t", lambda x: x["c"] > 1)) >= least)
    full, p_ordered = written(full.select("cid", "n", F.transform("t", lambda x: x["tok"]).alias("toks")), "ordered")
    drop(spark, p_full, p_often, p_ranked)

    prefix = F.slice("toks", 1, (F.col("n") - least + 1).cast("int"))
    lists, p_lists = written(full.select("cid", F.explode(prefix).alias("tok")), "lists")
    heads, p_heads = written(lists.groupBy("tok").agg(F.min("cid").alias("v"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "heads")
    cluster = connected(join_counted(lists, heads, ["tok"], "c").select(F.col("cid").alias("u"), "v"))
    cluster, p_cluster = written(cluster.select(F.col("node").alias("cid"), F.col("root").alias("cluster")), "clusters")
    totals, p_totals = written(cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("total")), "totals")
    band = F.when(F.col("total") > BLOCK, _band(F.size("toks"), pct)).otherwise(F.lit(0))  # what fits one block needs no bands
    inside = cluster.join(totals, "cluster").join(full.select("cid", "toks"), "cid").select("cluster", "cid", "toks", band.alias("band"))
    sizes, p_sizes = written(inside.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "sizes")
    block = F.struct("band", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("i"))
    members, p_members = written(inside.join(sizes, ["cluster", "band"]).select("cluster", block.alias("block"), "band", "cid", F.col("cid").alias("comp"), "toks"), "members")

    # first each block with itself and with the first blocks of its band and the one before
    one = sizes.select("cluster", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select("cluster", "band", "i", F.struct("band", "i").alias("right"))
    lead = F.struct(F.col("band"), F.lit(0).alias("i"))
    below = one.select("cluster", (F.col("band") - 1).alias("band"), "right").join(sizes.select("cluster", "band"), ["cluster", "band"])
    pairs = one.select("cluster", F.col("right").alias("left"), "right").unionByName(one.filter("i > 0").select("cluster", lead.alias("left"), "right")).unionByName(below.select("cluster", lead.alias("left"), "right"))
    links, p_links = written(_compare(members, pairs.withColumn("pair", F.to_json(F.struct("cluster", "left", "right"))), pct), "links")
    paths = [*made, p_few, p_lists, p_heads, p_cluster, p_totals, p_sizes]

    # then what is not connected yet, in clusters of several blocks
    several = sizes.groupBy("cluster").agg(F.sum("blocks").alias("b")).filter("b > 1").select("cluster")
    if several.limit(1).count():
        comp, p_comp = written(connected(links), "comp")
        m = members.join(several, "cluster", "left_semi").join(comp, members["cid"] == comp["node"], "left").select("cluster", "band", "cid", F.coalesce("root", "cid").alias("comp"), "toks")
        grouped, p_grouped = written(m.groupBy("cluster", "band", "comp").agg(F.count(F.lit(1)).alias("c")), "grouped")
        own = grouped.withColumn("part", F.when(F.col("c") >= BLOCK, F.col("comp")).otherwise(F.lit(-1)))
        part, p_part = written(own.groupBy("cluster", "band", "part").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks")), "parts")
        placed = m.join(own.select("cluster", "band", "comp", "part"), ["cluster", "band", "comp"]).join(part, ["cluster", "band", "part"])
        placed, p_placed = written(placed.select("cluster", F.struct("part", "band", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("i")).alias("block"), "cid", "comp", "toks"), "placed")
        every, p_open = _open_pairs(join_counted(lists, heads.select("tok", "c"), ["tok"], "c").select("cid", "tok"), placed)
        more, p_more = written(_compare(placed, every.withColumn("pair", F.to_json(F.struct("cluster", "left", "right"))), pct), "more")
        links = links.unionByName(more)
        paths += [p_comp, p_grouped, p_part, p_placed, p_more, *p_open]
    comp, p_comp = written(connected(links), "components")
    linked = comp.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    least, p_least = written(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    names = classes.select("cls", "cid", "rep", "rows").join(comp.join(least, "root"), F.col("cid") == F.col("node"), "left")
    names, _ = written(names.select("cls", F.coalesce("component_id", "rep").alias("component_id"), "rows"), "names")
    out = join_counted(slim, names, ["cls"], "rows", "left")
    drop(spark, *paths, p_classes, p_ordered, p_members, p_links, p_comp, p_least)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("cls").alias("class_key"))
