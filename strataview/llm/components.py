"""Connected components of an edge table.

Large tables go through alternating large and small stars, a few shuffles a
round. A table whose counted edges are within a bound is solved by union-find
in one task instead, which spares the rounds; both give the same roots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


#: Edges that one task may take.
FEW_EDGES = 1_000_000


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their least reachable nodes: labels spread over edges and jump, until none changes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, root[side], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _in_one_task(rows: Iterator) -> Iterator:
    import pyarrow as pa

    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in rows]
    if got:
        nodes, roots = _roots(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, str]:
    """One star step on edges (u, v). Neighbours are never gathered: each node
    needs only its least one, a partial aggregate, and the join back to the
    edges can be split where a node has very many."""
    if large:
        e = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least, path = written(e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = e.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out, p = written(out.filter("u <> v").distinct(), "star")
    drop(edges.sparkSession, path)
    return out, p


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` (the least node reachable) for every node with an edge
    to another. ``edges``: ``u, v`` of type long, any direction, repeats allowed."""
    spark = edges.sparkSession
    cur, path = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if cur.count() <= FEW_EDGES:
        out, _ = written(cur.coalesce(1).mapInArrow(_in_one_task, "node long, root long"), "roots", 100_000)
        drop(spark, path)
        return out
    mark = _mark(cur)
    while True:
        mid, p1 = _star(cur, True)
        nxt, p2 = _star(mid, False)
        drop(spark, path, p1)
        cur, path = nxt, p2
        new = _mark(cur)
        if new == mark:
            break
        mark = new
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
