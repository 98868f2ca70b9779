"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Filters of
``WIDTH`` bytes run over every position; each is a sum of one table row per
byte (embedding and filter weights multiplied out), so no one-hot input is
ever built. Activations are max-pooled over the chunk, a small dense layer
gives a logit per chunk, and the mean of the logits is the document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, release, written
from .labelled import fold, training_sample

UNIT, UNITS, WIDTH = 64, 8, 6
CHUNK, STEP = UNIT * UNITS, UNIT * (UNITS - 1)
FILTERS, HIDDEN = 24, 12


def padded(raw: bytes) -> tuple[np.ndarray, int]:
    """Bytes with zeros up to whole units, and how many chunks cover them."""
    n = len(raw)
    chunks = 1 if n <= CHUNK else 1 + -(-(n - CHUNK) // STEP)
    units = chunks * (UNITS - 1) + 1
    out = np.zeros(units * UNIT, np.uint8)
    out[:n] = np.frombuffer(raw, np.uint8)
    return out, chunks


class ByteCnn:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "t": (rng.normal(0, 0.3, (WIDTH, 256, FILTERS))).astype(f),
            "b": np.zeros(FILTERS, f),
            "w1": rng.normal(0, 0.3, (FILTERS + 1, HIDDEN)).astype(f),
            "b1": np.zeros(HIDDEN, f),
            "w2": rng.normal(0, 0.3, HIDDEN).astype(f),
            "b2": np.zeros(1, f),
        }

    def conv(self, flat: np.ndarray) -> np.ndarray:
        """Filter outputs at each position of ``flat`` but the last WIDTH - 1."""
        n = len(flat) - WIDTH + 1
        t = self.p["t"]
        out = t[0].take(flat[:n], axis=0)
        for k in range(1, WIDTH):
            out += t[k].take(flat[k : k + n], axis=0)
        return out

    def pooled(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Max-pooled filters of every chunk, the share of each chunk that is text, and each chunk's document."""
        feats, fill, owner = [], [], []
        for d, raw in enumerate(docs):
            flat, chunks = padded(raw)
            tail = np.zeros(WIDTH - 1, np.uint8)
            tops = []
            for at in range(0, len(flat), 256 * UNIT):  # blocks that stay in cache
                block = flat[at : at + 256 * UNIT + WIDTH - 1]
                if at + 256 * UNIT >= len(flat):
                    block = np.concatenate([flat[at:], tail])
                tops.append(self.conv(block).reshape(-1, UNIT, FILTERS).max(axis=1))
            units = np.concatenate(tops)
            first = np.arange(chunks) * (UNITS - 1)
            feats.append(np.maximum.reduce([units[first + u] for u in range(UNITS)]))
            fill.append(np.clip((len(raw) - first * UNIT) / CHUNK, 0, 1))
            owner.append(np.full(chunks, d))
        return np.concatenate(feats) + self.p["b"], np.concatenate(fill).astype(np.float32), np.concatenate(owner)

    def head(self, top: np.ndarray, fill: np.ndarray) -> np.ndarray:
        a = np.concatenate([np.maximum(top, 0), fill[:, None]], axis=1)
        return np.maximum(a @ self.p["w1"] + self.p["b1"], 0) @ self.p["w2"] + self.p["b2"]

    def score(self, docs: list[bytes]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        top, fill, owner = self.pooled(docs)
        z = np.bincount(owner, self.head(top, fill)) / np.bincount(owner)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, chunks: np.ndarray, fill: np.ndarray, owner: np.ndarray, y: np.ndarray, epochs: int = 20, batch: int = 64, rate: float = 0.006, seed: int = 3) -> ByteCnn:
        """Adam on the logistic loss of documents. ``chunks``: rows of CHUNK bytes, sorted by ``owner`` (0..len(y)-1)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        start = np.searchsorted(owner, np.arange(len(y) + 1))
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) ** 0.5  # half-way to balanced classes
        step = 0
        for epoch in range(epochs):
            lr = rate * (1 - epoch / epochs)
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                ids = order[at : at + batch]
                rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in ids])
                size = start[ids + 1] - start[ids]
                own = np.repeat(np.arange(len(ids)), size)
                x = chunks[rows]
                wide = np.concatenate([x, np.zeros((len(x), WIDTH - 1), np.uint8)], axis=1)
                out = self.p["t"][0].take(wide[:, :CHUNK], axis=0)
                for k in range(1, WIDTH):
                    out += self.p["t"][k].take(wide[:, k : k + CHUNK], axis=0)
                where = out.argmax(axis=1)  # chunks x filters
                top = np.take_along_axis(out, where[:, None, :], axis=1)[:, 0, :] + self.p["b"]
                a = np.concatenate([np.maximum(top, 0), fill[rows][:, None]], axis=1)
                h = a @ self.p["w1"] + self.p["b1"]
                hr = np.maximum(h, 0)
                z = np.bincount(own, hr @ self.p["w2"] + self.p["b2"]) / size
                gz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[ids]) * weight[ids] / len(ids) / size)[own].astype(np.float32)
                g = {"w2": hr.T @ gz, "b2": gz.sum(keepdims=True)}
                gh = gz[:, None] * self.p["w2"] * (h > 0)
                g["w1"], g["b1"] = a.T @ gh, gh.sum(0)
                gt = (gh @ self.p["w1"].T)[:, :-1] * (top > 0)
                g["b"] = gt.sum(0)
                g["t"] = np.zeros_like(self.p["t"])
                for k in range(WIDTH):
                    at_byte = np.take_along_axis(wide, where + k, axis=1)
                    np.add.at(g["t"][k], (at_byte, np.arange(FILTERS)), gt)
                step += 1
                for key, grad in g.items():
                    m[key] = 0.9 * m[key] + 0.1 * grad
                    v[key] = 0.999 * v[key] + 0.001 * grad**2
                    self.p[key] = (self.p[key] - lr * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held_out: int = 2, sample_rows: int = 8_000, row_bytes: int = 1 << 12, sample_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> ByteCnn | None:
    """Fit on every chunk of at most ``sample_rows`` labelled texts, of at most
    ``row_bytes`` bytes each and ``sample_bytes`` in all (bounds on which rows
    are in the sample, none on what is read of a row; scoring has no bound).
    None without labels of both kinds."""
    sample, path = written(training_sample(docs, labels, label, parts, held_out, sample_rows, id_col, text_col), "quality-sample")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = sample.select("spot", raw.alias("raw"), "label", F.octet_length(raw).alias("size"), F.xxhash64(raw).alias("at")).filter(F.col("size") <= row_bytes)
    lines = sized.groupBy("spot").agg(F.sum("size").alias("size")).orderBy("spot").collect()  # at most 1,000 rows
    end = next((r["spot"] for r, total in zip(lines, np.cumsum([r["size"] for r in lines]), strict=True) if total > sample_bytes), 1000)
    got = sized.filter(F.col("spot") < end).orderBy("spot", "at", "label").select("raw", "label").toPandas()  # one order, one fit
    drop(docs.sparkSession, path)
    if not len(got) or got["label"].nunique() < 2:
        return None
    chunks, fill, owner = [], [], []
    for d, text in enumerate(got["raw"]):
        flat, n = padded(bytes(text))
        chunks.append(np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::STEP][:n])
        fill.append(np.clip((len(text) - np.arange(n) * STEP) / CHUNK, 0, 1))
        owner.append(np.full(n, d))
    return ByteCnn().fit(np.concatenate(chunks), np.concatenate(fill).astype(np.float32), np.concatenate(owner), got["label"].to_numpy().astype(float))


def quality_score(text: Column, model: ByteCnn | None) -> Column:
    """The model's probability of label 1 for a text column (1 without a model)."""

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            if model is None:
                yield pd.Series(np.ones(len(texts)))
            else:
                yield pd.Series([model.score([(t or "").encode("utf-8", "replace")])[0] for t in texts], dtype=float)
        release()

    return F.pandas_udf(score, "double")(text)


def score_quality(docs: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Only the text is an input; null and empty texts are scored as one chunk of
    padding; chunks cover all bytes of very long ones. Without labels of both
    kinds every score is 1. Repeated rows give a row each; ids keep their type;
    other columns are ignored; an empty table gives no rows.
    """
    model = train(docs, labels, "quality", parts, held_out, id_col=id_col, text_col=text_col, **more)
    s = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), parts) == held_out).alias("held_out"), quality_score(F.col(text_col), model).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
