"""Toxicity: boosted trees over dense features of whole texts, calibrated.

Features: densities and counts of a lexicon (a short stated list, and words
and word beginnings learned from training rows), hits near a second-person word, capitals,
punctuation, and obfuscated spellings. The sample of labelled rows is bounded
and split three ways: lexicon, trees, calibration.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Isotonic
from .common import drop, release, written
from .labelled import fold, training_sample

#: A stated start of the lexicon; the rest is learned.
INSULTS = frozenset("idiot idiots stupid moron morons dumb fool scum trash worthless pathetic loser losers disgusting vermin hate kill die shut".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "(": "c", "€": "e"})
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\s,;:?\"]+")
MARK = re.compile(r"[0-9@$!|+(*_\-€]")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
ALNUM = re.compile(r"[^\W_]")
RUN = re.compile(r"(.)\1{2,}")
NEAR = 5
PREFIXES = (4, 5, 6, 7)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def terms_of(words: list[str]) -> set[str]:
    """Words of a text, and their beginnings marked with ``^`` (insults inflect)."""
    distinct = {w for w in words if len(w) > 1}
    return distinct | {f"^{w[:k]}" for w in distinct for k in PREFIXES if len(w) > k}


class Lexicon(dict):
    """Term weights; :meth:`weight` finds a word or its longest known beginning."""

    def __init__(self, terms: dict[str, float]):
        super().__init__(terms)
        self.starts = frozenset(t[1 : 1 + PREFIXES[0]] for t in terms if t[0] == "^")

    def weight(self, w: str) -> float:
        got = self.get(w, 0.0)
        if w[: PREFIXES[0]] in self.starts:
            got = max([got, *(self.get(f"^{w[:k]}", 0.0) for k in PREFIXES if len(w) > k)])
        return got


def mixed_in(text: str) -> list[str]:
    """Tokens, from their first letter or digit on, that hold a letter and,
    within, a mark or digit. Each character is looked at a fixed number of times."""
    found = []
    for t in TOKEN.findall(text):
        if MARK.search(t) and (first := ALNUM.search(t)) and WORD.search(t):
            t = t[first.start() :]
            mark = MARK.search(t, 1)
            if mark and ALNUM.search(t, mark.end()):
                found.append(t)
    return found


def plain(word: str) -> str:
    """A disguised spelling undone: look-alikes, inner marks and stretched letters."""
    return RUN.sub(r"\1", re.sub(r"[^\w]|[\d_]", "", word.lower().translate(LEET)))


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Dense features of one whole text; null is the empty text."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    starts, size4 = lexicon.starts, PREFIXES[0]
    maybe = [i for i, w in enumerate(words) if w in lexicon or w[:size4] in starts]
    scored = [(i, x) for i in maybe if (x := lexicon.weight(words[i]))]
    hits, weights = [i for i, _ in scored], [x for _, x in scored]
    listed = sum(words[i] in INSULTS for i in hits)
    near = 0
    for i in hits:
        near += any(w in SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1])
    mixed = mixed_in(text)
    hidden = [p for p in map(plain, mixed) if p in lexicon]
    hidden += [p for p in map(plain, SPACED.findall(text)) if p in lexicon]
    hidden += [p for p in (RUN.sub(r"\1", w) for w in words if RUN.search(w)) if p in lexicon]
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    caps, small = int(counts[65:91].sum()), int(counts[97:123].sum())
    size = max(1, len(raw))
    per = max(1, n)
    ws = sorted(weights + [lexicon[p] for p in hidden], reverse=True)
    return [
        sum(ws),
        sum(ws) / per * 100,
        float(len(ws)),
        len(ws) / per * 100,
        ws[0] if ws else 0.0,
        ws[1] if len(ws) > 1 else 0.0,
        ws[2] if len(ws) > 2 else 0.0,
        float(len({words[i] for i in hits})),
        float(listed),
        float(near),
        near / per * 100,
        float(len(hidden)),
        len(mixed) / per,
        caps / max(1, caps + small),
        int(counts[33]) / size,
        int(counts[63]) / size,
        int(counts[[35, 36, 37, 38, 42, 64]].sum()) / size,
        sum(w in SECOND for w in words) / per,
        float(np.log1p(n)),
    ]


def learn_lexicon(sample: DataFrame, most: int, least_docs: int) -> dict[str, float]:
    """Words far likelier in documents labelled 1, by log odds of document
    frequency; counts are summed before and after the shuffle, and at most
    ``most`` words reach the driver."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        bad: Counter = Counter()
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = terms_of(words_of(text or ""))
                seen.update(got)
                if label:
                    bad.update(got)
        words = list(seen)
        for i in range(0, len(words), 50_000):
            ws = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([bad[w] for w in ws], pa.int64()), pa.array([seen[w] for w in ws], pa.int64())], names=["w", "bad", "n"])

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    t, c = sizes.get(1, 0), sizes.get(0, 0)
    if not t or not c:
        return {}
    words = sample.select("text", "label").mapInArrow(run, "w string, bad long, n long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).filter(F.col("bad") >= least_docs)
    odds = F.log((F.col("bad") + 0.5) / (t + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (c + 1.0))
    top = words.select("w", odds.alias("odds")).filter("odds > 0.9").orderBy(F.desc("odds"), "w").limit(most).collect()
    return {r["w"]: float(r["odds"]) for r in top}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, held_out: int = 1, sample_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text"):
    """Lexicon, trees and calibration from at most ``sample_rows`` labelled rows; None without any of both labels."""
    sample, path = written(training_sample(docs, labels, label, parts, held_out, sample_rows, id_col, text_col), "toxicity-sample")
    learned = learn_lexicon(sample.filter("spot < 450"), 400, 5)
    lexicon = Lexicon({w: 1.0 for w in INSULTS} | learned)

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            yield pd.DataFrame({"x": [features(t, lexicon) for t in b["text"]], "label": b["label"], "spot": b["spot"]})

    got = sample.filter("spot >= 450").mapInPandas(run, "x array<double>, label int, spot int").toPandas()
    drop(docs.sparkSession, path)
    if not len(got) or got["label"].nunique() < 2:
        return None
    x, y, late = np.stack(got["x"].to_numpy()), got["label"].to_numpy().astype(float), got["spot"].to_numpy() >= 800
    if len(set(y[~late])) < 2 or not late.any():
        late[:] = False
    trees = BoostedTrees().fit(x[~late], y[~late])
    hold = late if late.any() else ~late
    return lexicon, trees, Isotonic().fit(trees.raw(x[hold]), y[hold])


def score_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Only the text is an input of the score; null and empty texts are scored
    like any other; very long texts, and tokens, are read whole, in time linear
    in their length. Without labels of both kinds the score is 0. Repeated rows
    give a row each; ids keep their type; other columns are ignored; an empty
    table gives no rows.
    """
    model = fit(docs, labels, "toxic", parts, held_out, id_col=id_col, text_col=text_col, **more)

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in parts:
            if model is None or not len(text):
                yield pd.Series(np.zeros(len(text)))
            else:
                lexicon, trees, calibrated = model
                yield pd.Series(np.clip(calibrated(trees.raw(np.array([features(t, lexicon) for t in text]))), 0, 1))
        release()

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    s = d.select("doc_id", (fold(F.col("doc_id"), parts) == held_out).alias("held_out"), F.pandas_udf(score, "double")("text").alias("score"))
    return s.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
