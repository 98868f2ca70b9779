"""Class-based bigram language model (Brown classes by exchange).

1. Texts are encoded in blocks: each document as local word numbers, each block
   with its word list and training counts. Every later pass reads these.
2. The most frequent words of the training part form the head. Their bigram
   counts, over all training text, give a matrix of bounded size, on which the
   exchange algorithm moves words between classes while the likelihood grows.
3. Every other word takes, from all its contexts, the class that its
   neighbours' classes make likeliest: an exchange step with the head fixed.
   Blocks give counts of neighbours' classes, which are summed by word.
4. Words' counts and classes go back to the blocks as block dictionaries (no
   table of all words is ever broadcast), and documents become class sequences.
5. Class transitions are counted over all training documents. A text's score is
   the sum of log10 P(class | class before) + log10 P(word | class), both
   smoothed; the first class follows the end of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, release, semi_by, written
from .labelled import fold

ENCODED = "block long, docs array<long>, held array<boolean>, sizes array<int>, ids binary, words array<binary>, counts array<int>"
#: Rows of a Python batch where rows are words; blocks are bounded by their bytes.
MANY = 10_000


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def encode_blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """One row a block: its documents (``ids``: int32 numbers of words in the
    block, each document's end last; ``sizes`` in tokens), its words, and their
    training counts. A block is one row, so no file split can part it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {}
        rows: list[tuple] = []
        train: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal number, rows, train, size, seq
            n = len(number)
            counts = np.bincount(np.concatenate(train), minlength=n) if train else np.zeros(n, np.int64)
            ids = np.concatenate([r[2] for r in rows]).tobytes()
            one = [(part << 32) + seq, [r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], ids, list(number), counts]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, kinds, strict=True)], names=[re.split("[ <]", f)[0] for f in ENCODED.split(", ")])
            number, rows, train, size, seq = {}, [], [], 0, seq + 1
            return out

        for b in batches:
            for doc, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = [*tokens(text.as_py()), b""]
                for w in words:
                    if w not in number:
                        number[w] = len(number)
                ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                rows.append((doc, held, ids))
                size += len(ids)
                if not held:
                    train.append(ids)
                if size >= block_tokens:
                    yield flush()
        if rows:
            yield flush()
        release()

    return docs.mapInArrow(run, ENCODED)


def _blocks(rows: Iterator) -> Iterator:
    """(block, [(doc, held out, ids)], words, counts) from the encoded table."""
    for b in rows:
        for i in range(b.num_rows):
            block, docs, held, sizes, ids, words, counts = (b.column(c)[i] for c in range(7))
            parts = np.split(np.frombuffer(ids.as_py(), np.int32), np.cumsum(sizes.values.to_numpy())[:-1])
            yield block.as_py(), list(zip(docs.as_py(), held.as_py(), parts, strict=True)), words.values.to_pylist(), counts.values.to_numpy()


def exchange(pair: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Exchange clustering on a matrix of bigram counts: each word in turn moves
    to the class that gains most in sum n(c,d) log n(c,d) - sum n(c) log n(c)
    of both margins, until a round moves nothing."""
    n = len(pair)
    left, right = pair.sum(1), pair.sum(0)
    c = np.arange(n) % classes  # words come by frequency: a class for each of the first, then in turn
    of = np.eye(classes)[c]
    joint = of.T @ pair @ of
    l, r = of.T @ left, of.T @ right

    def xlog(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    for _ in range(rounds):
        moved = 0
        for w in range(n):
            if not left[w] and not right[w]:
                continue
            out = np.bincount(c, pair[w], classes)
            inn = np.bincount(c, pair[:, w], classes)
            me, old = pair[w, w], c[w]
            out[old] -= me
            inn[old] -= me
            # take the word out of its class
            joint[old] -= out
            joint[:, old] -= inn
            joint[old, old] -= me
            l[old] -= left[w]
            r[old] -= right[w]
            diag = np.diag(joint)
            row = xlog(joint + out[None, :]).sum(1) - xlog(joint).sum(1)  # row k gains out
            col = xlog(joint + inn[:, None]).sum(0) - xlog(joint).sum(0)  # column k gains inn
            fix = xlog(diag + out + inn + me) - xlog(diag + out) - xlog(diag + inn) + xlog(diag)
            gain = row + col + fix - (xlog(l + left[w]) - xlog(l)) - (xlog(r + right[w]) - xlog(r))
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            c[w] = new
            joint[new] += out
            joint[:, new] += inn
            joint[new, new] += me
            l[new] += left[w]
            r[new] += right[w]
        if not moved:
            break
    return c


def most_frequent(lists: DataFrame, head: int) -> list[bytes]:
    """The ``head`` words with the largest sums of ``n`` over all blocks (of
    equals the smaller), from ``z array<struct<w,n>>`` per block. Sums of large
    counts alone bound the last one's sum from below; a word that reaches the
    bound has its share of it in some block, and such words are summed whole."""
    each = lambda least: lists.select(F.explode(F.filter("z", lambda x: x["n"] >= least)).alias("x")).select("x.*")
    sums = lambda rows: rows.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(head).collect()
    some = sums(each(4))
    share = -(-some[-1]["n"] // max(1, lists.count())) if len(some) == head else 1
    rows = each(1) if share <= 1 else semi_by(each(1), each(share), "w")
    return [bytes(r["w"]) for r in sums(rows)]


def score_texts(docs: DataFrame, parts: int = 10, held_out: int = 0, classes: int = 48, head: int = 2048, block_tokens: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, perplexity``.

    Null or empty text: the end token alone. Very long texts are read whole (a
    document is never parted between blocks). With no training text all counts
    are zero and every token is unknown; an empty table gives no rows. Repeated
    rows count and are scored each; ids are cast to long (what is no number is
    null); other columns are ignored; of equal counts the smaller word comes first.
    Nothing depends on how rows are partitioned. ``head`` and ``classes`` are sizes of the
    model; counts, classes and transitions come from all training texts.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), parts) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    encoded, p_encoded = written(encode_blocks(d, block_tokens), "encoded")
    lists = encoded.select("block", F.arrays_zip(F.col("words").alias("w"), F.col("counts").alias("n")).alias("z"))

    # the head: the most frequent words of all training text
    top = most_frequent(lists, head)
    rank = {w: i for i, w in enumerate(top)}
    size = max(1, len(top))

    def head_pairs(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((size, size), np.int64) if top else None
        for _, rows, words, _ in _blocks(batches):
            to = np.array([rank.get(w, -1) for w in words] or [-1])
            for _, held, ids in rows:
                if not held and top:
                    r = to[np.concatenate([[len(words) and ids[-1]], ids])]
                    a, b = r[:-1], r[1:]
                    ok = (a >= 0) & (b >= 0)
                    np.add.at(total, (a[ok], b[ok]), 1)
        if top:
            a, b = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], names=["a", "b", "n"])

    pair = np.zeros((size, size))
    summed, p_pairs = written(encoded.mapInArrow(head_pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    pairs = summed.toArrow()  # at most head x head rows
    drop(spark, p_pairs)
    pair[pairs["a"].to_numpy(), pairs["b"].to_numpy()] = pairs["n"].to_numpy()
    cls = exchange(pair, classes) if top else np.zeros(0, np.int64)
    # what a neighbour's class says of a word's class, from the head's transitions
    of = np.eye(classes)[cls] if top else np.zeros((0, classes))
    joint = (of.T @ pair[: len(top), : len(top)] @ of if top else np.zeros((classes, classes))) + 0.5
    after = np.log(joint / joint.sum(0, keepdims=True)).astype(np.float32)  # [before, k]: before's share of what precedes k
    before = np.log(joint / joint.sum(1, keepdims=True)).astype(np.float32).T  # [next, k]: next's share of what follows k

    width = 2 * classes + 1  # a context is a class before or after; the last number counts the word itself

    def contexts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, rows, words, counts in _blocks(batches):
            known = np.array([cls[rank[w]] if w in rank else -1 for w in words])
            some = np.flatnonzero(counts > 0)
            seen = [np.repeat(some * width + 2 * classes, counts[some])]
            for _, held, ids in rows:
                if held:
                    continue
                k = known[ids]
                for side, other in enumerate((np.concatenate([k[-1:], k[:-1]]), np.concatenate([k[1:], [-1]]))):
                    ok = (k < 0) & (other >= 0)
                    seen.append(ids[ok].astype(np.int64) * width + side * classes + other[ok])
            at, m = np.unique(np.concatenate(seen), return_counts=True)
            for i in range(0, len(some), 100_000):
                s = some[i : i + 100_000]
                lo, hi = np.searchsorted(at, [s[0] * width, (s[-1] + 1) * width])
                ends = np.append(np.searchsorted(at[lo:hi], s * width), hi - lo)
                packed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(m[lo:hi] * width + at[lo:hi] % width, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([words[j] for j in s], pa.binary()), packed], names=["w", "m"])
        release()

    tables = np.concatenate([after, before, np.zeros((1, classes), np.float32)]).astype(float)

    def decide(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            words, lists = b.column(0).to_pylist(), b.column(1)
            flat = lists.flatten()
            c, m = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            ends = np.cumsum(lists.value_lengths().to_numpy())
            gain = np.add.reduceat(tables[c] * m[:, None], ends - lists.value_lengths().to_numpy(), axis=0) if len(words) else np.zeros((0, classes))
            k = [int(cls[rank[w]]) if w in rank else int(g) for w, g in zip(words, gain.argmax(1), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m[ends - 1] if len(words) else [], pa.int64()), pa.array(k, pa.int32())], names=["w", "n", "k"])

    # all of a word's counts meet before its class is chosen; sums of whole numbers, in one order
    each = encoded.mapInArrow(contexts, "w binary, m array<long>").repartition("w").select("w", F.explode("m").alias("x"))
    summed = each.groupBy("w", (F.col("x") % width).cast("int").alias("c")).agg(F.sum(F.expr(f"x div {width}")).alias("m"))
    vocabulary = summed.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("c", "m"))).alias("all")).mapInArrow(decide, "w binary, n long, k int")
    vocabulary, p_vocabulary = written(vocabulary, "vocabulary", MANY)
    stats = {r["k"]: (r["n"], r["v"]) for r in vocabulary.groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # one row a class
    in_class = np.array([stats.get(k, (0, 0))[0] for k in range(classes)], float)
    types = np.array([stats.get(k, (0, 0))[1] for k in range(classes)], float)
    total, distinct = int(in_class.sum()), int(types.sum())
    rare = int(np.argmax(types / np.maximum(in_class, 1))) if total else 0  # unseen words belong where new words are likeliest

    # block dictionaries
    word_rows = lists.select("block", F.posexplode("z").alias("i", "x")).select("block", "i", F.col("x.w").alias("w"))
    dictionary = word_rows.join(vocabulary, "w").select(F.col("block").alias("of_block"), "i", "n", "k")
    docs_of = encoded.select("block", "docs", "held", "sizes", "ids")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, emit double, seq binary"

    def look_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        most = int(right["i"].max()) if len(right) else -1
        ids_of = np.frombuffer(left["ids"].iloc[0], np.int32)
        arrays = np.split(ids_of, np.cumsum(left["sizes"].iloc[0])[:-1])
        m = max(most, int(ids_of.max())) + 1
        n, k = np.zeros(m), np.full(m, rare, np.uint8)
        at = right["i"].to_numpy()
        n[at], k[at] = right["n"].to_numpy(), right["k"].to_numpy()
        base, emit = np.log10(n + 0.1), np.log10(n + 0.1)
        out = []
        for doc, held, ids in zip(left["docs"].iloc[0], left["held"].iloc[0], arrays, strict=True):
            out.append((doc, held, len(ids), int((n[ids] > 0).sum()), float(base[ids].sum()), float(emit[ids].sum()), k[ids].tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "base", "emit", "seq"]).astype({"doc_id": "Int64"})

    sequences, p_sequences = written(docs_of.groupBy("block").cogroup(dictionary.groupBy("of_block")).applyInPandas(look_up, schema), "sequences")

    def count_moves(batches: Iterator) -> Iterator:
        import pyarrow as pa

        got = np.zeros(classes * classes, np.int64)
        for b in batches:
            for s in b.column(0).to_pylist():
                k = np.frombuffer(s, np.uint8).astype(np.int64)
                got += np.bincount(np.concatenate([k[-1:], k[:-1]]) * classes + k, minlength=classes * classes)
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(got[at])], names=["at", "n"])

    moves = np.zeros(classes * classes)
    for r in sequences.filter("not held_out").select("seq").mapInArrow(count_moves, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most classes squared rows
        moves[r["at"]] = r["n"]
    moves = moves.reshape(classes, classes)
    prior = (moves.sum(0) + 0.5) / (moves.sum() + 0.5 * classes)
    weight = 5.0
    step = np.log10((moves + weight * prior) / (moves.sum(1, keepdims=True) + weight))
    # P(word | class) = (n + 0.1) / (n(class) + 0.1 * types), with one more type where unseen words belong
    bottom = np.log10(np.maximum(in_class + 0.1 * (types + (np.arange(classes) == rare)), 1e-9))  # the floor is for classes without words
    per = step - bottom[None, :]

    def final(n_tokens: pd.Series, emit: pd.Series, seq: pd.Series) -> pd.Series:
        out = []
        for s in seq:
            k = np.frombuffer(s, np.uint8)
            out.append(per[np.concatenate([k[-1:], k[:-1]]), k].sum())
        return pd.Series(np.array(out, float)) + emit

    score = F.pandas_udf(final, "double")("n_tokens", "emit", "seq")
    base = F.col("base") - F.col("n_tokens") * float(np.log10(total + 0.1 * (distinct + 1)))
    drop(spark, p_encoded, p_vocabulary)
    scored = sequences.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
