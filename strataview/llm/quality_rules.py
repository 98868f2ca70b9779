"""Quality rules as a short-circuit cascade, all in DataFrame functions.

Base statistics are computed for every text. The method's own rules follow as
one ``CASE`` chain: Spark evaluates a branch only if no earlier one fired, so
their order is the cost. The order is by rejections per unit of cost, both
measured on a bounded sample; it never changes a verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

WORD = f"[^{SPACE}]+"
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def _bind(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows found twice or more, first included.

    Windows are hashed; texts whose hashes are all different have none. In the
    rest the windows themselves are compared: sorted by content with their
    places, equal neighbours mark repeats, and the marked places' windows are
    united from left to right.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))

    def exact(ws: Column) -> Column:
        keyed = F.sort_array(F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice(ws, i, WINDOW), " ").alias("w"), i.alias("i"))))

        def marked(k: Column) -> Column:
            last = F.size(k) - 1
            twice = lambda x, j: ((j > 0) & (F.get(k, j - 1)["w"] == x["w"])) | ((j < last) & (F.get(k, j + 1)["w"] == x["w"]))
            return F.sort_array(F.transform(F.filter(k, twice), lambda x: x["i"]))

        return F.aggregate(
            _bind(keyed, marked),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
            lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["sum"] + i + WINDOW - F.greatest(acc["end"], i)).alias("sum")),
            lambda acc: acc["sum"],
        )

    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    some = _bind(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n <= WINDOW, F.lit(0)).when(some, _bind(words, exact)).otherwise(F.lit(0)).cast("long")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[], Column]
    sql: str


def rules() -> list[Rule]:
    """The method's rules over ``body`` (the text, null as empty), ``lines`` (lines with a word) and base statistics.
    ``sql`` is the same test in DuckDB, over the same names."""
    n, body = lambda: F.col("n_words"), lambda: F.col("body")  # noqa: E731  (columns need a session; the table does not)
    count = lambda pattern: F.regexp_count(body(), F.lit(pattern))
    return [
        Rule("mean_word_length", lambda: (F.col("word_chars") < 2 * n()) | (F.col("word_chars") > 20 * n()), "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
        Rule("symbols", lambda: 10 * F.col("n_symbols") > 3 * n(), "10 * n_symbols > 3 * n_words"),
        Rule("duplicate_lines", lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), "10 * n_dup_lines > 3 * n_lines"),
        Rule("capitals", lambda: 2 * F.length(F.regexp_replace(body(), "[^A-Z]", "")) > F.col("word_chars"), "2 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > word_chars"),
        Rule("exclamations", lambda: 10 * (F.length(body()) - F.length(F.translate(body(), "!", ""))) > 5 * n(), "10 * (length(body) - length(replace(body, '!', ''))) > 5 * n_words"),
        Rule("ellipsis_lines", lambda: 10 * count("\\.\\.\\.[ \\t\\r]*(?:\\n|\\z)") > 3 * F.col("n_lines"), "10 * len(regexp_extract_all(body, '\\.\\.\\.[ \\t\\r]*(?:\\n|\\z)')) > 3 * n_lines"),
        Rule("bullet_lines", lambda: 10 * count("(?:^|\\n)[ \\t]*[-*\u2022]") > 9 * F.col("n_lines"), "10 * len(regexp_extract_all(body, '(?:^|\\n)[ \\t]*[-*\u2022]')) > 9 * n_lines"),
        Rule("digits", lambda: 2 * F.length(F.regexp_replace(body(), "[^0-9]", "")) > F.col("word_chars"), "2 * length(regexp_replace(body, '[^0-9]', '', 'g')) > word_chars"),
    ]


def base_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    d = d.withColumn("words", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))
    d = d.withColumn("lines", F.filter(F.split("body", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    n_words = F.size("words").cast("long")
    return d.select(
        "doc_id",
        "body",
        n_words.alias("n_words"),
        F.length(F.regexp_replace("body", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def measure(sample: DataFrame, candidates: list[Rule], repeats: int = 3, least_rows: int = 2_000) -> dict[str, tuple[int, float]]:
    """Rejections on ``sample`` and seconds a row of each rule. A rule is timed
    over the cached sample, read over and over until it makes ``least_rows``
    rows, in one job; the least of several runs counts, less that of a job
    without a rule, so that what a job costs anyway does not hide the rule."""
    held = sample.persist()
    try:
        rejected = held.select(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(r.fails(), 1)).alias(r.name) for r in candidates]).first()
        rows = max(1, rejected["rows"])
        times = -(-least_rows // rows)
        # the round is part of the text, so that no round's result can stand for another's
        often = held.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("body", F.concat(F.col("body"), F.when(F.col("round") < 0, "x").otherwise("")))

        def seconds(test: Column) -> float:
            took = []
            for _ in range(repeats):
                began = time.perf_counter()
                often.agg(F.count(F.when(test, 1))).collect()
                took.append(time.perf_counter() - began)
            return min(took)

        idle = seconds(F.length("body") < 0)
        return {r.name: (rejected[r.name], max(seconds(r.fails()) - idle, 0.0) / (rows * times)) for r in candidates}
    finally:
        held.unpersist()


def plan_order(sample: DataFrame, candidates: list[Rule]) -> list[Rule]:
    """Order rules by rejections per second on ``sample`` (base statistics of a
    few hundred texts); costs under 2 microseconds a row count as 2, the noise of a run."""
    found = measure(sample, candidates)
    return sorted(candidates, key=lambda r: -found[r.name][0] / max(found[r.name][1], 2e-6))


#: A text in the sample that orders the rules is at most so many bytes; the sample is so bounded in bytes.
SAMPLE_BYTES = 1 << 16


def _sample(docs: DataFrame, rows: int, text_col: str) -> DataFrame:
    """The first rows of the first partitions with texts of bounded size: unlike
    a cached ``limit``, this reads no more of the table."""
    got = docs.select(F.col(text_col).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES).limit(rows).collect()
    return docs.sparkSession.createDataFrame([(0, r["text"]) for r in got], "doc_id long, text string").coalesce(1)


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 500) -> DataFrame:
    """One row per input row: ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept``.

    Null or empty text: all zero, ``base_failed``. Very long texts are read
    whole. ``sample_rows`` (and SAMPLE_BYTES a text) bounds the sample that sets
    the order of rules; verdicts do not depend on it. Repeated rows give a row
    each; other columns are ignored; an empty table gives no rows.
    """
    stats = base_stats(docs, id_col, text_col)
    ordered = plan_order(base_stats(_sample(docs, sample_rows, text_col)), rules())
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = F.when(failed, F.lit(False))
    for r in ordered:
        kept = kept.when(r.fails(), F.lit(False))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.otherwise(F.lit(True)).alias("kept"))


def oracle() -> str:
    """The same rows in DuckDB."""
    space = "\\x20\\x09-\\x0D"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT r, doc_id, body, regexp_extract_all(body, '[^{space}]+') AS ws,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') AS t FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, range({WINDOW}) AS o(j) GROUP BY r),
s AS (SELECT w.doc_id, w.body, len(ws)::BIGINT AS n_words, length(regexp_replace(body, '[{space}]+', '', 'g'))::BIGINT AS word_chars,
             (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
      FROM w LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR {' OR '.join(f'({r.sql})' for r in rules())}) AS kept
FROM s"""
