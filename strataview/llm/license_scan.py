"""License scan: ordered signature rules behind a keyword gate, all in
DataFrame functions (one pass over the texts, no shuffle, no Python)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .license_rules import rules

#: Fixed values of the contract: phrase words and base labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: What separates words: ASCII that is neither a digit nor (after lower-casing) a letter.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WEIGHT = {3: 1.0, 2: 0.8, 1: 0.5}


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words_in(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[^ ]+")).cast("long")


def normalise(text: Column) -> Column:
    """``' w1 w2 ... '``: lower-case words, one space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " ")), F.lit(" "))


def _pattern(rule: Column) -> Column:
    return F.concat(F.lit("(?<= )(?:"), rule["rx"], F.lit(")(?= )"))


def _spans(norm: Column, rule: Column) -> Column:
    """All matches of a rule as (start, -end, -priority, label), by characters."""
    pattern = _pattern(rule)

    def fold(parts: Column) -> Column:
        # parts: gap/hit lengths zipped; running offset carries (offset, spans)
        return F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,p:int,label:string>>)").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + F.coalesce(x["hit"], F.lit(0))).alias("at"),
                F.when(x["hit"].isNull(), acc["out"]).otherwise(
                    F.concat(
                        acc["out"],
                        F.array(F.struct((acc["at"] + x["gap"]).alias("s"), (-(acc["at"] + x["gap"] + x["hit"])).alias("e"), (-rule["priority"]).alias("p"), rule["label"].alias("label"))),
                    )
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    gap = F.transform(F.split(norm, pattern, -1), lambda g: F.length(g))
    hit = F.transform(F.regexp_extract_all(norm, pattern, F.lit(0)), lambda h: F.length(h))
    return _bind(F.arrays_zip(gap.alias("gap"), hit.alias("hit")), lambda z: fold(F.transform(z, lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit")))))


def _resolve(found: Column) -> Column:
    """Sweep detections by start: one is suppressed if an interval that
    contains it was seen whose priority is as high or higher (for equal
    intervals: the higher priority, then the smaller label, stays)."""
    start = F.struct(
        F.lit(-1).alias("e1"), F.lit(-1).alias("e2"), F.lit(-1).alias("e3"), F.lit(0).alias("top"), F.lit(0).alias("n"), F.expr("cast(array() as array<string>)").alias("labels")
    )

    def step(acc: Column, x: Column) -> Column:
        end, p = -x["e"], -x["p"]
        reach = F.when(p == 3, acc["e3"]).when(p == 2, acc["e2"]).otherwise(acc["e1"])
        stays = reach < end
        return F.struct(
            F.greatest(acc["e1"], end).alias("e1"),
            F.when(p >= 2, F.greatest(acc["e2"], end)).otherwise(acc["e2"]).alias("e2"),
            F.when(p >= 3, F.greatest(acc["e3"], end)).otherwise(acc["e3"]).alias("e3"),
            F.when(stays, F.greatest(acc["top"], p)).otherwise(acc["top"]).alias("top"),
            (acc["n"] + stays.cast("int")).alias("n"),
            F.when(stays, F.array_union(acc["labels"], F.array(x["label"]))).otherwise(acc["labels"]).alias("labels"),
        )

    return F.aggregate(F.sort_array(found), start, step)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_base``, ``first_word``,
    ``last_word``, ``base_labels``, ``labels``, ``score``, ``n_detections``.

    Null or empty text: no words, no labels, score 0. Very long texts are read
    whole. Repeated rows and null ids give a row each; ids keep their type;
    other columns are ignored; an empty table gives no rows. Of equal
    detections the smaller label stays.
    """
    table = rules()
    keywords = sorted({k for _, _, k, _ in table})
    gate = f"(?<= )(?:{'|'.join(keywords)})(?= )"
    all_rules = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(p).alias("priority"), F.lit(k).alias("kw"), F.lit(rx).alias("rx")) for a, p, k, rx in table])
    d = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("norm"))
    none = F.expr("cast(null as struct<e1:int,e2:int,e3:int,top:int,n:int,labels:array<string>>)")

    def detect(norm: Column) -> Column:
        kws = F.array_distinct(F.regexp_extract_all(norm, F.lit(gate), F.lit(0)))
        tried = _bind(kws, lambda ks: F.filter(all_rules, lambda r: F.array_contains(ks, r["kw"])))
        hits = F.filter(tried, lambda r: F.rlike(norm, _pattern(r)))
        return _resolve(F.flatten(F.transform(hits, lambda r: _spans(norm, r))))

    norm = F.col("norm")
    wide = F.replace(norm, F.lit(" "), F.lit("  "))
    d = d.withColumn("n_words", F.when(norm == "  ", F.lit(0)).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) - 1).cast("long"))
    d = d.withColumn("found", F.when(norm.rlike(gate), detect(norm)).otherwise(none))
    n, first, last, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in BASE.items():
        words = phrase.split(" ")
        in_wide = f" {'  '.join(words)} "
        there = F.contains(norm, F.lit(f" {phrase} "))
        n = n + F.when(there, ((F.length(wide) - F.length(F.replace(wide, F.lit(in_wide), F.lit("")))) / len(in_wide)).cast("long")).otherwise(F.lit(0))
        first.append(F.when(there, _words_in(F.substring_index(wide, in_wide, 1))))
        last.append(F.when(there, F.col("n_words") - _words_in(F.substring_index(wide, in_wide, -1)) - len(words)))
        labels.append(F.when(there, F.lit(label)))
    base = F.array_compact(F.array(*labels))
    return d.select(
        "doc_id",
        "n_words",
        n.alias("n_base"),
        F.array_min(F.array(*first)).alias("first_word"),
        F.array_max(F.array(*last)).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce(F.col("found.labels"), F.expr("cast(array() as array<string>)")))), ",").alias("labels"),
        F.greatest(
            F.when(F.size(base) > 0, F.lit(WEIGHT[1])).otherwise(F.lit(0.0)),
            F.coalesce(F.when(F.col("found.top") == 3, F.lit(WEIGHT[3])).when(F.col("found.top") == 2, F.lit(WEIGHT[2])).when(F.col("found.top") == 1, F.lit(WEIGHT[1])), F.lit(0.0)),
        ).alias("score"),
        F.coalesce(F.col("found.n"), F.lit(0)).cast("long").alias("n_detections"),
    )
