"""The operators against brute force, on small tables with hard cases: nulls,
empty and very long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataview.llm import boosting, byte_cnn, class_model, common, components, decontaminate, jaccard_join, labelled, license_scan, packing, quality_rules, suffix_dedup, token_counts, tokens, toxicity
from strataview.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, spans string, block long, toks string, n int, gram string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}x" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([3, 30, 90, 200])) for _ in range(24)]
    passage = prose(rng, 120)
    near = base[5].split()
    near[len(near) // 2 : len(near) // 2 + 1] = ["changed"]
    out = [*base, base[3], base[3], " ".join(near), base[7] + " " + passage, passage + "\n" + base[8], base[9] + "\n" + base[9], None, "", " \n\t ", "a", "A  b", "né " * 300, "x" * 3000]
    out += ["MIT License. Licensed under the Apache License, Version 2.0", "cc by cc by cc by-nc 4.0", "line one two\nline one two\nother # * $ | line", prose(rng, 15000), "you are an idiot " * 20]
    return [(i, t, "en", "s", 1, None, None, "g") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [*texts, (None, "no id here but words", None, None, None, None, None, None), texts[3], texts[30]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def unique(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, texts):
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0), "x") for i in range(len(texts))] + [(None, 1, 1, "x"), (3, None, None, "x"), (3, 1, 1, "y")], "doc_id long, quality int, toxic int, text string")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def key(v):
    return (v is None, v)


# -- licences ---------------------------------------------------------------------------------------------------------


def test_license_base_against_brute_force(docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = license_scan.scan_licenses(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(r["text"]))
        at, names = [], set()
        for p, label in phrases.items():
            ws = p.split()
            hit = [i for i in range(len(w) - len(ws) + 1) if w[i : i + len(ws)] == ws]
            at += hit
            names |= {label} if hit else set()
        want[r["doc_id"], len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))] += 1
    assert Counter((g["doc_id"], g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) for g in got) == want
    for g in got:
        assert set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1


def test_license_suppression(spark):
    d = spark.createDataFrame([(1, "licensed under the Apache License, Version 2.0"), (2, "SPDX-License-Identifier: BSD-3-Clause"), (3, "the apache licence"), (4, "nothing")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(d).collect()}
    assert got[1]["labels"] == "apache,apache-2.0" and got[1]["score"] == 1.0 and got[1]["n_detections"] == 1
    assert got[2]["labels"] == "bsd-3-clause" and got[3]["labels"] == "apache" and got[3]["score"] == 0.5
    assert got[4]["labels"] == "" and got[4]["score"] == 0.0


def test_license_resolution_against_brute_force(spark):
    rng = random.Random(1)
    words = "mit license apache 2 0 gnu general public version 3 bsd clause licensed under the cc by sa spdx identifier lesser".split()
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(60)]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    from strataview.llm.license_rules import rules

    for i, t in rows:
        norm, found = f" {t} ", []
        for label, p, _, rx in rules():
            found += [(m.start(), m.end(), p, label) for m in re.finditer(f"(?<= )(?:{rx})(?= )", norm)]
        keep = set(got[i].split(",")) - {""}
        base = {v for k, v in license_scan.BASE.items() if f" {k} " in norm}
        want = set(base)
        for f in found:
            inside = [o for o in found if o != f and o[0] <= f[0] and o[1] >= f[1] and o[2] >= f[2] and (o[:2] != f[:2] or o[2] > f[2] or o[3] < f[3])]
            if not inside:
                want.add(f[3])
        assert keep == want, (t, found)


def wordings(pattern):
    """All texts a rule's pattern matches, a free stretch as one word."""
    from re import _parser

    def grow(items):
        out = [""]
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                more = [chr(arg)]
            elif op == "IN":
                more = [chr(c) for _, c in arg]
            elif op == "BRANCH":
                more = [x for b in arg[1] for x in grow(b)]
            elif op == "SUBPATTERN":
                more = grow(arg[3])
            elif op == "MAX_REPEAT":
                assert arg[:2] == (0, 1)
                more = ["", *grow(arg[2])]
            else:
                assert op == "MIN_REPEAT"
                more = ["any"]
            out = [x + y for x in out for y in more]
        return out

    return grow(_parser.parse(pattern))


def test_license_keywords_are_in_every_wording(spark):
    from strataview.llm.license_rules import rules

    for label, _, key, rx in rules():
        assert all(key in w.split(" ") for w in wordings(rx)), (label, key, rx)
    rows = [(1, "released under the FreeBSD License"), (2, "for noncommercial use only"), (3, "for non-commercial use only"), (4, "Licensed under the terms of the FreeBSD licence")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("bsd-2-clause", 0.8), 2: ("non-commercial", 0.8), 3: ("non-commercial", 0.8), 4: ("bsd-2-clause", 1.0)}


# -- quality rules ----------------------------------------------------------------------------------------------------


def test_quality_rules_against_brute_force(docs):
    got = Counter(tuple(r)[:7] for r in quality_rules.filter_quality(docs).collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        t = r["text"] or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        seen = defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        cover = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)}
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        want[r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), failed] += 1
    assert got == want


def test_quality_rules_sql(spark, docs):
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = Counter(con.execute(quality_rules.oracle()).fetchall())
    assert Counter(tuple(r) for r in quality_rules.filter_quality(docs).collect()) == want


def test_quality_order_does_not_change_verdicts(docs):
    a = Counter(tuple(r) for r in quality_rules.filter_quality(docs, sample_rows=1).collect())
    assert a == Counter(tuple(r) for r in quality_rules.filter_quality(docs, sample_rows=50).collect())


def test_costs_tell_rules_apart(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i, "some words and UPPER case 123 ! ... " * 60) for i in range(100)], "doc_id long, text string")
    cheap = quality_rules.Rule("cheap", lambda: F.col("n_words") > 5, "")
    dear = quality_rules.Rule("dear", lambda: F.length(F.regexp_replace("body", "[^A-Z]", "")) > 5, "")
    found = quality_rules.measure(quality_rules.base_stats(d), [dear, cheap])
    assert found["cheap"][0] == found["dear"][0] == 100 and found["dear"][1] > 3 * max(found["cheap"][1], 2e-6)
    assert [r.name for r in quality_rules.plan_order(quality_rules.base_stats(d), [dear, cheap])] == ["cheap", "dear"]


# -- language model ---------------------------------------------------------------------------------------------------


def test_class_model(docs):
    got = class_model.score_texts(docs, classes=6, head=50, block_tokens=500).collect()
    c, all_ = Counter(), []
    for r in docs.select("doc_id", "text").collect():
        held = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10 == 0
        w = [*(r["text"] or "").encode().lower().split(), None]
        all_.append((r["doc_id"], held, w))
        if not held:
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = Counter((i, h, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for i, h, w in all_)
    assert Counter((*tuple(r)[:5], round(r["base_score"], 4)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_class_model_uses_structure(spark):
    rng = random.Random(2)
    sides = [[f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]]
    rows = [(i, " ".join(rng.choice(sides[j % 2]) for j in range(60))) for i in range(200)]
    got = class_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), classes=4, head=30).filter("held_out").collect()
    assert all(r["score"] > r["base_score"] + 10 for r in got) and all(r["perplexity"] < 80 for r in got)


@pytest.mark.parametrize("head", [3, 10, 500])
def test_head_is_of_all_counts(spark, head):
    rng = random.Random(5)
    blocks = [Counter(rng.choices([f"w{i}".encode() for i in range(60)], weights=range(1, 61), k=70)) for _ in range(30)]
    for i, b in enumerate(blocks):
        b[b"thin"] = 3  # never 4 in a block, and yet among the first
        b[b"lumpy"] = 9 * (i % 15 == 0)
    lists = spark.createDataFrame([([(w, n) for w, n in b.items()],) for b in blocks], "z array<struct<w:binary,n:int>>").repartition(5)
    total = sum(blocks, Counter())
    assert class_model.most_frequent(lists, head) == sorted((w for w in total if total[w]), key=lambda w: (-total[w], w))[:head]
    assert b"thin" in sorted(total, key=lambda w: (-total[w], w))[:10]


def test_class_model_does_not_depend_on_blocks(spark):
    rng = random.Random(3)
    sides = [[f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)], [f"c{i}" for i in range(60)]]
    rows = [(i, " ".join(rng.choice(sides[(i + j) % 3]) for j in range(30))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, some, many = (sorted((r["doc_id"], r["n_known"], round(r["score"], 6)) for r in class_model.score_texts(docs.repartition(p), classes=5, head=20, block_tokens=size).collect()) for p, size in ((1, 10**6), (8, 40), (200, 10**6)))
    assert one == some == many


def scores_truth(rows, classes, head):
    """The model of all texts by plain loops, but for the exchange (tested by itself)."""
    texts = [(i, zlib.crc32(str(i).encode()) % 10 == 0, [*t.encode().lower().split(), b""]) for i, t in rows]
    train = [w for _, held, w in texts if not held]
    n = Counter(x for w in train for x in w)
    top = sorted(n, key=lambda w: (-n[w], w))[:head]
    at = {w: i for i, w in enumerate(top)}
    pair = np.zeros((len(top), len(top)))
    for w in train:
        for a, b in zip([w[-1], *w[:-1]], w, strict=True):
            if a in at and b in at:
                pair[at[a], at[b]] += 1
    cls = class_model.exchange(pair, classes)
    joint = np.full((classes, classes), 0.5)
    for a in range(len(top)):
        for b in range(len(top)):
            joint[cls[a], cls[b]] += pair[a, b]
    gain = defaultdict(lambda: np.zeros(classes))
    for w in train:
        for j, x in enumerate(w):
            if x not in at:
                if (a := w[j - 1]) in at:
                    gain[x] += np.log(joint[cls[at[a]]] / joint.sum(0))
                if j + 1 < len(w) and (b := w[j + 1]) in at:
                    gain[x] += np.log(joint[:, cls[at[b]]] / joint.sum(1))
    k = {w: int(cls[at[w]] if w in at else gain[w].argmax()) for w in n}
    size, types = Counter(), Counter(k.values())
    for w, c in n.items():
        size[k[w]] += c
    rare = int(np.argmax([types[c] / max(size[c], 1) for c in range(classes)]))
    of = lambda w: k.get(w, rare)
    moves = np.zeros((classes, classes))
    for w in train:
        for a, b in zip([w[-1], *w[:-1]], w, strict=True):
            moves[of(a), of(b)] += 1
    prior = (moves.sum(0) + 0.5) / (moves.sum() + 0.5 * classes)
    step = (moves + 5 * prior) / (moves.sum(1, keepdims=True) + 5)
    word = lambda w: (n[w] + 0.1) / (size[of(w)] + 0.1 * (types[of(w)] + (of(w) == rare)))
    return {i: sum(math.log10(step[of(a), of(b)] * word(b)) for a, b in zip([w[-1], *w[:-1]], w, strict=True)) for i, _, w in texts}


def test_scores_against_plain_loops(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abcde"[(i + j) % 5 :]) + str(int(rng.paretovariate(0.7)) % 40) for j in range(rng.randrange(0, 40)))) for i in range(120)]
    got = class_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), classes=6, head=25, block_tokens=300).collect()
    want = scores_truth(rows, 6, 25)
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want, abs=1e-6)


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(0)
    side = rng.integers(0, 3, 24)
    pair = rng.poisson(np.where(side[:, None] == (side[None, :] + 1) % 3, 30, 2)).astype(float)

    def value(c):
        of = np.eye(3)[c]
        xlog = lambda x: (x * np.log(np.maximum(x, 1e-12))).sum()
        return xlog(of.T @ pair @ of) - xlog(of.T @ pair.sum(1)) - xlog(of.T @ pair.sum(0))

    c = class_model.exchange(pair, 3, rounds=50)
    best = value(c)
    assert best > value(np.arange(24) % 3)
    for w in range(24):
        for k in range(3):
            d = c.copy()
            d[w] = k
            assert value(d) <= best + 1e-6


# -- decontamination --------------------------------------------------------------------------------------------------


def test_decontamination_against_brute_force(spark, docs):
    rng = random.Random(9)
    items = [(1, prose(rng, 40)), (2, prose(rng, 18)), (3, "just three words"), (4, None), (5, ""), (6, prose(rng, 25))]
    items.append((7, items[0][1]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    broken = items[0][1].split()
    broken[20:20] = ["added"]
    more = [(900, "before " + items[0][1].upper() + " after"), (901, " ".join(broken)), (902, "Just three, words!"), (903, items[1][1][:50]), (904, "far " * 30 + items[5][1] + " " + items[5][1])]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    sh = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    want = Counter()
    for r in d.collect():
        s = sh(words(r["text"]))
        for i, t in items:
            c = Counter(sh(words(t)))
            m, n = sum(c.values()), min(sum(c.values()), len(s))
            best = 0.0
            for k in range(len(s) - n + 1) if n else ():
                both = sum((Counter(s[k : k + n]) & c).values())
                best = max(best, both / (n + m - both))
            if best >= 0.8:
                want[r["doc_id"], i, round(best, 9)] += 1
    for shard in (1 << 24, 150):
        got = Counter((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in decontaminate.find_leaks(d, bench, shard_bytes=shard).collect())
        assert got == want and (900, 1, 1.0) in got and (900, 7, 1.0) in got


def test_a_very_long_item_is_used_whole(spark):
    rng = random.Random(4)
    item = prose(rng, 20_000, 5000)
    d = spark.createDataFrame([(1, "x y z " + item + " z"), (2, " ".join(item.split()[:12_000])), (3, None)], "doc_id long, text string")
    got = decontaminate.find_leaks(d, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["start_word"], r["n_words"], r["similarity"]) for r in got] == [(1, 3, 20_000, 1.0)]


def test_multi_index_misses_nothing_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, (300, decontaminate.LANES)).astype(np.uint64)
    ix = decontaminate.MultiIndex(prints, decontaminate.RADIUS)
    for i in range(300):
        bits = np.unpackbits(prints[i].view(np.uint8))
        bits[rng.permutation(decontaminate.BITS)[: decontaminate.RADIUS]] ^= 1  # at the very edge
        moved = np.packbits(bits).view(np.uint64)[None, :]
        assert [0, i, decontaminate.RADIUS] in ix.near(moved).tolist()


def test_fingerprints_of_windows():
    rng = np.random.default_rng(6)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    starts = np.array([0, 1, 5, 700, 701, 2960])
    alone = np.concatenate([decontaminate.fingerprints(h[s : s + 40], np.zeros(1, np.int64), 40) for s in starts])
    assert (decontaminate.fingerprints(h, starts, 40) == alone).all()
    kept = decontaminate.SEGMENT
    try:
        some = np.array([0, 1, 30, 900, 905, 1700, 1990])
        want = decontaminate.fingerprints(h, some, 1001)
        decontaminate.SEGMENT = 64  # the way of long windows
        assert (decontaminate.fingerprints(h, some, 1001) == want).all()
    finally:
        decontaminate.SEGMENT = kept


@pytest.mark.parametrize("n", [9, 18, 40, 200])
def test_recall_and_selectivity_of_the_index(n):
    rng = np.random.default_rng(n)
    need = math.ceil(2 * 0.8 / 1.8 * n - 1e-9)  # as few shared shingles as 0.8 allows
    items = rng.integers(0, 2**63, (500, n)).astype(np.uint64)
    near = items.copy()
    near[:, need:] = rng.integers(0, 2**63, (500, n - need)).astype(np.uint64)
    prints, moved = (decontaminate.fingerprints(x.ravel(), np.arange(500) * n, n) for x in (items, near))
    ix = decontaminate.MultiIndex(prints, decontaminate.RADIUS)
    values = decontaminate.blocks_of(moved)
    found = sum(row == i for row, i, _ in ix.near(moved).tolist())
    met = sum(row != i for row, i in ix.candidates(values).tolist())
    assert found >= 0.99 * 500 and met <= 0.002 * 500 * 500


# -- Jaccard join -----------------------------------------------------------------------------------------------------


def jaccard_truth(rows, k, pct):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= pct * len(a | sets[j]):
                parent[find(i)] = find(j)
    group = defaultdict(list)
    for i in range(len(rows)):
        group[find(i)].append(rows[i][0])
    out = Counter()
    for i, (doc, _) in enumerate(rows):
        ids = [g for g in group[find(i)] if g is not None]
        out[doc, len(sets[i]), min(ids, default=None) if sets[i] else doc] += 1
    return out


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [1, 3, 100])
def test_joins_of_counted_keys(spark, how, hot):
    rows = [(k, i) for k in range(8) for i in range(k)] + [(None, 1)]
    left = spark.createDataFrame(rows, "k long, i long")
    keys = spark.createDataFrame([(k, k, f"v{k}") for k in range(6)], "k long, c long, v string")
    want = Counter((k, i, k if k is not None and k < 6 else None, f"v{k}" if k is not None and k < 6 else None) for k, i in rows if how == "left" or (k is not None and k < 6))
    got = common.join_counted(left, keys, ["k"], "c", how, hot)
    assert got.columns == ["k", "i", "c", "v"] and Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize(("k", "pct"), [(4, 85), (5, 80)])
def test_jaccard_join_against_brute_force(spark, docs, k, pct, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)  # several blocks a cluster
    monkeypatch.setattr(common, "HOT_ROWS", 20 * (k - 4) + 3)  # some keys are hot
    rng = random.Random(k)
    base = prose(rng, 90).split()
    more = []
    for i in range(60):  # a group of near copies around the threshold
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        more.append((1000 + i, " ".join(w)))
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r[0], r[1]) for r in d.collect()]
    got = Counter(tuple(r)[:3] for r in jaccard_join.link_documents(d, k=k, pct=pct).collect())
    assert got == jaccard_truth(rows, k, pct)


def test_searches_skip_what_cannot_link():
    rng = np.random.default_rng(5)
    base = rng.permutation(100_000).astype(np.uint64)
    sets = [np.unique(base[: rng.integers(20, 2000)]) for _ in range(200)]  # nested: every list is long, and most sizes cannot link
    index = jaccard_join.Inverted(sets)
    got = dict(jaccard_join.overlaps(sets, sets, 85, index))
    for i, s in enumerate(sets):
        assert set(got[i].tolist()) == {j for j, o in enumerate(sets) if 100 * min(len(s), len(o)) >= 85 * max(len(s), len(o))}
    whole = sum(min(len(s), len(o)) for s in sets for o in sets)  # postings of all lists of all searches
    assert index.read < whole / 10, (index.read, whole)


def test_chained_clusters_compare_only_blocks_that_share(spark, monkeypatch):
    """A long chain of texts, each with a rare passage of the one before, is one
    cluster; only neighbours share a prefix shingle."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(2)
    part = [[f"p{i}x{j}" for j in range(30)] for i in range(81)]
    rows = [(i, " ".join(part[i] + part[i + 1])) for i in range(80)] + [(100 + i, " ".join(part[i] + part[i + 1] + ["more"])) for i in range(0, 80, 3)]
    rng.shuffle(rows)
    seen, compare = [], jaccard_join._compare

    def spy(members, pairs, pct):
        seen.append(pairs.count())
        return compare(members, pairs, pct)

    monkeypatch.setattr(jaccard_join, "_compare", spy)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r)[:3] for r in jaccard_join.link_documents(d, k=4, pct=85).collect())
    assert got == jaccard_truth(rows, 4, 85)
    assert len(seen) < 2 or seen[1] <= 200  # all pairs of its blocks would be over 300


def test_overlaps_are_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 5000, 200)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(100, 200)), rng.integers(0, 9000, rng.integers(0, 30))])).astype(np.uint64) for _ in range(60)]
    for pct in (50, 85):
        got = {(i, int(j)) for i, js in jaccard_join.overlaps(sets, sets, pct) for j in js}
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= pct * len(np.union1d(a, b))}
        assert {(min(x), max(x)) for x in got} == {(min(x), max(x)) for x in want}


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(500, 540)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {v: find(v) for a, b in edges if a != b for v in (a, b)}
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


# -- tokens, packing --------------------------------------------------------------------------------------------------


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    rng = random.Random(4)
    alphabet = "abc ABC 019 .,!?'\n\t\r  éßñÀ ☃ 漢字 अ́    😀<|endoftext|>'s 're “”"
    for text in ["", "<|endoftext|>", "it's  we'RE\n\n  x", *("".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(400))]:
        assert tokens.encode(text, tokens.default_vocabulary()).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_counts_against_brute_force(docs):
    v = tokens.default_vocabulary()
    want = Counter((r["doc_id"], len(tokens.encode(r["text"], v))) for r in docs.select("doc_id", "text").collect())
    for block in (16, 65536):
        got = Counter(tuple(r) for r in token_counts.document_token_counts(docs, block_tokens=block).collect())
        assert got == want


def test_separator_scan_across_blocks_and_chunks(spark):
    rng = random.Random(8)
    rows, want = [], set()
    for f in range(6):
        ids = [9 if rng.random() < 0.15 else rng.randrange(8) for _ in range(rng.randrange(0, 200))]
        if f == 0:
            ids = [1] * 97
        n, k = 0, 0
        for x in ids:
            if x == 9:
                want.add((f, k, n, True))
                n, k = 0, k + 1
            else:
                n += 1
        if n:
            want.add((f, k, n, False))
        raw = np.array(ids, "<u2")
        rows += [(f, b, raw[i : i + 7].tobytes()) for b, i in enumerate(range(0, max(1, len(raw)), 7))]
    rows.append((7, 0, None))
    blocks = spark.createDataFrame(rows, "file_id long, block_no long, payload binary")
    got = [tuple(r) for r in token_counts.count_tokens(blocks, 9, chunk=3).select("file_id", "ordinal", "n_tokens", "terminated").collect()]
    assert set(got) == want and len(got) == len(want)


def test_token_files(spark, tmp_path):
    raw = np.array([1, 2, 9, 9, 3, 9, 4], "<u2")
    (tmp_path / "a.bin").write_bytes(raw.tobytes())
    blocks = token_counts.read_token_files(spark, str(tmp_path), block_bytes=4)
    got = sorted(tuple(r) for r in token_counts.count_tokens(blocks, 9).select("ordinal", "n_tokens", "terminated").collect())
    assert got == [(0, 2, True), (1, 0, True), (2, 1, True), (3, 1, False)]


def test_token_files_are_read_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = Counter()
    for name, n in (("a", 5000), ("b with space", 4096), ("empty", 0)):
        raw = rng.integers(0, 12, n).astype("<u2")
        (tmp_path / f"{name}.bin").write_bytes(raw.tobytes())
        ends = np.flatnonzero(raw == 9)
        sizes = np.diff(np.concatenate([[-1], ends])) - 1
        want.update((int(x), True) for x in sizes)
        if n and n - 1 > ends[-1]:
            want[n - 1 - int(ends[-1]), False] += 1
    blocks = token_counts.read_token_files(spark, str(tmp_path), block_bytes=128, blocks_each=4)
    assert blocks.count() > 100 and blocks.groupBy("file_id", "block_no").count().filter("count > 1").count() == 0
    assert Counter((r["n_tokens"], r["terminated"]) for r in token_counts.count_tokens(blocks, 9, chunk=8).collect()) == want


def test_packing_round_trip(docs):
    v = tokens.default_vocabulary()
    got = packing.pack(docs, capacity=64, end_id=2).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.append(tokens.encode(r["text"], v), 2).astype("<u4")
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) % 64 or 64) if not at else 64
            want[r["doc_id"], k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at, k = at + n, k + 1
    assert Counter(tuple(r)[:5] for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        end = 0
        for o, n in sorted(p):
            assert o == end
            end += n
        assert end <= 64
    total = sum(r["length"] for r in got)
    assert len(places) <= math.ceil(total / 64) + 2


def test_bin_completion_reaches_small_optima():
    rng = random.Random(6)
    for _ in range(40):
        bins = rng.randrange(2, 7)
        counts = np.zeros(31, np.int64)
        for _ in range(bins):  # a perfect packing, cut at random
            left = 30
            while left:
                x = rng.randrange(1, left + 1)
                counts[x] += 1
                left -= x
        out = packing.solve(counts, 30)
        used = np.zeros(31, np.int64)
        for pattern, times in out:
            assert sum(pattern) <= 30
            for x in pattern:
                used[x] += times
        assert (used == counts).all() and bins <= sum(k for _, k in out) <= bins + 1


def test_the_fullest_filling_is_among_them():
    counts = np.zeros(425, np.int64)
    counts[[423, 422, 421, 300, 124]] = 1
    assert packing.fillings(424, counts, 48)[0] == (300, 124)
    rng = random.Random(7)
    for _ in range(200):
        room = rng.randrange(1, 60)
        counts = np.zeros(61, np.int64)
        for x in rng.choices(range(1, 61), k=rng.randrange(1, 12)):
            counts[x] += 1
        sums = {0}
        for x in np.repeat(np.arange(61), counts).tolist():
            sums |= {s + x for s in sums}
        best = (packing.fillings(room, counts, 48) or [()])[0]
        assert sum(best) == max(s for s in sums if s <= room) and all(best.count(x) <= counts[x] for x in best)


# -- suffix arrays ----------------------------------------------------------------------------------------------------


def repeats_truth(rows, length, keep_first):
    at, first = Counter(), {}
    raws = [(t or "").encode() for _, t in rows]
    for i, b in enumerate(raws):
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            at[s] += 1
            first.setdefault(s, (i, k))
    out = []
    for i, b in enumerate(raws):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if (first[s] != (i, k)) if keep_first else at[s] > 1:
                gone[k : k + length] = True
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("chunk_rows", [2500, 3])
def test_repeats_against_brute_force(spark, unique, keep_first, chunk_rows, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 4 if chunk_rows == 3 else 500_000)
    monkeypatch.setattr(suffix_dedup, "PORTION", 40)
    rng = random.Random(11)
    stem = prose(rng, 60)
    more = [(2000 + i, prose(rng, 12) + stem[rng.randrange(80) :] + prose(rng, 12)) for i in range(20)]
    d = unique.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).repartition(4)
    rows = sorted((r[0], r[1]) for r in d.collect())
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.remove_repeats(d, length=100, keep_first=keep_first, chunk_rows=chunk_rows, bucket_rows=chunk_rows, broadcast_rows=chunk_rows)).collect()}
    for (i, _), want in zip(rows, repeats_truth(rows, 100, keep_first), strict=True):
        assert got[i] == want, i


def test_repeats_with_repeated_and_missing_ids(docs):
    rows = sorted(((r[0], r[1]) for r in docs.select("doc_id", "text").collect()), key=lambda r: key(r[0]))
    got = Counter(tuple(r) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs, length=60, keep_first=False)).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, repeats_truth(rows, 60, False), strict=True))


@pytest.mark.parametrize("bound", [1_000_000, 2])
def test_passages_are_reported_beside_repeats(spark, docs, bound):
    rng = random.Random(3)
    short = " ".join(rng.choice("abcdefgh") for _ in range(9))
    more = [(3000 + i, prose(rng, 6) + " " + short + " " + prose(rng, 6)) for i in range(3)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = sorted(((r[0], r[1]) for r in d.collect()), key=lambda r: key(r[0]))

    def passages(length, words):
        raws = [(t or "").encode() for _, t in rows]
        runs = [[m.span() for m in re.finditer(rb"[^ \t-\r]+", b)] for b in raws]
        spots = [[(s, s + length) for s in range(len(b) - length + 1)] + [(w[i][0], w[i + words - 1][1]) for i in range(len(w) - words + 1) if w[i + words - 1][1] - w[i][0] < length] for b, w in zip(raws, runs, strict=True)]
        n = Counter(b[s:e] for b, p in zip(raws, spots, strict=True) for s, e in p)
        return [len({k for s, e in p if n[b[s:e]] > 1 for k in range(s, e)}) for b, p in zip(raws, spots, strict=True)]

    got = suffix_dedup.digest(suffix_dedup.remove_and_report(d, length=90, passage=60, words=7, broadcast_rows=bound))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"]
    want = Counter((i, *w, p) for (i, _), w, p in zip(rows, repeats_truth(rows, 90, False), passages(60, 7), strict=True))
    assert Counter(map(tuple, got.collect())) == want
    assert sum(r[-1] > r[2] for r in want) > 2


def test_cuts_keep_whole_characters_and_columns(spark):
    d = spark.createDataFrame([(1, "né" * 200, 400, "keep"), (2, "xx" + "né" * 200 + "ß", 403, None)], "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r for r in suffix_dedup.cut_documents(d, 90).collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and got[1]["spans"] == "keep"
    assert got[2]["text"].startswith("xx") and got[2]["text"].endswith("ß") and len(got[2]["text"]) < 20


def test_previous_factors():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50):
        s = rng.integers(0, 2, (n, 6)).astype(np.uint8)
        lpf, anywhere = suffix_dedup.previous_factors([r.tobytes() for r in s])
        common = lambda a, b: next((i for i in range(6) if a[i] != b[i]), 6)
        for i in range(n):
            assert lpf[i] == max((common(s[i], s[j]) for j in range(i)), default=0)
            assert anywhere[i] == max((common(s[i], s[j]) for j in range(n) if j != i), default=0)


# -- classifiers ------------------------------------------------------------------------------------------------------


def test_classifiers_on_hard_rows(docs, labels):
    for got, parts, held in ((toxicity.score_toxicity(docs, labels), 3, 1), (byte_cnn.score_quality(docs, labels), 4, 2)):
        rows = got.collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % parts == held)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_classifiers_learn(spark):
    rng = random.Random(0)
    rows, lab = [], []
    for i in range(600):
        bad = i % 3 == 0
        t = prose(rng, 60).split()
        if bad:
            t[rng.randrange(60)] = rng.choice(["zorkface", "zorkling", "you idiot"])
        junk = i % 4 == 0
        rows.append((i, " ".join(t) if not junk else " ".join(w.upper() + "###" for w in t)))
        lab.append((i, int(not junk), int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    toxic = {r["doc_id"]: r for r in toxicity.score_toxicity(d, labels).collect()}
    held = [i for i in toxic if toxic[i]["held_out"] and i % 4]
    assert np.mean([toxic[i]["predicted"] == int(i % 3 == 0) for i in held]) > 0.9
    good = {r["doc_id"]: r for r in byte_cnn.score_quality(d, labels).collect()}
    held = [i for i in good if good[i]["held_out"]]
    assert np.mean([good[i]["predicted"] == int(i % 4 > 0) for i in held]) > 0.95


def test_sample_is_bounded_in_rows(spark):
    texts = spark.range(40).selectExpr("id % 20 AS doc_id", "concat('t', id) AS text", "1 AS label")
    known = spark.range(20).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic", "'x' AS text").union(spark.createDataFrame([(0, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string"))
    every = labelled.training_sample(texts, known, "toxic", 3, 1, 100).collect()
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted((r["text"], r["label"]) for r in every) == sorted((min(f"t{i}", f"t{i + 20}"), i % 2) for i in ids)
    assert len(labelled.training_sample(texts, known, "toxic", 3, 1, 5).collect()) == 5


def features_truth(text, lexicon):
    """The same features, by plain loops."""
    words = re.findall(r"[^\W\d_]+", text.lower())

    def weight(w):
        return max([lexicon.get(w, 0.0), *(lexicon.get("^" + w[:k], 0.0) for k in (4, 5, 6, 7) if len(w) > k)])

    hits = [i for i, w in enumerate(words) if weight(w)]
    near = sum(any(w in toxicity.SECOND for w in words[max(0, i - 5) : i + 6]) for i in hits)
    tokens = [t.lstrip("".join(c for c in t if not c.isalnum())) for t in re.split(r'[\s,;:?"]+', text)]
    marks = set("0123456789@$!|+(*_-\u20ac")
    mixed = [t for t in tokens if any(c.isalpha() for c in t) and any(c in marks and any(x.isalnum() for x in t[k + 1 :]) for k, c in enumerate(t) if k)]
    hidden = [p for p in map(toxicity.plain, mixed) if p in lexicon] + [p for p in map(toxicity.plain, toxicity.SPACED.findall(text)) if p in lexicon]
    hidden += [p for p in (re.sub(r"(.)\1{2,}", r"\1", w) for w in words if re.search(r"(.)\1{2,}", w)) if p in lexicon]
    ws = sorted([weight(words[i]) for i in hits] + [lexicon[p] for p in hidden], reverse=True) + [0.0] * 3
    n, size = max(1, len(words)), max(1, len(text.encode()))
    caps, small = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    count = len(hits) + len(hidden)
    second = sum(w in toxicity.SECOND for w in words)
    marks_in = sum(c in "#$%&*@" for c in text)
    return [sum(ws), sum(ws) / n * 100, count, count / n * 100, *ws[:3], len({words[i] for i in hits}), sum(words[i] in toxicity.INSULTS for i in hits), near, near / n * 100, len(hidden), len(mixed) / n, caps / max(1, caps + small), text.count("!") / size, text.count("?") / size, marks_in / size, second / n, math.log1p(len(words))]


def test_toxicity_features_against_plain_loops():
    lexicon = toxicity.Lexicon({"idiot": 1.5, "^stup": 0.7, "^stupid": 2.0, "fool": 1.0})
    rng = random.Random(8)
    bits = ["you", "Idiot", "stupidly", "stuper", "fool", "f00l", "1d10t", "i d i o t", "fooool", "a-b", "-x-", "x1", "9", "!!", "?", "né", "st*pid", "id.i0t", "_", "a_b", "über", "", "\u20ac5a"]
    for text in ["", " ", *(rng.choice([" ", ", ", "\n"]).join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(300))]:
        assert toxicity.features(text, lexicon) == pytest.approx(features_truth(text, lexicon)), text
    assert toxicity.features(None, lexicon) == toxicity.features("", lexicon)


@pytest.mark.parametrize("unit", ["x", "a1", "a-", "_", "a_b-", "A"])
def test_toxicity_features_of_one_long_token(unit):
    began = time.perf_counter()
    toxicity.features(unit * (1_000_000 // len(unit)), toxicity.Lexicon({"idiot": 1.0}))
    assert time.perf_counter() - began < 15  # linear: well under 2 s; quadratic would be hours


def test_network_equals_plain_loops():
    rng = np.random.default_rng(1)
    net = byte_cnn.ByteCnn()
    p = {k: v.astype(float) for k, v in net.p.items()}
    for size in (0, 1, 5, 448, 512, 513, 960, 961, 3000):
        raw = rng.integers(1, 256, size).astype(np.uint8).tobytes()
        chunks = 1 if size <= 512 else 1 + -(-(size - 512) // 448)
        long = raw + bytes(chunks * 448 + 64 - size) + bytes(byte_cnn.WIDTH)
        logits = []
        for c in range(chunks):
            best = [max(sum(p["t"][k][long[i + k]][f] for k in range(byte_cnn.WIDTH)) for i in range(c * 448, c * 448 + 512)) + p["b"][f] for f in range(0, byte_cnn.FILTERS)]
            a = np.array([*np.maximum(best, 0), min(1, max(0, (size - c * 448) / 512))])
            logits.append(np.maximum(a @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"][0])
        assert net.score([raw])[0] == pytest.approx(1 / (1 + math.exp(-np.mean(logits))), rel=1e-4)


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = boosting.BoostedTrees().fit(x[:1500], y[:1500])
    assert ((m.raw(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95
    iso = boosting.Isotonic().fit(m.raw(x), y)
    s = iso(np.linspace(-10, 10, 200))
    assert (np.diff(s) >= 0).all() and s.min() >= 0 and s.max() <= 1


def test_network_covers_every_byte():
    net = byte_cnn.ByteCnn()
    net.p["t"][:] = 0
    net.p["t"][0, ord("!")] = 5
    for n in (1, 511, 512, 513, 960, 5000, 70_000):
        for at in {0, n // 2, n - 1}:
            raw = bytearray(b"a" * n)
            raw[at] = ord("!")
            assert net.pooled([bytes(raw)])[0].max() == 5


# -- empty tables -----------------------------------------------------------------------------------------------------


def test_empty_tables(spark, empty, labels, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for got in (
        license_scan.scan_licenses(empty),
        quality_rules.filter_quality(empty),
        class_model.score_texts(empty),
        decontaminate.find_leaks(empty, bench),
        jaccard_join.link_documents(empty),
        token_counts.document_token_counts(empty),
        toxicity.score_toxicity(empty, none),
        byte_cnn.score_quality(empty, none),
        packing.pack(empty),
        suffix_dedup.digest(suffix_dedup.remove_repeats(empty)),
    ):
        assert got.count() == 0
    assert decontaminate.find_leaks(docs, bench).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert {r["score"] for r in byte_cnn.score_quality(docs, none).collect()} == {1.0}
