"""DuckDB SQL of contract queries, over the same tables."""

from __future__ import annotations

from .license_scan import BASE

SPACE = "\\x20\\x09-\\x0D"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def license_base() -> str:
    """The base columns of ``op1_license_scan``."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(1, len(ws) - {k - 2}), lambda i: ws[i:i + {k - 1}] = {words})) - 1 AS pos FROM w"
        for phrase, label in BASE.items()
        for words in [phrase.split()]
        for k in [len(words)]
    )
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
f AS ({found}),
g AS (SELECT doc_id, count(*) AS n, min(pos) AS first, max(pos) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {bits}), 4294967295)"


def ngram_base() -> str:
    """The base columns of ``op2_class_ngrams``, the score to six places."""
    return f"""
WITH d AS (SELECT doc_id, {crc32("doc_id::VARCHAR")} % 10 = 0 AS held_out, list_append(regexp_extract_all({LOWER}, '[^{SPACE}]+'), '') AS ts FROM documents),
t AS (SELECT doc_id, held_out, unnest(ts) AS token FROM d),
v AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
s AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM v)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(n) AS train_tokens,
       round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 6) AS base_score
FROM t LEFT JOIN v USING (token), s GROUP BY doc_id, held_out"""


def jaccard_components() -> str:
    """All of ``op5_jaccard_join``: exact sets, all links, their closure."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^{SPACE}]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
m AS (SELECT u, min(v) AS least FROM r GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, m.least) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.u = w.doc_id"""


def repeated_bytes() -> str:
    """All of ``op10_suffix_dedup``, over hexadecimal texts (two digits a byte)."""

    def spans(name: str, source: str) -> str:
        # runs of overlapping or touching spans
        return f"""{name}_n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e) AS run FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ({source}))),
{name} AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM {name}_n GROUP BY doc_id, run)"""

    def strings(length: int) -> str:
        return f"SELECT doc_id, s, s + {length} AS e, md5(substr(h, 2 * s + 1, {2 * length})) AS m FROM (SELECT doc_id, h, unnest(range(0, n - {length - 1})) AS s FROM b)"

    twice = lambda t: f"SELECT doc_id, s, e FROM (SELECT *, count(*) OVER (PARTITION BY m) AS c FROM {t}) WHERE c > 1"
    return f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
long AS ({strings(400)}),
mid AS ({strings(250)}),
ws AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^{SPACE}]+')) AS w, unnest(regexp_extract_all(t, '[{SPACE}]+')[CASE WHEN regexp_matches(t, '^[{SPACE}]') THEN 2 ELSE 1 END:]) AS sep, strlen(regexp_extract(t, '^[{SPACE}]+')) AS lead, generate_subscripts(regexp_extract_all(t, '[^{SPACE}]+'), 1) AS i FROM b),
we AS (SELECT doc_id, i, lead + coalesce(sum(strlen(w) + coalesce(strlen(sep), 0)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, strlen(w) AS k FROM ws WHERE w IS NOT NULL),
wr AS (SELECT doc_id, s::BIGINT AS s, lead(s + k, 50) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM we),
runs AS (SELECT doc_id, s, e, md5(substr(h, 2 * s + 1, 2 * (e - s))) AS m FROM wr JOIN b USING (doc_id) WHERE e IS NOT NULL AND e - s < 250),
{spans("gone", twice("long"))},
{spans("passages", twice("mid") + " UNION ALL " + twice("runs"))},
edges AS (SELECT doc_id, e AS a, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS z FROM (SELECT doc_id, s, e FROM gone UNION ALL SELECT doc_id, -1, 0 FROM b)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, n) - a)), '' ORDER BY a) AS h FROM edges JOIN b USING (doc_id) GROUP BY doc_id),
g AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM gone GROUP BY doc_id),
q AS (SELECT doc_id, sum(e - s) AS n_passage_bytes FROM passages GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256, coalesce(n_passage_bytes, 0)::BIGINT AS n_passage_bytes
FROM b JOIN kept USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN q USING (doc_id)"""
