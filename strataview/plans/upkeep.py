"""More of the catalogue: recovery, verification, ring changes, lookups, sinks
and reports."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import portable
from ..operators import cache_sim, history, metrics, placement, readpath, recovery
from ..sources import documents, sinks, slot_table, trace
from ..sources.shared import folder
from ..sources.trace import with_views
from .catalogue import HIGHEST, HIST, LAYOUT, ORACLES, OWNED, QUERIES, blocks_of, places_of, query


def sql_hash(text: str) -> str:
    """The portable hash of a text in DuckDB."""
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT)"


# -- recovery ---------------------------------------------------------------------------------------------------------

RECORDS = f"""records AS (SELECT l_orderkey * 8 + l_linenumber AS slot, l_partkey AS version, l_linenumber AS block_index, (l_quantity * 6)::BIGINT AS len, {sql_hash("l_orderkey || '/' || l_linenumber")} % 53 <> 0 AS valid, l_shipdate >= TIMESTAMP '1997-01-01' AS trusted FROM lineitem)"""


def slot_records(spark, sf_dir):
    """Slot records of a node: line items as blocks of the versions that parts stand for; some are torn."""
    l = trace.read(spark, sf_dir, "lineitem")
    name = F.concat("l_orderkey", F.lit("/"), "l_linenumber")
    return l.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("slot"),
        F.col("l_partkey").alias("version"),
        F.col("l_linenumber").alias("block_index"),
        (F.col("l_quantity") * 6).cast("long").alias("len"),
        (portable(name) % 53 != 0).alias("valid"),
        (F.col("l_shipdate") >= F.expr("timestamp_ntz'1997-01-01'")).alias("trusted"),
    )


@query(
    f"WITH {RECORDS}, f AS (SELECT version, block_index, min(slot) AS first FROM records WHERE valid AND len BETWEEN 1 AND 256 GROUP BY ALL) "
    "SELECT slot, version, block_index, len, valid AND len BETWEEN 1 AND 256 AND coalesce(slot = first, false) AS restored, valid AND len BETWEEN 1 AND 256 AND coalesce(slot = first, false) AND NOT trusted AS verify FROM records LEFT JOIN f USING (version, block_index)"
)
def recovered_index(spark, sf_dir):
    """The store index of a restarted node: sound records restored, torn and repeated ones cleared, untrusted ones to be verified."""
    return recovery.restored(slot_records(spark, sf_dir), ["version", "block_index"], "slot", LAYOUT.block).select("slot", "version", "block_index", "len", "restored", "verify")


@query(
    with_views("requests states", "")
    + " SELECT doc_id, req_id AS entry, etag FROM states WHERE valid_from <= 1704067200000 + 1296000000 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY valid_from DESC, req_id DESC) = 1 AND etag IS NOT NULL"
)
def recovery_replay(spark, sf_dir):
    """The metadata a crash leaves: the log replayed up to its last sync."""
    log = trace.object_states(spark, sf_dir)
    state = recovery.replayed(log, ["doc_id"], ["valid_from", "req_id"], ["req_id", "etag"], F.col("valid_from") <= 1704067200000 + 1296000000)
    return state.filter("etag is not null").select("doc_id", F.col("req_id").alias("entry"), "etag")


@query(
    with_views("requests states", "")
    + ", a AS (SELECT doc_id, max_by(req_id, (valid_from, req_id)) AS entry FROM states GROUP BY 1), b AS (SELECT doc_id, max_by(req_id, (valid_from, req_id)) AS entry FROM states WHERE valid_from <= 1704067200000 + 1296000000 GROUP BY 1) SELECT doc_id, a.entry AS lost, b.entry AS left_with FROM a LEFT JOIN b USING (doc_id) WHERE a.entry IS DISTINCT FROM b.entry"
)
def lost_after_crash(spark, sf_dir):
    """Keys whose last change was not durable, and what the replay leaves of them."""
    log = trace.object_states(spark, sf_dir)
    full = history.latest(log, ["doc_id"], ["valid_from", "req_id"], ["req_id"]).withColumnRenamed("req_id", "lost")
    left = recovery.replayed(log, ["doc_id"], ["valid_from", "req_id"], ["req_id"], F.col("valid_from") <= 1704067200000 + 1296000000).withColumnRenamed("req_id", "left_with")
    return full.join(left, "doc_id", "left").filter(~F.col("lost").eqNullSafe(F.col("left_with"))).select("doc_id", "lost", "left_with")


@query(
    with_views("requests", "")
    + " SELECT doc_id, array_to_string(list_filter([1, 2, 3, 4], lambda n: n > req_id % 5), ',') AS waits_on FROM requests WHERE method <> 'GET' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ts_ms DESC, req_id DESC) = 1 AND req_id % 5 < 4"
)
def purge_log_open(spark, sf_dir):
    """Replay of the purge log: the nodes each purge still waits on."""
    r = trace.requests(spark, sf_dir).filter("method <> 'GET'")
    log = r.select("doc_id", "ts_ms", "req_id", F.filter(F.array(*map(F.lit, (1, 2, 3, 4))), lambda n: n > F.col("req_id") % 5).alias("nodes"))
    return recovery.open_purges(log, ["doc_id"], ["ts_ms", "req_id"], "nodes").select("doc_id", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("waits_on"))


STORED = f"""stored AS (SELECT key, i AS block_index, md5(b) AS checksum, CASE WHEN {sql_hash("key || '!' || i")} % 11 = 0 THEN substr(b, 2) ELSE b END AS bytes, {sql_hash("key || '?' || i")} % 3 > 0 AS verify FROM (
  SELECT key, i, substr(text, i * 256 + 1, 256) AS b FROM (SELECT o.key, d.text, unnest(range(0, (size + 255) // 256)) AS i FROM objects o JOIN documents d USING (doc_id))) WHERE {sql_hash("key || '.' || i")} % 5 > 0)"""


def _stored(spark, sf_dir):
    """Blocks on a recovered disk with their records' checksums; some are damaged, some are trusted, and some are not there."""
    d = trace.read(spark, sf_dir, "documents").select("doc_id", "text")
    o = trace.objects(spark, sf_dir, etags=False).select("doc_id", "key")
    b = readpath.text_blocks(d, "text", LAYOUT.block).join(o, "doc_id")
    at = lambda mark: portable(F.concat("key", F.lit(mark), "block_index"))
    damaged = F.when(at("!") % 11 == 0, F.substring("block", 2, LAYOUT.block)).otherwise(F.col("block"))
    return b.filter(at(".") % 5 > 0).select("key", "block_index", F.md5("block").alias("checksum"), damaged.alias("bytes"), (at("?") % 3 > 0).alias("verify"))


@query(
    with_views("objects requests resolved gets blocks", "")
    + f""", {STORED}, s AS (SELECT key, block_index, verify, md5(bytes) = checksum AS intact FROM stored), r AS (SELECT b.req_id, b.key, b.block_index, s.verify, s.intact, row_number() OVER (PARTITION BY b.key, b.block_index ORDER BY b.ts_ms, b.req_id) AS n FROM blocks b LEFT JOIN s ON s.key = b.key AND s.block_index = b.block_index)
SELECT req_id, key, block_index, CASE WHEN verify IS NULL THEN 'miss' WHEN NOT verify THEN 'hit' WHEN n = 1 THEN CASE WHEN intact THEN 'verified' ELSE 'corrupt' END WHEN intact THEN 'hit' ELSE 'miss' END AS outcome FROM r"""
)
def recovered_hits(spark, sf_dir):
    """Reads of a restarted node: the first hit of an untrusted block checks its bytes, and a corrupt one is dropped."""
    index = _stored(spark, sf_dir).select("key", "block_index", "verify", (F.md5("bytes") == F.col("checksum")).alias("intact"))
    b = blocks_of(spark, sf_dir).select("req_id", "ts_ms", "key", "block_index")
    return recovery.hits(b, index, ["key", "block_index"], ["ts_ms", "req_id"]).select("req_id", "key", "block_index", "outcome")


@query(
    with_views("objects", "")
    + f""", {STORED} SELECT s.key, s.block_index, s.verify FROM stored s JOIN objects o USING (key) JOIN documents d USING (doc_id) WHERE s.bytes <> substr(d.text, s.block_index * 256 + 1, 256)"""
)
def stored_against_origin(spark, sf_dir):
    """Stored blocks whose bytes are not those of the origin's version at their place."""
    d = trace.read(spark, sf_dir, "documents").select("doc_id", "text")
    o = trace.objects(spark, sf_dir, etags=False).select("doc_id", "key")
    truth = readpath.text_blocks(d, "text", LAYOUT.block).join(o, "doc_id").select("key", "block_index", "block")
    return _stored(spark, sf_dir).join(truth, ["key", "block_index"]).filter("bytes <> block").select("key", "block_index", "verify")


PHASE = f"""phase AS (SELECT DISTINCT key, block_index, {sql_hash("key || '+' || block_index")} % 6 AS p FROM blocks)"""


@query(
    with_views("objects requests resolved gets blocks", "")
    + f", {PHASE} SELECT req_id, key, block_index, CASE WHEN p <= 1 THEN 'slot' WHEN p = 2 THEN 'slot' WHEN p = 3 THEN 'await' WHEN p = 4 THEN 'join' ELSE 'miss' END AS served_by FROM blocks JOIN phase USING (key, block_index)"
)
def store_lookup(spark, sf_dir):
    """Blocks against the store index: a ready or filling slot, a fetch to join, or a miss."""
    b = blocks_of(spark, sf_dir).select("req_id", "key", "block_index")
    p = (portable(F.concat("key", F.lit("+"), "block_index")) % 6).alias("p")
    entries = b.select("key", "block_index").distinct().select("key", "block_index", p).filter("p <= 4")
    index = entries.select("key", "block_index", F.when(F.col("p") <= 1, "ready").when(F.col("p") <= 3, "filling").alias("state"), (F.col("p") == 2).alias("readable"), (F.col("p") == 4).alias("in_flight"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    found = recovery.found_in_store(F.col("state"), flag(F.col("readable")), flag(F.col("in_flight")), F.lit(False))
    return b.join(index, ["key", "block_index"], "left").select("req_id", "key", "block_index", found.alias("served_by"))


# -- ring changes, peers, memory of keys ------------------------------------------------------------------------------

CHANGE_AT = 1704067200000 + 1296000000


def _owned_blocks(spark, sf_dir):
    """Reads at their owners under a ring of four, and whether the owner stays one in a ring of five."""
    b = blocks_of(spark, sf_dir).withColumn("c", F.coalesce("chunk", F.lit(-1)))
    of = lambda n, name: placement.owners(places_of(spark, sf_dir), trace.ring(spark, sf_dir, n)).select("key", F.coalesce("chunk", F.lit(-1)).alias("c"), F.col("node_id").alias(name))
    size = F.least((F.col("block_index") + 1) * LAYOUT.block, F.col("size")) - F.col("block_index") * LAYOUT.block
    j = b.join(of(4, "node"), ["key", "c"]).join(of(5, "next"), ["key", "c"])
    return j.select("node", "ts_ms", "req_id", "block_index", F.xxhash64("key", "block_index").alias("block"), size.alias("len"), (F.col("node") == F.col("next")).alias("stays"), (F.col("req_id") % 7 > 0).alias("owned"), (F.col("req_id") % 97 == 5).alias("unwritten"), (F.col("req_id") % 11 == 3).alias("passes"))


@query(None)
def disowned_first(spark, sf_dir):
    """Node counters when the ring changes: blocks that other nodes own now are evicted before all others."""
    return cache_sim.simulate(_owned_blocks(spark, sf_dir), "node", ["ts_ms", "req_id", "block_index"], "block", "len", 4096, 16, 16, 256, 1024, stays="stays", change_at=CHANGE_AT).filter("name in ('evicted', 'disowned', 'hits', 'stored')")


@query(None)
def admission_outcomes(spark, sf_dir):
    """Outcomes of admission with leases, failed writes, first-read passes and a fill budget."""
    names = "('refused', 'over_budget', 'full', 'stored', 'miss_new', 'miss_unadmitted', 'miss_evicted')"
    return cache_sim.simulate(_owned_blocks(spark, sf_dir), "node", ["ts_ms", "req_id", "block_index"], "block", "len", 4096, 16, 16, 256, 1024, owned="owned", unwritten="unwritten", passes="passes", budget=700).filter(f"name in {names}")


@query(None)
def lease_renewals(spark, sf_dir):
    """Leases with the reports at their half and the renewals at three quarters."""
    r = trace.requests(spark, sf_dir).filter("method = 'GET'").select("doc_id", "ts_ms", "req_id")
    return cache_sim.lease_renewals(r, ["doc_id"], "ts_ms", ["ts_ms", "req_id"], 86_400_000, 3, 43_200_000)


@query(
    with_views("objects requests resolved gets blocks ring4 ring5 places", "")
    + f""", {OWNED}, {OWNED.replace('owned AS', 'owned5 AS').replace('ring4', 'ring5')}, b AS (SELECT DISTINCT key, chunk, block_index FROM blocks)
SELECT b.key, b.block_index, b5.node_id AS node, CASE WHEN a.node_id = b5.node_id OR {sql_hash("b.key || '-' || b.block_index")} % 3 = 0 THEN 'origin' WHEN {sql_hash("b.key || '*' || b.block_index")} % 7 > 0 THEN 'peer' WHEN b.block_index % 2 = 0 THEN 'refill' ELSE 'refill-unstored' END AS source
FROM b JOIN owned a ON a.key = b.key AND a.chunk IS NOT DISTINCT FROM b.chunk JOIN owned5 b5 ON b5.key = b.key AND b5.chunk IS NOT DISTINCT FROM b.chunk"""
)
def peer_fill(spark, sf_dir):
    """Where the owners of a changed ring get blocks they lack: the owner before, or the origin."""
    b = blocks_of(spark, sf_dir).select("key", "block_index", F.coalesce("chunk", F.lit(-1)).alias("c")).distinct()
    of = lambda n, name: placement.owners(places_of(spark, sf_dir), trace.ring(spark, sf_dir, n)).select("key", F.coalesce("chunk", F.lit(-1)).alias("c"), F.col("node_id").alias(name))
    at = lambda mark: portable(F.concat("key", F.lit(mark), "block_index"))
    j = b.join(of(4, "before"), ["key", "c"]).join(of(5, "node"), ["key", "c"])
    source = recovery.fill_source(F.col("before") != F.col("node"), at("-") % 3 != 0, at("*") % 7 > 0, F.col("block_index") % 2 == 0)
    return j.select("key", "block_index", "node", source.alias("source"))


@query(
    with_views("requests", "")
    + """, s AS (SELECT req_id, client % 4 AS node, doc_id, row_number() OVER (PARTITION BY client % 4 ORDER BY ts_ms, req_id) AS n FROM requests WHERE doc_id IS NOT NULL), p AS (SELECT *, lag(n) OVER (PARTITION BY node, doc_id ORDER BY n) AS before FROM s)
SELECT p.req_id, p.before IS NOT NULL AND count(DISTINCT x.doc_id) < 16 AS hit FROM p LEFT JOIN s x ON x.node = p.node AND x.n > p.before AND x.n < p.n GROUP BY p.req_id, p.before"""
)
def recency(spark, sf_dir):
    """Hits of a least-recently-used set of 16 keys a node (SQL: fewer than 16 other keys since the last read)."""
    r = trace.requests(spark, sf_dir).filter("doc_id is not null").select((F.col("client") % 4).alias("node"), "doc_id", "ts_ms", "req_id")
    return cache_sim.recency(r, "node", ["ts_ms", "req_id"], "doc_id", 16, ["req_id"]).select("req_id", "hit")


@query(
    "WITH RECURSIVE "
    + with_views("requests states", "")[5:]
    + """, q AS (SELECT doc_id, req_id, ts_ms, min(ts_ms) OVER (PARTITION BY doc_id ORDER BY ts_ms RANGE BETWEEN 86400000 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM requests WHERE method <> 'PUT'),
a AS (SELECT doc_id, min(ts_ms) AS asked FROM q GROUP BY doc_id UNION SELECT a.doc_id, q.next FROM a JOIN q ON q.doc_id = a.doc_id AND q.ts_ms = a.asked WHERE q.next IS NOT NULL),
v AS (SELECT doc_id, valid_from, max(req_id) AS v FROM states GROUP BY ALL), f AS (SELECT a.doc_id, a.asked, max_by(v.v, v.valid_from) AS value FROM a LEFT JOIN v ON v.doc_id = a.doc_id AND v.valid_from <= a.asked GROUP BY ALL)
SELECT q.req_id, max_by(f.value, f.asked) AS value, max(f.asked) AS asked FROM q JOIN f ON f.doc_id = q.doc_id AND f.asked <= q.ts_ms GROUP BY q.req_id"""
)
def lookup_ttl(spark, sf_dir):
    """Requests joined to a dimension that is looked up at most once a day and key."""
    r = trace.requests(spark, sf_dir).filter("method <> 'PUT'").select("doc_id", "ts_ms", "req_id")
    v = trace.object_states(spark, sf_dir).groupBy("doc_id", F.col("valid_from").alias("since")).agg(F.max("req_id").alias("v"))
    return cache_sim.looked_up(r, v, "doc_id", ["req_id"], "ts_ms", "v", 86_400_000, ["req_id"])


@query(
    with_views("requests", "")
    + " SELECT w.req_id, w.doc_id, greatest(w.ts_ms, coalesce((SELECT max(r.ts_ms + r.first_byte_us * 100) FROM requests r WHERE r.method = 'GET' AND r.client % 4 = w.client % 4 AND r.ts_ms < w.ts_ms), 0)) AS kept_until FROM requests w WHERE w.method = 'PUT'"
)
def write_markers(spark, sf_dir):
    """How long a gateway keeps the mark of a write: while a read sent before it is under way."""
    r = trace.requests(spark, sf_dir)
    done = F.when(F.col("method") == "GET", F.col("ts_ms") + F.col("first_byte_us") * 100)
    w = Window.partitionBy((F.col("client") % 4)).orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -1)
    return r.withColumn("until", F.max(done).over(w)).filter("method = 'PUT'").select("req_id", "doc_id", F.greatest("ts_ms", F.coalesce("until", F.lit(0))).alias("kept_until"))


UPS = "ups AS (SELECT user_id % 12 AS node_id, (epoch_us(ts) // 1000) AS t_ms, event_id, CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END AS state FROM events WHERE event_type IN ('error', 'signup'))"


@query(
    f"WITH {UPS}, c AS (SELECT *, lag(state) OVER (PARTITION BY node_id ORDER BY t_ms, event_id) AS before FROM ups), i AS (SELECT node_id, state, t_ms, lead(t_ms) OVER (PARTITION BY node_id ORDER BY t_ms, event_id) AS until FROM c WHERE before IS DISTINCT FROM state) "
    "SELECT node_id, t_ms + 3600000 AS left_at, until AS rejoined_at FROM i WHERE state = 'down' AND (until IS NULL OR until > t_ms + 3600000)"
)
def ring_leaves(spark, sf_dir):
    """When members leave the ring (down for longer than an hour's grace) and rejoin it."""
    e = trace.read(spark, sf_dir, "events").filter("event_type in ('error', 'signup')")
    e = e.select((F.col("user_id") % 12).alias("node_id"), trace.millis("ts").alias("at"), "event_id", F.when(F.col("event_type") == "error", "down").otherwise("up").alias("state"))
    w = Window.partitionBy("node_id").orderBy("at", "event_id")
    i = history.intervals(e.withColumn("before", F.lag("state").over(w)).filter(~F.col("before").eqNullSafe(F.col("state"))), "node_id", "at", ["at", "event_id"])
    out = i.filter((F.col("state") == "down") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from") + 3600000)))
    return out.select("node_id", (F.col("valid_from") + 3600000).alias("left_at"), F.col("valid_to").alias("rejoined_at"))


# -- workload and verification ----------------------------------------------------------------------------------------

SENT = f"""CASE WHEN {sql_hash("doc_id || 'd'")} % 4 = 0 THEN text WHEN {sql_hash("doc_id || 'd'")} % 4 = 1 THEN '~' || substr(text, 2) WHEN {sql_hash("doc_id || 'd'")} % 4 = 2 THEN substr(text, 1, length(text) // 2) || '~' || substr(text, length(text) // 2 + 2) ELSE substr(text, 1, length(text) - 1) || '~' END"""


@query(
    f"WITH a AS (SELECT doc_id, text, {SENT} AS sent, CASE doc_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'edges' ELSE 'none' END AS mode FROM documents) "
    "SELECT doc_id, mode, CASE mode WHEN 'full' THEN sent = text WHEN 'edges' THEN substr(sent, 1, 256) = substr(text, 1, 256) AND right(sent, 256) = right(text, 256) AND length(sent) = length(text) ELSE true END AS matched FROM a"
)
def verify_modes(spark, sf_dir):
    """Answers, some of them damaged at the head, middle or tail, checked whole, at their edges, or not at all."""
    d = trace.read(spark, sf_dir, "documents").select("doc_id", "text")
    h, t, n = portable(F.concat("doc_id", F.lit("d"))) % 4, F.col("text"), F.length("text")
    half = F.floor(n / 2).cast("int")
    cut = lambda a, k: F.substring(t, a, k)
    sent = F.when(h == 0, t).when(h == 1, F.concat(F.lit("~"), cut(F.lit(2), n))).when(h == 2, F.concat(cut(F.lit(1), half), F.lit("~"), cut(half + 2, n))).otherwise(F.concat(cut(F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit("~")))
    mode = F.when(F.col("doc_id") % 3 == 0, "full").when(F.col("doc_id") % 3 == 1, "edges").otherwise("none")
    a = d.select("doc_id", "text", sent.alias("sent"), mode.alias("mode"))
    return a.select("doc_id", "mode", recovery.matches(F.col("mode"), F.col("sent"), F.col("text"), 256).alias("matched"))


DRAW = lambda field, below: f"{sql_hash(f'''i || '{field}' ''')} % {below}"


@query(
    f"""WITH d AS (SELECT i, {DRAW('key', 100)} AS key, {DRAW('method', 100)} < 15 AS head, {DRAW('range', 6)} AS k, {DRAW('a', 4097)} AS a, {DRAW('b', 4097)} AS b, {DRAW('if', 20)} AS m, {DRAW('ifn', 20)} AS n FROM (SELECT unnest(range(0, 20000)) AS i))
SELECT i, key, CASE WHEN head THEN 'HEAD' ELSE 'GET' END AS method, CASE k WHEN 0 THEN 'bytes=' || a || '-' || (a + b) WHEN 1 THEN 'bytes=' || a || '-' WHEN 2 THEN 'bytes=-' || (a + 1) WHEN 5 THEN 'bytes=' || (a + 1 + b) || '-' || a END AS range,
CASE WHEN m < 2 THEN 'current' WHEN m = 2 THEN 'stale' END AS if_match, CASE WHEN n < 2 THEN 'current' WHEN n = 2 THEN 'stale' END AS if_none_match FROM d"""
)
def random_requests(spark, sf_dir):
    """Seeded requests for differential tests: ranges valid and not, conditions current and stale, 15 % HEAD."""
    from ..operators.workload import random_requests as draw

    return draw(spark.range(20000).select(F.col("id").alias("i")), "i", 100, 4097)


# -- sinks and reports ------------------------------------------------------------------------------------------------


@query(
    with_views("objects requests resolved gets blocks ring4", "")
    + f""", w AS (SELECT r.req_id, r.doc_id, o.key, r.ts_ms AS valid_from, '"v' || r.req_id || '"' AS etag FROM requests r JOIN objects o USING (doc_id) WHERE r.method = 'PUT'), places AS (SELECT DISTINCT key, NULL::BIGINT AS chunk FROM w), {OWNED}
SELECT w.req_id, w.doc_id, w.valid_from, w.etag, o.node_id AS home FROM w JOIN owned o USING (key)"""
)
def write_pass_through(spark, sf_dir):
    """Writes pass through their keys' homes to the origin: appended to a table of states, and read back."""
    w = trace.requests(spark, sf_dir).filter("method = 'PUT'").join(trace.objects(spark, sf_dir, etags=False), "doc_id")
    w = w.select("req_id", "doc_id", "key", F.col("ts_ms").alias("valid_from"), F.concat(F.lit('"v'), "req_id", F.lit('"')).alias("etag"))
    homes = placement.owners(w.select("key", F.lit(None).cast("long").alias("chunk")).distinct(), trace.ring(spark, sf_dir, 4)).select("key", F.col("node_id").alias("home"))
    path = folder(spark, "states")
    passed = w.join(homes, "key").select("req_id", "doc_id", "valid_from", "etag", "home")
    for batch in range(2):
        sinks.append_states(passed.filter(F.col("req_id") % 2 == batch), path, batch)
    sinks.append_states(passed.filter("req_id % 2 = 1"), path, 1)  # a batch tried again
    return sinks.read_states(spark, path)


@query(
    f"WITH {RECORDS} SELECT block_index, count(*) AS records, sum(len)::BIGINT AS bytes, count(*) FILTER (WHERE NOT valid) AS torn FROM records GROUP BY 1"
)
def slot_table_round_trip(spark, sf_dir):
    """A slot table written in parts and read back; torn records fail their check."""
    spark.dataSource.register(slot_table.SlotTable)
    path = re.sub("^file:(//)?", "", folder(spark, "slots"))
    r = slot_records(spark, sf_dir)
    zero = F.lit(0).cast("long")
    cols = ["slot", F.col("version").alias("version_key"), F.md5(F.col("version").cast("string")).alias("version_hash"), F.col("block_index").cast("long").alias("block_index"), "len", zero.alias("placement"), F.lit(0).alias("extent"), zero.alias("offset"), "valid"]
    r.select(*cols).write.format("slot_table").mode("append").save(path)
    back = spark.read.format("slot_table").load(path)
    return back.groupBy(F.col("block_index").cast("int").alias("block_index")).agg(F.count(F.lit(1)).alias("records"), F.sum("len").alias("bytes"), F.count_if(~F.col("valid")).alias("torn"))


SHARES = [*range(1, 100), 99.5, 99.9, 99.95, 99.99, 100]


@query(
    with_views("requests", "")
    + f", {HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY event_type) AS total, max(max_value) OVER (PARTITION BY event_type) AS top FROM hist) "
    f"SELECT event_type AS class, percentile, least({HIGHEST}, top)::BIGINT AS latency_us FROM (SELECT event_type, share AS percentile, min(bucket) AS bucket, any_value(top) AS top FROM c CROSS JOIN (SELECT unnest([{', '.join(f'{s}::DOUBLE' for s in SHARES)}]) AS share) WHERE seen >= least(greatest(ceil(share / 100 * total), 1), total) GROUP BY ALL)"
)
def percentile_csv(spark, sf_dir):
    """Latency percentiles 1 to 99, 99.5 to 99.99 and 100, as a CSV report read back."""
    h = metrics.loglinear_histogram(trace.requests(spark, sf_dir), ["event_type"], F.col("first_byte_us"), 7)
    p = metrics.percentiles(h, ["event_type"], [s / 100 for s in SHARES], 7)
    path = folder(spark, "percentiles")
    sinks.write_csv(p.select(F.col("event_type").alias("class"), F.round(F.col("share") * 100, 2).alias("percentile"), F.col("percentile").alias("latency_us")), path)
    return spark.read.schema("class string, percentile double, latency_us long").option("header", True).csv(path)


@query(with_views("requests", "") + " SELECT 'h' || client % 4 AS host, ts_ms // 5000 AS t, event_type AS metric, count(*)::DOUBLE AS value FROM requests GROUP BY ALL")
def time_samples(spark, sf_dir):
    """Counter lines of each host's processes (written as text, read by line), summed over processes."""
    r = trace.requests(spark, sf_dir).groupBy((F.col("client") % 4).alias("host"), (F.col("client") % 8).alias("process"), F.floor(F.col("ts_ms") / 5000).alias("t"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    path = folder(spark, "samples")
    r.select(F.concat(F.lit("h"), "host", F.lit(" "), "t", F.lit(" "), "event_type", F.lit(" "), "n").alias("line")).write.text(path)
    return documents.read_samples(spark, path)


@query(with_views("requests", "") + " SELECT event_type AS step, 0 AS place, 'reads' AS class, CASE event_type WHEN 'error' THEN '503' ELSE '200' END AS status, count(*) AS n, sum(first_byte_us)::BIGINT AS bytes, max(client)::DOUBLE AS seconds, count(DISTINCT client) AS hosts FROM requests GROUP BY event_type")
def result_json_read(spark, sf_dir):
    """Result documents of each host and step, read from files and merged by place."""
    r = trace.requests(spark, sf_dir).groupBy("event_type", "client").agg(F.count(F.lit(1)).alias("n"), F.sum("first_byte_us").alias("b"))
    status = F.when(F.col("event_type") == "error", "503").otherwise("200")
    cls = F.struct(F.lit("reads").alias("name"), F.col("b").alias("bytes"), F.create_map(status, F.col("n")).alias("statuses"))
    path = folder(spark, "results")
    r.select(F.col("event_type").alias("step"), F.col("client").alias("host"), F.col("client").cast("double").alias("seconds"), F.array(cls).alias("classes")).write.json(path)
    return documents.merge_results(spark.read.text(path), "value")


@query(
    with_views("requests", "")
    + """, h AS (SELECT client % 4 AS host, count(*) AS n, sum(first_byte_us)::BIGINT AS b, count(*) FILTER (WHERE event_type = 'error') AS e FROM requests GROUP BY 1)
SELECT 'h' || host AS host, round(100.0 * n / (n + b % 1000 + e), 6) AS cpu_busy_percent, round(b / 1073741824.0 / 60, 6) AS received_gib_s, round(2 * b / 1073741824.0 / 60, 6) AS sent_gib_s, round(n * 512 / 1073741824.0, 6) AS read_gib, round(e * 512 / 1073741824.0, 6) AS written_gib, round(100.0 * e / n, 6) AS retransmitted_percent, e::DOUBLE AS allowance_drops FROM h"""
)
def host_counters(spark, sf_dir):
    """Rates of hosts between two snapshots of the kernel's counters, written as text and read whole."""
    h = trace.requests(spark, sf_dir).groupBy((F.col("client") % 4).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum("first_byte_us").alias("b"), F.count_if(F.col("event_type") == "error").alias("e"))
    two = h.withColumn("moment", F.explode(F.array(F.lit("before"), F.lit("after"))))
    m = F.when(F.col("moment") == "after", 1).otherwise(0)
    n, b, e = (F.lit(7) + m * F.col(c) for c in ("n", "b", "e"))
    part = lambda title, *lines: F.concat(F.lit(f"== {title}\n"), *[x for line in lines for x in (line, F.lit("\n"))])
    text = F.concat(
        part("time", (F.lit(1000) + 60 * m).cast("string")),
        part("cpu", F.concat_ws(" ", F.lit("cpu"), n, F.lit(0), F.lit(0), m * (F.col("b") % 1000 + F.col("e")), F.lit(0))),
        part("net", F.concat_ws(" ", F.lit("eth0:"), b, *[F.lit(0)] * 7, F.lit(7) + m * F.col("b") * 2), F.concat_ws(" ", F.lit("lo:"), *[F.lit(9)] * 9)),
        part("tcp", F.lit("Tcp: OutSegs RetransSegs"), F.concat_ws(" ", F.lit("Tcp:"), n, e)),
        part("nic", F.concat(F.lit("  bw_in_allowance_exceeded: "), e), F.lit("  rx_drops: 3")),
        part("disk", F.concat_ws(" ", *map(F.lit, (8, 0, "sda", 1, 0)), n, *map(F.lit, (0, 1, 0)), e, F.lit(0))),
    )
    path = folder(spark, "kernel")
    two.select(F.concat(F.lit("h"), "host").alias("host"), "moment", F.base64(F.encode(text, "utf-8")).alias("body")).write.parquet(path)
    snapshots = spark.read.parquet(path).select("host", "moment", F.decode(F.unbase64("body"), "utf-8").alias("text"))
    return documents.host_rates(documents.kernel_table(snapshots, ["host", "moment"], "text"), ["host"])


@query(
    with_views("requests", "")
    + """, steps AS (SELECT event_type AS step, min(ts_ms) AS begins, max(ts_ms) AS ends FROM requests GROUP BY 1), f AS (SELECT CASE s_suppkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'none' END AS step, s_suppkey % 7 AS node, s_suppkey * 1000 AS after_ms, CASE s_suppkey % 4 WHEN 0 THEN 'kill' WHEN 1 THEN 'stop' WHEN 2 THEN 'restart' ELSE 'leave' END AS action FROM supplier)
SELECT step, node, action, begins + after_ms AS at_ms FROM steps LEFT JOIN f USING (step) WHERE after_ms IS NULL OR begins + after_ms <= ends"""
)
def fault_schedule(spark, sf_dir):
    """Faults planned at times of steps, as events of the ring; a step without faults keeps its row."""
    steps = trace.requests(spark, sf_dir).groupBy(F.col("event_type").alias("step")).agg(F.min("ts_ms").alias("begins"), F.max("ts_ms").alias("ends"))
    k = F.col("s_suppkey")
    step = F.when(k % 5 == 0, "click").when(k % 5 == 1, "view").when(k % 5 == 2, "error").when(k % 5 == 3, "signup").otherwise("none")
    action = F.when(k % 4 == 0, "kill").when(k % 4 == 1, "stop").when(k % 4 == 2, "restart").otherwise("leave")
    f = trace.read(spark, sf_dir, "supplier").select(step.alias("step"), (k % 7).alias("node"), (k * 1000).alias("after_ms"), action.alias("action"))
    at = (F.col("begins") + F.col("after_ms")).alias("at_ms")
    return steps.join(f, "step", "left").filter("after_ms is null or begins + after_ms <= ends").select("step", "node", "action", at)


COUNTS = {
    "reads": "method = 'GET'",
    "heads": "method = 'HEAD'",
    "writes": "method = 'PUT'",
    "whole_reads": "method = 'GET' AND kind = 'whole'",
    "ranged_reads": "method = 'GET' AND kind <> 'whole'",
    "suffix_reads": "method = 'GET' AND kind = 'suffix'",
    "open_reads": "method = 'GET' AND kind = 'from'",
    "invalid_ranges": "method = 'GET' AND kind = 'inclusive' AND b < a",
    "unsatisfiable": "method = 'GET' AND first IS NULL",
    "errors": "event_type = 'error'",
    "empty_objects": "size = 0",
    "single_block": "first // 256 = last // 256",
    "many_blocks": "last // 256 - first // 256 >= 4",
    "slow": "first_byte_us >= 200000",
}
SUMS = {"body_bytes": "last - first + 1", "blocks": "last // 256 - first // 256 + 1", "object_bytes": "size", "first_byte_us": "first_byte_us", "whole_blocks": "CASE WHEN last >= first THEN greatest((last + 1) // 256 - (first + 255) // 256, 0) END"}


@query(with_views("objects requests resolved", "") + " SELECT client % 4 AS node, " + ", ".join(f"count(*) FILTER (WHERE {t}) AS {n}" for n, t in COUNTS.items()) + ", " + ", ".join(f"coalesce(sum({e}), 0)::BIGINT AS {n}" for n, e in SUMS.items()) + " FROM resolved GROUP BY 1")
def node_counters(spark, sf_dir):
    """Sums of a node's counters, in one partial aggregate."""
    from ..functions.ranges import resolve

    j = trace.requests(spark, sf_dir).join(trace.objects(spark, sf_dir, etags=False), "doc_id")
    j = j.withColumn("r", resolve(F.col("kind"), F.col("a"), F.col("b"), F.col("size"))).withColumn("first", F.col("r.first")).withColumn("last", F.col("r.last"))
    sql = lambda e: F.expr(e.replace("//", "div"))
    return j.groupBy((F.col("client") % 4).alias("node")).agg(*[F.count_if(F.coalesce(sql(t), F.lit(False))).alias(n) for n, t in COUNTS.items()], *[F.coalesce(F.sum(sql(e)), F.lit(0)).alias(n) for n, e in SUMS.items()])


@query(
    with_views("objects requests resolved", "")
    + " SELECT req_id, CASE WHEN first = 0 AND last = size - 1 AND kind = 'whole' THEN 200 ELSE 206 END AS status, size AS object_size, first AS body_start, last + 1 AS body_end FROM resolved WHERE first IS NOT NULL"
)
def answer_shapes(spark, sf_dir):
    """What an answer's head tells of its object: the size from a 200's length or a 206's Content-Range, and the span of the body."""
    from ..functions import ranges as rg

    j = trace.requests(spark, sf_dir).join(trace.objects(spark, sf_dir, etags=False), "doc_id")
    j = j.withColumn("r", rg.resolve(F.col("kind"), F.col("a"), F.col("b"), F.col("size"))).filter("r.first is not null")
    status = F.when(F.col("kind") == "whole", 200).otherwise(206)
    head = F.when(status == 206, rg.format_content_range(F.col("r.first"), F.col("r.last"), F.col("size")))
    length = F.col("r.last") - F.col("r.first") + 1
    h = j.select("req_id", status.alias("status"), length.alias("content_length"), rg.parse_content_range(head).alias("c"))
    start = F.when(F.col("status") == 206, F.col("c.first")).otherwise(F.lit(0))
    return h.select("req_id", "status", F.when(F.col("status") == 206, F.col("c.size")).otherwise(F.col("content_length")).alias("object_size"), start.alias("body_start"), (start + F.col("content_length")).alias("body_end"))


@query(
    f"WITH {RECORDS}, f AS (SELECT version, block_index, min(slot) AS first FROM records WHERE valid AND len BETWEEN 1 AND 256 GROUP BY ALL), x AS (SELECT * FROM records JOIN f USING (version, block_index) WHERE valid AND len BETWEEN 1 AND 256 AND slot = first) "
    "SELECT 'block without object' AS finding, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = x.version AND p.p_size > 10) UNION ALL SELECT 'slot held twice', count(*) FROM (SELECT slot FROM x GROUP BY 1 HAVING count(*) > 1) UNION ALL "
    "SELECT 'restored record not sound', count(*) FROM x WHERE NOT valid"
)
def consistency_checks(spark, sf_dir):
    """Checks of a recovered store, each an anti-join or a count that tells what is amiss."""
    r = recovery.restored(slot_records(spark, sf_dir), ["version", "block_index"], "slot", LAYOUT.block).filter("restored")
    live = trace.read(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("version"))
    tell = lambda name, df: df.agg(F.lit(name).alias("finding"), F.count(F.lit(1)).alias("n"))
    a = tell("block without object", r.join(live, "version", "left_anti"))
    b = tell("slot held twice", r.groupBy("slot").count().filter("count > 1"))
    return a.unionByName(b).unionByName(tell("restored record not sound", r.filter("not valid")))


@query("SELECT p_partkey AS index, 'set/' || p_partkey AS key, p_size::BIGINT * 64 AS size FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def seed_again(spark, sf_dir):
    """A dataset is put into a folder, interrupted, and taken up again: only what is missing or has another size is put."""
    plan = trace.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"), F.concat(F.lit("set/"), "p_partkey").alias("key"), (F.col("p_size").cast("long") * 64).alias("size"))
    path = folder(spark, "seed")
    there = plan.filter("index % 3 > 0").withColumn("size", F.col("size") + (F.col("index") % 5 == 0).cast("long"))
    there.write.parquet(f"{path}/run=1")
    missing = plan.join(spark.read.parquet(f"{path}/run=1").select("key", "size"), ["key", "size"], "left_anti")
    missing.write.parquet(f"{path}/run=2")
    return spark.read.parquet(f"{path}/run=2").select("index", "key", "size")


@query(with_views("requests", "") + " SELECT event_type AS class, client % 3 AS place, count(*) AS n FROM requests GROUP BY ALL")
def loop_merge(spark, sf_dir):
    """Counts that loops keep in arrays, added place by place."""
    r = trace.requests(spark, sf_dir)
    place = lambda k: F.count_if(F.col("client") % 3 == k)
    loops = r.groupBy("event_type", (F.col("req_id") % 4).alias("loop")).agg(F.array(*map(place, range(3))).alias("counts"))
    e = loops.select(F.col("event_type").alias("class"), F.posexplode("counts").alias("place", "n"))
    return e.groupBy("class", F.col("place").cast("long").alias("place")).agg(F.sum("n").alias("n")).filter("n > 0")


@query(with_views("requests", "") + " SELECT doc_id, count(*) AS times FROM (SELECT doc_id, client % 5 AS hash FROM requests WHERE method = 'GET' EXCEPT ALL SELECT doc_id, client % 5 FROM requests WHERE method = 'PUT') GROUP BY doc_id")
def ghost_multiset(spark, sf_dir):
    """Hashes remembered with their counts: each leaving takes one occurrence, and one is there while any is left."""
    r = trace.requests(spark, sf_dir).select("doc_id", (F.col("client") % 5).alias("hash"), "method")
    left = r.filter("method = 'GET'").drop("method").exceptAll(r.filter("method = 'PUT'").drop("method"))
    return left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))


@query(
    with_views("objects", "")
    + """, s AS (SELECT key, doc_id // 4 % 3 AS node, size - 8 - size // 4 AS first, size - 8 AS stop FROM objects WHERE doc_id % 4 = 0 AND size - 8 - size // 4 >= 4 AND size // 4 > 0),
b AS (SELECT key, node, i, 256 AS len FROM (SELECT key, node, unnest(range(first // 256, (stop - 1) // 256 + 1)) AS i FROM s)), r AS (SELECT key, node, min(i) AS lo, count(*) AS blocks, sum(len)::BIGINT AS bytes FROM b GROUP BY ALL)
SELECT key, node, lo, blocks, sum(bytes) OVER (PARTITION BY node ORDER BY key) <= 16384 AS planned FROM r"""
)
def prefetch_plan(spark, sf_dir):
    """Metadata blocks of Parquet objects to fetch ahead: one run each, in order of keys while the budget of their node lasts."""
    o = trace.objects(spark, sf_dir, etags=False).filter("doc_id % 4 = 0")
    footer = F.floor(F.col("size") / 4)
    s = o.withColumn("first", F.col("size") - 8 - footer).withColumn("stop", F.col("size") - 8).filter((F.col("first") >= 4) & (footer > 0))
    b = s.select("key", (F.floor(F.col("doc_id") / 4) % 3).alias("node"), F.explode(LAYOUT.blocks(F.col("first"), F.col("stop") - 1)).alias("block_index"), F.lit(None).cast("long").alias("chunk"))
    r = readpath.fill_runs(b, ["key", "node"], 1 << 20).select("key", "node", "lo", "blocks")
    total = F.sum(F.col("blocks") * LAYOUT.block).over(Window.partitionBy("node").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    return r.select("key", "node", "lo", "blocks", (total <= 16384).alias("planned"))


#: Earlier names of queries that had a part of their tables under the plain name.
for _name, _is in {"event_parse_all": "event_parse", "history_violations_all": "history_violations", "versions_scan_all": "versions_scan", "answered_by_all": "answered_by", "verify_blocks_on_hit": "verify_on_hit"}.items():
    QUERIES[_name], ORACLES[_name] = QUERIES[_is], ORACLES[_is]
