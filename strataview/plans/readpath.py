"""More of the catalogue: the read path, datasets, and documents from outside."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranges as rg
from ..operators import authorize, datasets, history, placement, readpath
from ..sources import documents, trace
from ..sources.trace import with_views
from .catalogue import LAYOUT, NEEDS, RANKED, blocks_of, places_of, query

@query(
    with_views("requests", "")
    + """, h AS (SELECT req_id, CASE req_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 206 ELSE 404 END AS status, req_id % 2 = 0 AS sums, req_id % 5 = 0 AS over FROM requests)
SELECT req_id, CASE WHEN NOT (over AND status < 300) THEN 'Content-Type=t;' ELSE '' END || CASE WHEN sums AND status = 200 THEN 'X-Amz-Checksum-Crc32=c;' ELSE '' END || 'x-amz-meta-a=m;' || CASE WHEN over AND status < 300 THEN 'content-type=o;' ELSE '' END AS shown FROM h"""
)
def header_selection(spark, sf_dir):
    r = trace.requests(spark, sf_dir).select("req_id")
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"))
    headers = F.array(pair("Content-Type", "t"), pair("X-Amz-Checksum-Crc32", "c"), pair("x-amz-meta-a", "m"), pair("Server", "s"))
    over = F.when(F.col("req_id") % 5 == 0, F.array(pair("content-type", "o"))).otherwise(F.expr("cast(array() as array<struct<name:string,value:string>>)"))
    status = F.when(F.col("req_id") % 3 == 0, 200).when(F.col("req_id") % 3 == 1, 206).otherwise(404)
    shown = readpath.kept_headers(headers, status, F.col("req_id") % 2 == 0, over)
    return r.select("req_id", F.array_join(F.transform(shown, lambda h: F.concat(h["name"], F.lit("="), h["value"], F.lit(";"))), "").alias("shown"))


@query(with_views("objects requests resolved", "") + " SELECT req_id, kind, first = req_id % 3 AND last = size - 1 AS exact FROM resolved WHERE first IS NOT NULL AND kind <> 'whole' AND NOT coalesce(kind = 'inclusive' AND b < a, false)")
def answered_by(spark, sf_dir):
    """Whether a partial answer carries exactly the bytes asked for, whatever kind of range that was."""
    j = trace.requests(spark, sf_dir).join(trace.objects(spark, sf_dir, etags=False), "doc_id")
    j = j.filter((F.col("kind") != "whole") & rg.is_valid(F.col("kind"), F.col("a"), F.col("b")))
    j = j.withColumn("r", rg.resolve(F.col("kind"), F.col("a"), F.col("b"), F.col("size"))).filter("r.first is not null")
    got = rg.parse_content_range(rg.format_content_range(F.col("req_id") % 3, F.col("size") - 1, F.col("size")))
    return j.select("req_id", "kind", ((got["first"] == F.col("r.first")) & (got["last"] == F.col("r.last"))).alias("exact"))


@query(with_views("requests objects grants", "") + f", {NEEDS} SELECT req_id FROM needs n WHERE need = 2 AND EXISTS (SELECT 1 FROM grants g WHERE g.client = n.client AND (g.bucket = '*' OR g.bucket = n.bucket) AND g.level >= 2 AND starts_with(n.key, g.prefix)) AND EXISTS (SELECT 1 FROM grants g WHERE g.client = n.client AND (g.bucket = '*' OR g.bucket = 'docs') AND g.level >= 1 AND starts_with('en/source', g.prefix))")
def copies_authorized(spark, sf_dir):
    """A copy needs write on its target and read on its source."""
    j = trace.requests(spark, sf_dir).filter("method = 'PUT'").join(trace.objects(spark, sf_dir, etags=False), "doc_id")
    n = j.select("req_id", "client", "bucket", "key", F.lit(2).alias("need"))
    g = trace.grants(spark, sf_dir)
    may = authorize.covered(n, g, "left_semi").withColumn("key", F.lit("en/source")).withColumn("need", F.lit(1))
    return authorize.covered(may, g, "left_semi").select("req_id")


RUNS = """, n AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY block_index) - row_number() OVER (PARTITION BY req_id, chunk ORDER BY block_index) AS island FROM blocks),
runs AS (SELECT req_id, chunk, min(block_index) AS lo, count(*) * 256 AS len FROM n GROUP BY req_id, chunk, island)"""


def _runs(spark, sf_dir):
    from ..functions.layout import runs

    r = runs(blocks_of(spark, sf_dir).select("req_id", "key", "block_index", "chunk"), ["req_id", "key"])
    return r.select("req_id", "key", "chunk", "lo", ((F.col("hi") - F.col("lo") + 1) * 256).alias("len"))


@query(with_views("objects requests resolved gets blocks", "") + RUNS + " SELECT req_id, lo, len, row_number() OVER w = 1 OR sum(len) OVER w <= 4096 AS asked FROM runs WINDOW w AS (PARTITION BY req_id ORDER BY lo)")
def read_ahead_window(spark, sf_dir):
    return readpath.read_ahead(_runs(spark, sf_dir), ["req_id"], "lo", "len", 4096).select("req_id", "lo", "len", "asked")


@query(None)
def owner_groups(spark, sf_dir):
    """Runs grouped by owner, at most 2048 bytes a group."""
    r = _runs(spark, sf_dir).withColumn("c", F.coalesce("chunk", F.lit(-1)))
    o = placement.owners(places_of(spark, sf_dir), trace.ring(spark, sf_dir, 4)).select("key", F.coalesce("chunk", F.lit(-1)).alias("c"), F.col("node_id").alias("node"))
    return readpath.owner_groups(r.join(o, ["key", "c"]).select("req_id", "lo", "node", "len"), ["req_id"], 2048)


@query(
    with_views("objects requests resolved gets blocks", "")
    + """, m AS (SELECT * FROM blocks WHERE (block_index * 7 + req_id) % 5 <> 0), p AS (SELECT *, CASE WHEN lag(block_index) OVER w = block_index - 1 AND lag(coalesce(chunk, -1)) OVER w = coalesce(chunk, -1) THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY req_id ORDER BY block_index)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY req_id ORDER BY block_index) AS isl FROM p), k AS (SELECT *, (row_number() OVER (PARTITION BY req_id, isl ORDER BY block_index) - 1) // 4 AS k FROM i) SELECT req_id, min(block_index) AS lo, count(*) AS blocks FROM k GROUP BY req_id, isl, k"""
)
def fill_runs(spark, sf_dir):
    m = blocks_of(spark, sf_dir).filter("(block_index * 7 + req_id) % 5 <> 0")
    return readpath.fill_runs(m, ["req_id"], 4).select("req_id", "lo", "blocks")


@query(with_views("requests", "") + " SELECT req_id, doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ts_ms, req_id) - 1) % 3 AS turn FROM requests WHERE method = 'GET'")
def round_robin_spread(spark, sf_dir):
    r = trace.requests(spark, sf_dir).filter("method = 'GET'").select("req_id", "doc_id", "ts_ms")
    return readpath.round_robin(r, ["doc_id"], ["ts_ms", "req_id"], 3).select("req_id", "doc_id", "turn")


@query(with_views("objects requests resolved gets blocks ring4 places", "") + f", {RANKED} SELECT key, chunk, node_id, row_number() OVER (PARTITION BY key, chunk ORDER BY (node_id IN (2, 4))::INT, rank) AS place FROM ranked")
def avoided_last(spark, sf_dir):
    c = placement.candidates(places_of(spark, sf_dir), trace.ring(spark, sf_dir, 4)).withColumn("avoided", F.col("node_id").isin(2, 4).cast("int"))
    return c.select("key", "chunk", "node_id", F.row_number().over(Window.partitionBy("key", "chunk").orderBy("avoided", "rank")).alias("place"))


@query("SELECT l_suppkey % 4 AS node, min_by(l_partkey % 50, (held, l_partkey % 50)) AS extent FROM (SELECT l_suppkey % 4 AS l_suppkey, l_partkey % 50 AS l_partkey, count(*) AS held FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def fewest_blocks(spark, sf_dir):
    """Of each node's extents the one with the fewest blocks, the first of equals."""
    l = trace.read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("node"), (F.col("l_partkey") % 50).alias("extent")).agg(F.count(F.lit(1)).alias("held"))
    return l.groupBy("node").agg(F.min_by("extent", F.struct("held", "extent")).alias("extent"))


@query("SELECT c_custkey % 20 AS id, min_by(c_nationkey, c_custkey) AS weight FROM customer GROUP BY 1")
def member_dedup(spark, sf_dir):
    """Members sorted by id, the first of each kept."""
    return trace.read(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 20).alias("id")).agg(F.min_by("c_nationkey", "c_custkey").alias("weight"))


@query("SELECT e.event_type AS step, f.fault, count(*) AS n FROM events e LEFT JOIN (VALUES ('click', 'kill'), ('view', 'restart'), ('view', 'leave')) f(step, fault) ON f.step = e.event_type GROUP BY ALL")
def faults_of_steps(spark, sf_dir):
    f = spark.createDataFrame([("click", "kill"), ("view", "restart"), ("view", "leave")], "step string, fault string")
    e = trace.read(spark, sf_dir, "events").select(F.col("event_type").alias("step"))
    return e.groupBy("step").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(f), "step", "left").select("step", "fault", "n")


@query(with_views("requests states", "") + " SELECT doc_id, count(*) AS versions, count(etag) AS live, min(valid_from) AS since FROM states GROUP BY doc_id")
def versions_scan(spark, sf_dir):
    return trace.object_states(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("versions"), F.count("etag").alias("live"), F.min("valid_from").alias("since"))


@query(with_views("requests", "") + " SELECT client % 4 AS host, max(ts_ms) - min(ts_ms) AS elapsed_ms, round(sum(first_byte_us) * 1000.0 / (max(ts_ms) - min(ts_ms)), 6) AS rate, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_percent FROM requests GROUP BY 1")
def host_rates(spark, sf_dir):
    r = trace.requests(spark, sf_dir)
    span = F.max("ts_ms") - F.min("ts_ms")
    return r.groupBy((F.col("client") % 4).alias("host")).agg(span.alias("elapsed_ms"), F.round(F.sum("first_byte_us") * 1000.0 / span, 6).alias("rate"), F.round(100.0 * F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)), 6).alias("error_percent"))


@query(
    with_views("requests", "")
    + """, c AS (SELECT doc_id % 10 AS node, ts_ms AS s, ts_ms + 3600000 AS e FROM requests WHERE event_type = 'signup'), n AS (SELECT *, max(e) OVER (PARTITION BY node ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
 i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM n) SELECT node, min(s) AS previous_ring_since, max(e) AS fallback_until, count(*) AS changes FROM i GROUP BY node, isl"""
)
def fallback_windows(spark, sf_dir):
    """Ring changes extend a fallback window that keeps the oldest ring before them."""
    c = trace.requests(spark, sf_dir).filter("event_type = 'signup'").select((F.col("doc_id") % 10).alias("node"), F.col("ts_ms").alias("s"), (F.col("ts_ms") + 3600000).alias("e"))
    return history.islands(c, "node", "s", "e").select("node", F.col("flight_start").alias("previous_ring_since"), F.col("flight_end").alias("fallback_until"), F.col("members").alias("changes"))


@query(with_views("requests", "") + " SELECT req_id, coalesce(w > p, false) AS dropped FROM (SELECT req_id, method, (SELECT max(x.ts_ms) FROM requests x WHERE x.doc_id = r.doc_id AND x.method = 'PUT' AND x.ts_ms < r.ts_ms) AS w, (SELECT max(x.ts_ms) FROM requests x WHERE x.doc_id = r.doc_id AND x.method <> 'PUT' AND x.ts_ms < r.ts_ms) AS p FROM requests r) WHERE method <> 'PUT' AND p IS NOT NULL")
def write_invalidation(spark, sf_dir):
    """Reads whose metadata a write had dropped since the read before."""
    r = trace.requests(spark, sf_dir).select("req_id", "doc_id", "ts_ms", "method")
    w = Window.partitionBy("doc_id").orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("w", readpath.last_write_before(r, ["doc_id"])).withColumn("p", F.max(F.when(F.col("method") != "PUT", F.col("ts_ms"))).over(w))
    return r.filter("method <> 'PUT' and p is not null").select("req_id", F.coalesce(F.col("w") > F.col("p"), F.lit(False)).alias("dropped"))


@query(
    with_views("objects requests", "")
    + ", u AS (SELECT r.req_id, o.size, unnest(range(0, (size + 255) // 256)) AS i FROM requests r JOIN objects o USING (doc_id) WHERE method = 'PUT' AND size > 0) SELECT req_id, count(*) AS blocks, sum(least((i + 1) * 256, size) - i * 256)::BIGINT AS bytes FROM u WHERE i < 4 OR (i + 1) * 256 > greatest(size - 1024, 0) GROUP BY req_id"
)
def warm_on_write(spark, sf_dir):
    """What the home keeps of each upload: its region's blocks."""
    u = trace.requests(spark, sf_dir).filter("method = 'PUT'").join(trace.objects(spark, sf_dir, etags=False).filter("size > 0"), "doc_id")
    u = u.select("req_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), LAYOUT.count(F.col("size")) - 1)).alias("i"))
    home = u.filter(LAYOUT.chunk_of(F.col("i"), F.col("size")).isNull())
    return home.groupBy("req_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.least((F.col("i") + 1) * 256, F.col("size")) - F.col("i") * 256).alias("bytes"))


@query("SELECT doc_id, i AS block_index, md5(b) = md5(CASE WHEN (doc_id + i) % 7 = 0 THEN 'damaged' ELSE b END) AS verified FROM (SELECT doc_id, i, substr(text, i * 256 + 1, 256) AS b FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 255) // 256)) AS i FROM documents))")
def verify_on_hit(spark, sf_dir):
    """Checksums of every block of the whole texts against the bytes found; some blocks of some objects are damaged."""
    d = trace.read(spark, sf_dir, "documents")
    stored = readpath.text_blocks(d.select("doc_id", "text"), "text", LAYOUT.block)
    got = F.when((F.col("doc_id") + F.col("block_index")) % 7 == 0, F.lit("damaged")).otherwise(F.col("block"))
    return stored.select("doc_id", "block_index", (F.md5("block") == F.md5(got)).alias("verified"))


@query(
    with_views("requests states", "")
    + " SELECT req_id, CASE WHEN req_id % 10 = 0 THEN 'keep' WHEN etag IS NULL THEN 'forget' WHEN validated >= valid_from THEN 'refresh' ELSE 'replace' END AS outcome FROM (SELECT r.req_id, r.ts_ms - 86400000 AS validated, s.etag, s.valid_from FROM requests r JOIN states s ON s.doc_id = r.doc_id AND s.valid_from <= r.ts_ms AND (s.valid_to IS NULL OR s.valid_to > r.ts_ms) WHERE r.method = 'HEAD')"
)
def revalidation(spark, sf_dir):
    """What a check of metadata a day old finds: unchanged, new, gone, or an origin that fails."""
    r = trace.requests(spark, sf_dir).filter("method = 'HEAD'").select("req_id", "doc_id", "ts_ms")
    a = history.as_of(r, trace.object_states(spark, sf_dir), "doc_id", "ts_ms", "valid_from", "etag", "req_id").filter("state_since is not null")
    out = F.when(F.col("req_id") % 10 == 0, "keep").when(F.col("state_value").isNull(), "forget").when(F.col("ts_ms") - 86400000 >= F.col("state_since"), "refresh").otherwise("replace")
    return a.select("req_id", out.alias("outcome"))


@query(with_views("objects", "") + " SELECT p_partkey AS index, 'set/' || p_partkey AS key, p_size::BIGINT * 64 AS size FROM part p WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.doc_id = p.p_partkey AND o.size = p.p_size * 64)")
def seed_resume(spark, sf_dir):
    """Objects still to be put: those there already with the same size are left out."""
    p = trace.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"), F.concat(F.lit("set/"), "p_partkey").alias("key"), (F.col("p_size").cast("long") * 64).alias("size")).alias("p")
    o = trace.objects(spark, sf_dir, etags=False).alias("o")
    return p.join(o, (F.col("o.doc_id") == F.col("p.index")) & (F.col("o.size") == F.col("p.size")), "left_anti")


@query("SELECT s_suppkey AS host, (1000003 // 7 + (s_suppkey < 1000003 % 7)::INT)::BIGINT AS requests FROM supplier WHERE s_suppkey < 7")
def step_share(spark, sf_dir):
    s = trace.read(spark, sf_dir, "supplier").filter("s_suppkey < 7")
    return s.select(F.col("s_suppkey").alias("host"), (F.lit(1000003 // 7) + (F.col("s_suppkey") < 1000003 % 7).cast("int")).cast("long").alias("requests"))


@query(with_views("requests", "") + " SELECT doc_id, max(ts_ms + 60000) AS until, count(*) AS hints FROM requests WHERE method = 'GET' AND ts_ms + 60000 > 1705000000000 AND ts_ms <= 1705000000000 + 86400000 GROUP BY doc_id")
def hot_hints(spark, sf_dir):
    """Hints that still hold at a time, the latest expiry of each placement."""
    r = trace.requests(spark, sf_dir).filter("method = 'GET' and ts_ms + 60000 > 1705000000000 and ts_ms <= 1705000000000 + 86400000")
    return r.groupBy("doc_id").agg(F.max(F.col("ts_ms") + 60000).alias("until"), F.count(F.lit(1)).alias("hints"))


@query(with_views("requests", "") + " SELECT event_type AS step, 0 AS place, 'reads' AS class, CASE event_type WHEN 'error' THEN '503' ELSE '200' END AS status, count(*) AS n, sum(first_byte_us)::BIGINT AS bytes, max(client)::DOUBLE AS seconds, count(DISTINCT client) AS hosts FROM requests GROUP BY event_type")
def result_json_merge(spark, sf_dir):
    """Per-host result documents (made here) read and merged."""
    r = trace.requests(spark, sf_dir).groupBy("event_type", "client").agg(F.count(F.lit(1)).alias("n"), F.sum("first_byte_us").alias("b"))
    status = F.when(F.col("event_type") == "error", "503").otherwise("200")
    cls = F.struct(F.lit("reads").alias("name"), F.col("b").alias("bytes"), F.create_map(status, F.col("n")).alias("statuses"))
    body = F.to_json(F.struct(F.col("event_type").alias("step"), F.col("client").alias("host"), F.col("client").cast("double").alias("seconds"), F.array(cls).alias("classes")))
    return documents.merge_results(r.select(body.alias("body")), "body")


@query("SELECT event_id, (event_id % 9)::DOUBLE AS get_requests, (event_id % 4) / 2.0 AS errors FROM events")
def cloudwatch_json(spark, sf_dir):
    e = trace.read(spark, sf_dir, "events").select("event_id", F.format_string('{"GetRequests": %d, "4xxErrors": %s}', F.col("event_id") % 9, ((F.col("event_id") % 4) / 2).cast("string")).alias("body"))
    m = e.withColumn("m", documents.flat_metrics(F.col("body")))
    return m.select("event_id", F.col("m")["GetRequests"].alias("get_requests"), F.col("m")["4xxErrors"].alias("errors"))


@query(None)
def xml_key_list(spark, sf_dir):
    o = trace.objects(spark, sf_dir, etags=False)
    body = F.concat(F.lit('<D xmlns="x"><Object><Key>'), "key", F.lit("</Key></Object><Object><Key>a&amp;b</Key></Object>"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("</D>"))
    return o.select("doc_id", documents.xml_keys(body).alias("keys"))


@query(None)
def dataset_objects(spark, sf_dir):
    return datasets.objects(spark, "load", "small", 2000, 7, 4096, 262144)


@query(None)
def zipf_sample(spark, sf_dir):
    return datasets.zipf_draws(spark, 20000, 1000, 1.0, 5).groupBy("rank").agg(F.count(F.lit(1)).alias("draws"))
