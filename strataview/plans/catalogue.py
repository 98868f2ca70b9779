"""Catalogue of queries over the trace views, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import layout as lay
from ..functions import ranges as rg
from ..functions import requests as rq
from ..functions import units
from ..functions.hashing import portable
from ..operators import admission, authorize, history, metrics, placement, workload
from ..sources import trace
from ..sources.trace import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LAYOUT = lay.Layout(256, 4)


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# -- plans over requests, objects and rings ---------------------------------------------------------------------------


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trace.gets(spark, sf_dir)
    b = g.select("req_id", "ts_ms", "client", "key", "size", "first", "last", F.explode(LAYOUT.blocks(F.col("first"), F.col("last"))).alias("block_index"))
    return b.withColumn("chunk", LAYOUT.chunk_of(F.col("block_index"), F.col("size")))


def places_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(spark, sf_dir).select("key", "chunk").distinct()


OWNED = """owned AS (SELECT key, chunk, max_by(node_id, (score, node_id)) AS node_id FROM (
  SELECT p.key, p.chunk, r.node_id, r.weight / -ln((('0x' || substr(md5(p.key || '#' || coalesce(p.chunk, -1) || '@' || r.node_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS score FROM places p CROSS JOIN ring4 r) GROUP BY key, chunk)"""
RANKED = """ranked AS (SELECT key, chunk, node_id, row_number() OVER (PARTITION BY key, chunk ORDER BY score DESC, node_id DESC) AS rank FROM (
  SELECT p.key, p.chunk, r.node_id, r.weight / -ln((('0x' || substr(md5(p.key || '#' || coalesce(p.chunk, -1) || '@' || r.node_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS score FROM places p CROSS JOIN ring4 r))"""


@query(
    with_views("objects requests resolved gets blocks ring4 places", "")
    + f", {OWNED} SELECT node_id, count(DISTINCT req_id) AS reads, count(*) AS blocks, sum(least((block_index + 1) * 256 - 1, last) - greatest(block_index * 256, first) + 1)::BIGINT AS bytes FROM blocks b JOIN owned o ON b.key = o.key AND b.chunk IS NOT DISTINCT FROM o.chunk GROUP BY node_id"
)
def flagship_node_load(spark, sf_dir):
    """Reads, blocks and bytes each node of a weighted ring serves."""
    j = placement.with_owner(blocks_of(spark, sf_dir), trace.ring(spark, sf_dir, 4))
    size = F.least((F.col("block_index") + 1) * 256 - 1, F.col("last")) - F.greatest(F.col("block_index") * 256, F.col("first")) + 1
    return j.groupBy("node_id").agg(F.count_distinct("req_id").alias("reads"), F.count(F.lit(1)).alias("blocks"), F.sum(size).alias("bytes"))


@query(with_views("objects requests resolved", "SELECT req_id, kind, NOT coalesce(kind = 'inclusive' AND b < a, false) AS valid, first, last FROM resolved"))
def range_resolve(spark, sf_dir):
    j = trace.requests(spark, sf_dir).join(trace.objects(spark, sf_dir, etags=False), "doc_id")
    r = rg.resolve(F.col("kind"), F.col("a"), F.col("b"), F.col("size"))
    return j.withColumn("r", r).select("req_id", "kind", rg.is_valid(F.col("kind"), F.col("a"), F.col("b")).alias("valid"), F.col("r.first").alias("first"), F.col("r.last").alias("last"))


HEADER = "CASE req_id % 7 WHEN 0 THEN 'bytes=' || a || '-' || coalesce(b, a + 5) WHEN 1 THEN 'bytes=' || a || '-' WHEN 2 THEN 'bytes=-' || a WHEN 3 THEN 'bytes=1-2,4-5' WHEN 4 THEN 'items=1-2' WHEN 5 THEN '  bytes= ' || a || ' - ' || (a + 9) || ' ' ELSE 'bytes=-' END"


@query(
    with_views("requests", "")
    + f", h AS (SELECT req_id, {HEADER} AS header FROM requests), p AS (SELECT req_id, header, regexp_extract(trim(header), '^bytes=([^,]*)$', 1) AS spec FROM h), "
    "q AS (SELECT *, try_cast(nullif(regexp_extract(spec, '^\\s*(\\d*)\\s*-\\s*(\\d*)\\s*$', 1), '') AS BIGINT) AS lo, try_cast(nullif(regexp_extract(spec, '^\\s*(\\d*)\\s*-\\s*(\\d*)\\s*$', 2), '') AS BIGINT) AS hi FROM p), "
    "k AS (SELECT *, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN 'inclusive' WHEN lo IS NOT NULL THEN 'from' WHEN hi IS NOT NULL THEN 'suffix' END AS kind FROM q) "
    "SELECT req_id, kind, CASE WHEN kind = 'suffix' THEN hi WHEN kind IS NOT NULL THEN lo END AS a, CASE WHEN kind = 'inclusive' THEN hi END AS b, "
    "CASE kind WHEN 'inclusive' THEN 'bytes=' || lo || '-' || hi WHEN 'from' THEN 'bytes=' || lo || '-' WHEN 'suffix' THEN 'bytes=-' || hi END AS formatted FROM k"
)
def range_header_parse(spark, sf_dir):
    r = trace.requests(spark, sf_dir).select("req_id", F.expr(HEADER.replace("||", "||")).alias("header"))
    p = r.withColumn("p", rg.parse_range(F.col("header"))).select("req_id", "p.*")
    return p.withColumn("formatted", rg.format_range(F.col("kind"), F.col("a"), F.col("b")))


@query(
    with_views("objects requests resolved", "")
    + ", c AS (SELECT req_id, CASE WHEN req_id % 9 = 0 THEN 'bytes */' || size ELSE 'bytes ' || first || '-' || last || '/' || size END AS text FROM resolved WHERE first IS NOT NULL) "
    "SELECT req_id, text, try_cast(nullif(regexp_extract(text, '^bytes (\\d+)-(\\d+)/(\\d+)$', 1), '') AS BIGINT) AS first, try_cast(nullif(regexp_extract(text, '^bytes (\\d+)-(\\d+)/(\\d+)$', 2), '') AS BIGINT) AS last, try_cast(nullif(regexp_extract(text, '^bytes (\\d+)-(\\d+)/(\\d+)$', 3), '') AS BIGINT) AS size FROM c"
)
def content_range_round_trip(spark, sf_dir):
    j = trace.requests(spark, sf_dir).join(trace.objects(spark, sf_dir, etags=False), "doc_id")
    j = j.withColumn("r", rg.resolve(F.col("kind"), F.col("a"), F.col("b"), F.col("size"))).filter("r.first is not null")
    text = F.when(F.col("req_id") % 9 == 0, F.concat(F.lit("bytes */"), "size")).otherwise(rg.format_content_range(F.col("r.first"), F.col("r.last"), F.col("size")))
    return j.select("req_id", text.alias("text")).withColumn("p", rg.parse_content_range(F.col("text"))).select("req_id", "text", "p.*")


CONDITIONED = """conditioned AS (SELECT *, CASE WHEN req_id % 11 = 0 THEN '"other"' WHEN req_id % 11 = 1 THEN etag END AS if_match, CASE WHEN req_id % 13 = 0 THEN etag WHEN req_id % 13 = 1 THEN '"old"' END AS if_none_match FROM resolved WHERE method <> 'PUT'),
answered AS (SELECT *, CASE WHEN if_match IS NOT NULL AND if_match <> etag THEN 412 WHEN if_none_match = etag THEN 304 END AS cond FROM conditioned)"""


def _conditioned(spark, sf_dir):
    j = trace.requests(spark, sf_dir).filter("method <> 'PUT'").join(trace.objects(spark, sf_dir), "doc_id")
    i = F.col("req_id")
    return j.withColumn("if_match", F.when(i % 11 == 0, '"other"').when(i % 11 == 1, F.col("etag"))).withColumn("if_none_match", F.when(i % 13 == 0, F.col("etag")).when(i % 13 == 1, '"old"'))


@query(with_views("objects requests resolved", "") + f", {CONDITIONED} SELECT req_id, cond AS condition_status FROM answered")
def precondition_status(spark, sf_dir):
    return _conditioned(spark, sf_dir).select("req_id", rg.precondition(F.col("if_match"), F.col("if_none_match"), F.col("etag")).alias("condition_status"))


@query(
    with_views("objects requests resolved", "")
    + f", {CONDITIONED}, s AS (SELECT *, CASE WHEN cond IS NOT NULL THEN cond WHEN NOT ignored AND first IS NULL THEN 416 WHEN NOT ignored THEN 206 ELSE 200 END AS status FROM answered) "
    "SELECT req_id, status, CASE WHEN status IN (200, 206) AND method = 'GET' THEN first END AS first, CASE WHEN status IN (200, 206) AND method = 'GET' AND first IS NOT NULL THEN last END AS last, CASE WHEN status IN (200, 206) THEN coalesce(last - first + 1, 0) END AS content_length FROM s"
)
def answer_status(spark, sf_dir):
    c = _conditioned(spark, sf_dir)
    return c.select("req_id", rg.answer(*map(F.col, ["method", "kind", "a", "b", "if_match", "if_none_match", "etag", "size"])).alias("r")).select("req_id", "r.*")


@query(
    with_views("objects requests resolved", "")
    + f", {CONDITIONED}, s AS (SELECT CASE WHEN cond IS NOT NULL THEN cond WHEN NOT ignored AND first IS NULL THEN 416 WHEN NOT ignored THEN 206 ELSE 200 END AS status FROM answered) "
    "SELECT status, CASE status WHEN 412 THEN 'PreconditionFailed' WHEN 416 THEN 'InvalidRange' ELSE 'InternalError' END AS code, CASE status WHEN 412 THEN 'At least one of the pre-conditions you specified did not hold' WHEN 416 THEN 'The requested range is not satisfiable' ELSE 'We encountered an internal error. Please try again.' END AS message, count(*) AS n FROM s WHERE status >= 400 GROUP BY ALL"
)
def error_bodies(spark, sf_dir):
    c = _conditioned(spark, sf_dir).select(rg.answer(*map(F.col, ["method", "kind", "a", "b", "if_match", "if_none_match", "etag", "size"]))["status"].alias("status")).filter("status >= 400")
    code = rg.by_status(F.col("status"), rg.ERROR_CODES, "InternalError")
    return c.groupBy("status", code.alias("code"), rg.by_status(F.col("status"), rg.ERROR_MESSAGES, "We encountered an internal error. Please try again.").alias("message")).agg(F.count(F.lit(1)).alias("n"))


TAGS = "CASE req_id % 6 WHEN 0 THEN '*' WHEN 1 THEN '\"a\",\"b\"' WHEN 2 THEN 'W/\"a\"' WHEN 3 THEN ' bare' || req_id || ' ' WHEN 4 THEN '\"q' || req_id || '\"' END"


@query(
    with_views("requests", "")
    + f", t AS (SELECT req_id, trim({TAGS}) AS v FROM requests), u AS (SELECT *, (v = '*' OR contains(v, ',') OR starts_with(v, 'W/')) AS bad FROM t) "
    "SELECT req_id, coalesce(NOT bad, true) AS usable, CASE WHEN NOT bad THEN CASE WHEN starts_with(v, '\"') THEN v ELSE '\"' || v || '\"' END END AS etag FROM u"
)
def etag_conditions(spark, sf_dir):
    return trace.requests(spark, sf_dir).select("req_id", rg.etag_condition(F.expr(TAGS)).alias("t")).select("req_id", "t.*")


METHOD = "CASE req_id % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'PUT' WHEN 2 THEN 'POST' WHEN 3 THEN 'DELETE' ELSE 'HEAD' END"
QUERY = "CASE req_id % 12 WHEN 0 THEN '' WHEN 1 THEN 'x-id=GetObject' WHEN 2 THEN 'uploadId=9&partNumber=1' WHEN 3 THEN 'uploads' WHEN 4 THEN 'delete' WHEN 5 THEN 'prefix=a&max-keys=3' WHEN 6 THEN 'acl' WHEN 7 THEN 'response-expires=1&&x-id=z' WHEN 8 THEN 'versionId=3' WHEN 9 THEN 'x-purge' WHEN 10 THEN 'location' ELSE 'prefix=a&prefix=b' END"
OPS = f"""ops AS (SELECT req_id, {METHOD} AS method, req_id % 3 <> 0 AS has_key, req_id % 17 = 0 AS copies, {QUERY} AS query, list_transform(list_filter(string_split({QUERY}, '&'), lambda p: p <> ''), lambda p: string_split(p, '=')[1]) AS params FROM requests)"""


def _ops(spark, sf_dir):
    r = trace.requests(spark, sf_dir).select("req_id", F.expr(METHOD).alias("method"), F.expr("req_id % 3 <> 0").alias("has_key"), F.expr("req_id % 17 = 0").alias("copies"), F.expr(QUERY).alias("query"))
    return r.withColumn("params", rq.names(F.col("query")))


def _only(allowed: list[str]) -> str:
    return "len(list_filter(params, lambda p: NOT list_contains([" + ", ".join(f"'{a}'" for a in allowed) + "], p))) = 0"


@query(
    with_views("requests", "")
    + f""", {OPS} SELECT req_id, CASE WHEN method = 'GET' AND has_key AND {_only(rq.READ_PARAMETERS)} THEN 'GetObject' WHEN method = 'HEAD' AND has_key AND {_only(rq.READ_PARAMETERS)} THEN 'HeadObject'
 WHEN method = 'PUT' AND has_key AND list_contains(params, 'uploadId') THEN 'UploadPart' WHEN method = 'PUT' AND has_key AND {_only(["x-id"])} AND copies THEN 'CopyObject' WHEN method = 'PUT' AND has_key AND {_only(["x-id"])} THEN 'PutObject'
 WHEN method = 'DELETE' AND has_key AND list_contains(params, 'uploadId') THEN 'AbortMultipartUpload' WHEN method = 'DELETE' AND has_key AND {_only(["x-id", "versionId"])} THEN 'DeleteObject'
 WHEN method = 'POST' AND has_key AND list_contains(params, 'uploads') THEN 'CreateMultipartUpload' WHEN method = 'POST' AND has_key AND list_contains(params, 'uploadId') THEN 'CompleteMultipartUpload' WHEN method = 'POST' AND has_key AND list_contains(params, 'x-purge') THEN 'Purge'
 WHEN method = 'POST' AND NOT has_key AND list_contains(params, 'delete') THEN 'DeleteObjects' WHEN method = 'GET' AND NOT has_key AND {_only(rq.LIST_PARAMETERS)} THEN 'ListObjects' ELSE 'Other' END AS operation FROM ops"""
)
def operation_classify(spark, sf_dir):
    o = _ops(spark, sf_dir)
    return o.select("req_id", rq.operation(F.col("method"), F.col("has_key"), F.lit(True), F.col("params"), F.col("copies"), "x-purge").alias("operation"))


@query(
    with_views("requests", "")
    + f""", {OPS} SELECT CASE WHEN has_key THEN CASE WHEN method IN ('GET', 'HEAD') THEN 'read' ELSE 'write' END WHEN method = 'HEAD' AND len(params) = 0 THEN 'part-read' WHEN method = 'GET' AND array_to_string(params, '&') = 'location' THEN 'part-read'
 WHEN method = 'GET' AND len(list_distinct(params)) < len(params) THEN 'invalid' WHEN method = 'GET' AND {_only(rq.LIST_PARAMETERS)} THEN 'list' WHEN method = 'POST' AND list_contains(params, 'delete') THEN 'part-write' ELSE 'admin' END AS need, count(*) AS n FROM ops GROUP BY 1"""
)
def access_needed(spark, sf_dir):
    o = _ops(spark, sf_dir)
    return o.groupBy(rq.access_needed(F.col("method"), F.col("has_key"), F.col("params")).alias("need")).agg(F.count(F.lit(1)).alias("n"))


@query(
    with_views("requests", "")
    + f""", {OPS}, t AS (SELECT req_id, trim({TAGS}) AS v FROM requests) SELECT req_id FROM ops JOIN t USING (req_id) WHERE method IN ('GET', 'HEAD') AND has_key AND {_only([*rq.OVERRIDES, "x-id"])} AND req_id % 19 <> 0 AND coalesce(NOT (v = '*' OR contains(v, ',') OR starts_with(v, 'W/')), true)"""
)
def cacheable_filter(spark, sf_dir):
    o = _ops(spark, sf_dir)
    key = F.when(F.col("has_key"), "k").otherwise("")
    return o.filter(rq.cacheable(F.col("method"), F.lit("docs"), key, F.col("params"), F.col("req_id") % 19 == 0, rg.etag_condition(F.expr(TAGS))["usable"])).select("req_id")


@query(
    """WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages), s AS (SELECT page_id, host, regexp_replace(path, '^/+', '') AS bare FROM h)
SELECT page_id, CASE WHEN ends_with(regexp_replace(host, ':\\d+$', ''), '.example') THEN left(regexp_replace(host, ':\\d+$', ''), length(regexp_replace(host, ':\\d+$', '')) - 8) END AS virtual_bucket, string_split(bare, '/')[1] AS bucket, substr(bare, length(string_split(bare, '/')[1]) + 2) AS key FROM s"""
)
def path_normalise(spark, sf_dir):
    p = trace.read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"))
    return p.select("page_id", rq.virtual_bucket(F.col("host"), "example").alias("virtual_bucket"), rq.split_path(F.col("path")).alias("p")).select("page_id", "virtual_bucket", "p.*")


NEEDS = """needs AS (SELECT r.req_id, r.client, o.bucket, o.key, CASE WHEN method = 'PUT' THEN 2 ELSE 1 END AS need FROM requests r JOIN objects o USING (doc_id))"""


def _needs(spark, sf_dir):
    j = trace.requests(spark, sf_dir).join(trace.objects(spark, sf_dir, etags=False), "doc_id")
    return j.select("req_id", "client", "bucket", "key", F.when(F.col("method") == "PUT", 2).otherwise(1).alias("need"))


MAY = "EXISTS (SELECT 1 FROM grants g WHERE g.client = n.client AND (g.bucket = '*' OR g.bucket = n.bucket) AND g.level >= n.need AND starts_with(n.key, g.prefix))"


@query(with_views("objects requests grants", "") + f", {NEEDS} SELECT req_id, client, key, need FROM needs n WHERE {MAY}")
def authorized_requests(spark, sf_dir):
    return authorize.covered(_needs(spark, sf_dir), trace.grants(spark, sf_dir), "left_semi").select("req_id", "client", "key", "need")


@query(with_views("objects requests grants", "") + f", {NEEDS} SELECT req_id, client, key, need FROM needs n WHERE NOT {MAY}")
def denied_requests(spark, sf_dir):
    return authorize.covered(_needs(spark, sf_dir), trace.grants(spark, sf_dir), "left_anti").select("req_id", "client", "key", "need")


# -- layout and placement ---------------------------------------------------------------------------------------------


@query(with_views("objects requests resolved gets blocks", "SELECT req_id, block_index, chunk FROM blocks"))
def block_explode(spark, sf_dir):
    return blocks_of(spark, sf_dir).select("req_id", "block_index", "chunk")


@query(
    with_views("objects requests resolved gets blocks", "")
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY block_index) - row_number() OVER (PARTITION BY req_id, chunk ORDER BY block_index) AS island FROM blocks)
SELECT req_id, chunk, greatest(min(block_index) * 256, any_value(first)) AS run_first, least((max(block_index) + 1) * 256 - 1, any_value(last)) AS run_last FROM n GROUP BY req_id, chunk, island"""
)
def placement_runs(spark, sf_dir):
    b = blocks_of(spark, sf_dir)
    r = lay.runs(b.select("req_id", "first", "last", "block_index", "chunk"), ["req_id", "first", "last"])
    return r.select("req_id", "chunk", F.greatest(F.col("lo") * 256, F.col("first")).alias("run_first"), F.least((F.col("hi") + 1) * 256 - 1, F.col("last")).alias("run_last"))


@query(
    with_views("objects", "")
    + """, b AS (SELECT key, size, unnest(range(0, (size + 255) // 256)) AS i FROM objects WHERE size > 0), h AS (SELECT *, i - row_number() OVER (PARTITION BY key ORDER BY i) AS island FROM b WHERE i < 4 OR (i + 1) * 256 > greatest(size - 1024, 0))
SELECT key, min(i) * 256 AS region_start, least((max(i) + 1) * 256, any_value(size)) AS region_end FROM h GROUP BY key, island"""
)
def home_region(spark, sf_dir):
    o = trace.objects(spark, sf_dir, etags=False).filter("size > 0")
    b = o.select("key", "size", F.explode(F.sequence(F.lit(0).cast("long"), LAYOUT.count(F.col("size")) - 1)).alias("block_index"))
    h = b.withColumn("chunk", LAYOUT.chunk_of(F.col("block_index"), F.col("size"))).filter("chunk is null")
    r = lay.runs(h, ["key", "size"])
    return r.select("key", (F.col("lo") * 256).alias("region_start"), F.least((F.col("hi") + 1) * 256, F.col("size")).alias("region_end"))


SPOT = """spot AS (SELECT key, size, CASE WHEN lower(key) LIKE '%.parquet' THEN 'parquet' WHEN lower(key) LIKE '%.orc' THEN 'orc' WHEN lower(key) LIKE '%.safetensors' THEN 'safetensors' END AS format FROM objects),
spots AS (SELECT *, CASE WHEN format = 'parquet' AND size >= 12 THEN size - 8 WHEN format = 'orc' AND size >= 4 THEN greatest(size - 256, 0) WHEN format = 'safetensors' AND size >= 8 THEN 0 END AS spot_start,
 CASE WHEN format = 'parquet' AND size >= 12 THEN size WHEN format = 'orc' AND size >= 4 THEN size WHEN format = 'safetensors' AND size >= 8 THEN 8 END AS spot_end FROM spot)"""


@query(with_views("objects", "") + f", {SPOT} SELECT key, format, spot_start, spot_end FROM spots")
def format_spots(spark, sf_dir):
    from ..sources.formats import detect, spot

    o = trace.objects(spark, sf_dir, etags=False).withColumn("format", detect(F.col("key")))
    return o.select("key", "format", spot(F.col("format"), F.col("size")).alias("s")).select("key", "format", F.col("s.start").alias("spot_start"), F.col("s.end").alias("spot_end"))


@query(
    with_views("objects requests resolved gets blocks", "")
    + f", {SPOT} SELECT req_id, block_index FROM blocks b JOIN spots s USING (key) WHERE s.spot_start < least((block_index + 1) * 256, b.size) AND block_index * 256 < s.spot_end"
)
def spot_blocks(spark, sf_dir):
    """Blocks that overlap their object's metadata spot (half-open intervals)."""
    from ..sources.formats import detect, spot

    b = blocks_of(spark, sf_dir).withColumn("s", spot(detect(F.col("key")), F.col("size"))).withColumn("p", LAYOUT.span(F.col("block_index"), F.col("size")))
    return b.filter("s.start < p.end and p.start < s.end").select("req_id", "block_index")


@query(with_views("objects requests resolved gets blocks ring4 places", "") + f", {OWNED} SELECT key, chunk, node_id FROM owned")
def owner_weighted(spark, sf_dir):
    return placement.owners(places_of(spark, sf_dir), trace.ring(spark, sf_dir, 4))


@query(
    with_views("objects requests resolved gets blocks ring4 places", "")
    + " SELECT key, chunk, max_by(node_id, (h, node_id)) AS node_id FROM (SELECT p.key, p.chunk, r.node_id, ('0x' || substr(md5(p.key || '#' || coalesce(p.chunk, -1) || '@' || r.node_id), 1, 13))::BIGINT AS h FROM places p CROSS JOIN ring4 r) GROUP BY key, chunk"
)
def owner_uniform(spark, sf_dir):
    return placement.owners(places_of(spark, sf_dir), trace.ring(spark, sf_dir, 4, uniform=True), uniform=True)


@query(with_views("objects requests resolved gets blocks ring4 places", "") + f", {RANKED} SELECT key, chunk, node_id, rank FROM ranked")
def ring_candidates(spark, sf_dir):
    return placement.candidates(places_of(spark, sf_dir), trace.ring(spark, sf_dir, 4)).select("key", "chunk", "node_id", "rank")


@query(with_views("objects requests resolved gets blocks ring4 places", "") + f", {RANKED} SELECT key, chunk, node_id, rank FROM ranked WHERE rank BETWEEN 2 AND 3")
def replica_set(spark, sf_dir):
    return placement.replicas(places_of(spark, sf_dir), trace.ring(spark, sf_dir, 4), 2).select("key", "chunk", "node_id", "rank")


@query(with_views("objects requests resolved gets blocks ring4 places", "") + f", {RANKED} SELECT key, chunk, min_by(node_id, ((node_id IN (2, 3))::INT, rank)) AS node_id FROM ranked GROUP BY key, chunk")
def best_healthy_candidate(spark, sf_dir):
    avoided = trace.ring(spark, sf_dir, 4).filter("node_id in (2, 3)")
    return placement.best_healthy(placement.candidates(places_of(spark, sf_dir), trace.ring(spark, sf_dir, 4)), avoided)


@query(
    with_views("objects requests resolved gets blocks ring4 ring5 places", "")
    + f", {OWNED}, {OWNED.replace('owned AS', 'owned5 AS').replace('ring4', 'ring5')} SELECT a.key, a.chunk, a.node_id AS old_node, b.node_id AS new_node FROM owned a JOIN owned5 b ON a.key = b.key AND a.chunk IS NOT DISTINCT FROM b.chunk WHERE a.node_id <> b.node_id"
)
def ring_moves(spark, sf_dir):
    return placement.moves(places_of(spark, sf_dir), trace.ring(spark, sf_dir, 4), trace.ring(spark, sf_dir, 5))


@query(
    with_views("objects requests resolved gets blocks ring4 ring5 places", "")
    + f", {OWNED}, {OWNED.replace('owned AS', 'owned5 AS').replace('ring4', 'ring5')} SELECT a.node_id, count(*) AS disowned FROM (SELECT DISTINCT key, chunk, block_index FROM blocks) b JOIN owned a ON a.key = b.key AND a.chunk IS NOT DISTINCT FROM b.chunk WHERE NOT EXISTS (SELECT 1 FROM owned5 o WHERE o.key = b.key AND o.chunk IS NOT DISTINCT FROM b.chunk AND o.node_id = a.node_id) GROUP BY 1"
)
def disowned_blocks(spark, sf_dir):
    """Blocks each node holds under the old ring that the new ring gives to others."""
    b = blocks_of(spark, sf_dir).select("key", "chunk", "block_index").distinct().withColumn("c", F.coalesce("chunk", F.lit(-1)))
    p = b.select("key", "chunk").distinct()
    old = placement.owners(p, trace.ring(spark, sf_dir, 4)).select("key", F.coalesce("chunk", F.lit(-1)).alias("c"), "node_id")
    new = placement.owners(p, trace.ring(spark, sf_dir, 5)).select("key", F.coalesce("chunk", F.lit(-1)).alias("c"), "node_id")
    return b.join(old, ["key", "c"]).join(new, ["key", "c", "node_id"], "left_anti").groupBy("node_id").agg(F.count(F.lit(1)).alias("disowned"))


@query("SELECT DISTINCT node_id FROM (SELECT s_suppkey AS node_id FROM supplier WHERE s_suppkey BETWEEN 1 AND 4 UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey BETWEEN 3 AND 6) WHERE node_id <> 1")
def purge_targets(spark, sf_dir):
    """Members of either ring but this node."""
    a = trace.ring(spark, sf_dir, 4).select("node_id")
    b = trace.ring(spark, sf_dir, 6).filter("node_id >= 3").select("node_id")
    return a.union(b).distinct().filter("node_id <> 1")


@query("SELECT s_suppkey AS node_id FROM supplier WHERE s_suppkey BETWEEN 1 AND 6 EXCEPT SELECT s_suppkey FROM supplier WHERE s_suppkey BETWEEN 1 AND 4")
def newly_down(spark, sf_dir):
    return trace.ring(spark, sf_dir, 6).select("node_id").subtract(trace.ring(spark, sf_dir, 4).select("node_id"))


# -- policies ---------------------------------------------------------------------------------------------------------

TIMED = "timed AS (SELECT req_id, client, ts_ms, lag(ts_ms) OVER (PARTITION BY client ORDER BY ts_ms, req_id) AS validated, CASE WHEN client % 3 = 0 THEN NULL WHEN client % 3 = 1 THEN 5000 ELSE 7200000 END AS ttl FROM requests)"


def _timed(spark, sf_dir):
    w = Window.partitionBy("client").orderBy("ts_ms", "req_id")
    ttl = F.when(F.col("client") % 3 == 1, 5000).when(F.col("client") % 3 == 2, 7200000)
    return trace.requests(spark, sf_dir).select("req_id", "client", "ts_ms", F.lag("ts_ms").over(w).alias("validated"), ttl.alias("ttl"))


@query(with_views("requests", "") + f", {TIMED} SELECT req_id, coalesce(NOT (req_id % 10 = 0), true) AND (ttl IS NULL OR validated + ttl >= ts_ms) AS fresh FROM timed WHERE validated IS NOT NULL")
def policy_freshness(spark, sf_dir):
    t = _timed(spark, sf_dir).filter("validated is not null")
    return t.select("req_id", admission.home_fresh(F.col("ttl"), F.col("validated"), F.col("ts_ms"), F.col("req_id") % 10 == 0).alias("fresh"))


@query(
    with_views("requests", "")
    + f", {TIMED} SELECT req_id, CASE WHEN ttl IS NULL THEN validated + 500 + 60000 >= ts_ms ELSE validated + ttl >= ts_ms AND validated + 500 + 3600000 >= ts_ms END AS fresh FROM timed WHERE validated IS NOT NULL"
)
def gateway_freshness(spark, sf_dir):
    t = _timed(spark, sf_dir).filter("validated is not null")
    f = admission.gateway_fresh(F.col("ttl"), F.lit(3600000), F.lit(60000), F.col("validated"), F.col("validated") + 500, F.col("ts_ms"))
    return t.select("req_id", f.alias("fresh"))


@query(
    with_views("requests", "")
    + f", {TIMED} SELECT req_id, CASE WHEN ts_ms - validated <= 1800000 THEN 'fresh' WHEN ts_ms - validated <= 3600000 THEN 'refresh' WHEN req_id % 4 = 0 AND ts_ms - validated <= 14400000 THEN 'grace' ELSE 'expired' END AS class FROM timed WHERE validated IS NOT NULL"
)
def swr_class(spark, sf_dir):
    t = _timed(spark, sf_dir).filter("validated is not null")
    return t.select("req_id", admission.lookup_class(F.col("ts_ms") - F.col("validated"), 3600000, 10800000, F.col("req_id") % 4 == 0).alias("class"))


@query(
    with_views("requests", "")
    + " SELECT req_id FROM (SELECT req_id, ts_ms // 1000 AS now, ts_ms // 1000 - (req_id * 37) % 2000 + 500 AS signed_at, (req_id % 5) * 300 AS expires, req_id % 2 = 0 AS presigned FROM requests) WHERE CASE WHEN presigned THEN expires BETWEEN 1 AND 604800 AND now + 900 >= signed_at AND now <= signed_at + expires ELSE abs(now - signed_at) <= 900 END"
)
def signed_window(spark, sf_dir):
    r = trace.requests(spark, sf_dir).withColumn("now", F.floor(F.col("ts_ms") / 1000))
    r = r.withColumn("signed_at", F.col("now") - (F.col("req_id") * 37) % 2000 + 500)
    return r.filter(admission.signed_valid(F.col("now"), F.col("signed_at"), (F.col("req_id") % 5) * 300, F.col("req_id") % 2 == 0)).select("req_id")


@query(
    with_views("objects requests", "")
    + " SELECT r.req_id, coalesce(p.ttl_ms, 5000) AS ttl_ms, coalesce(p.admit, false) AS admit FROM requests r JOIN objects o USING (doc_id) LEFT JOIN (VALUES ('en', 60000, true), ('de', 1000, false)) p(lang, ttl_ms, admit) ON string_split(o.key, '/')[1] = p.lang"
)
def policy_projection(spark, sf_dir):
    """Each request's policy: its prefix's, or the default."""
    p = spark.createDataFrame([("en", 60000, True), ("de", 1000, False)], "lang string, ttl_ms int, admit boolean")
    j = trace.requests(spark, sf_dir).join(trace.objects(spark, sf_dir, etags=False), "doc_id").withColumn("lang", F.substring_index("key", "/", 1))
    return j.join(F.broadcast(p), "lang", "left").select("req_id", F.coalesce("ttl_ms", F.lit(5000)).alias("ttl_ms"), F.coalesce("admit", F.lit(False)).alias("admit"))


# -- history ----------------------------------------------------------------------------------------------------------


@query(
    with_views("requests states", "")
    + " SELECT r.req_id, s.valid_from AS state_since, s.etag AS state_etag FROM (SELECT * FROM requests WHERE method <> 'PUT') r LEFT JOIN (SELECT *, lead(req_id) OVER (PARTITION BY doc_id ORDER BY valid_from, req_id) AS next_id FROM states) s ON s.doc_id = r.doc_id AND s.valid_from <= r.ts_ms AND (s.valid_to IS NULL OR s.valid_to > r.ts_ms)"
)
def state_asof(spark, sf_dir):
    """The version of its object at each read."""
    r = trace.requests(spark, sf_dir).filter("method <> 'PUT'").select("req_id", "doc_id", "ts_ms")
    got = history.as_of(r, trace.object_states(spark, sf_dir), "doc_id", "ts_ms", "valid_from", "etag", "req_id")
    return got.select("req_id", "state_since", F.col("state_value").alias("state_etag"))


@query(
    with_views("requests states", "")
    + " SELECT r.req_id, count(*) AS states, count(s.etag) AS live FROM requests r JOIN states s ON s.doc_id = r.doc_id AND s.valid_from <= r.ts_ms + 86400000 AND (s.valid_to IS NULL OR s.valid_to > r.ts_ms) WHERE r.method <> 'PUT' GROUP BY 1"
)
def states_during(spark, sf_dir):
    """States that held at some time of [read, read + 1 day]."""
    r = trace.requests(spark, sf_dir).filter("method <> 'PUT'").select("req_id", "doc_id", "ts_ms")
    got = history.held_during(r, trace.object_states(spark, sf_dir), "doc_id", "ts_ms", 86400000, "valid_from", "valid_to", "etag")
    return got.filter("states > 0").groupBy("req_id").agg(F.sum("states").alias("states"), F.sum("live").alias("live"))


@query(
    with_views("requests states", "")
    + """, reads AS (SELECT req_id, doc_id, ts_ms, '"v' || (req_id - req_id % 5) || '"' AS etag FROM requests WHERE method <> 'PUT')
 SELECT req_id FROM reads r WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.doc_id = r.doc_id AND s.valid_from <= r.ts_ms AND (s.valid_to IS NULL OR s.valid_to > r.ts_ms - 3600000) AND s.etag = r.etag)"""
)
def history_violations(spark, sf_dir):
    """Reads whose tag no state of the hour before them had."""
    r = trace.requests(spark, sf_dir).filter("method <> 'PUT'").select("req_id", "doc_id", "ts_ms", F.expr("concat('\"v', req_id - req_id % 5, '\"')").alias("etag")).alias("r")
    s = trace.object_states(spark, sf_dir).alias("s")
    ok = (F.col("s.doc_id") == F.col("r.doc_id")) & (F.col("s.etag") == F.col("r.etag")) & (F.col("s.valid_from") <= F.col("r.ts_ms")) & (F.col("s.valid_to").isNull() | (F.col("s.valid_to") > F.col("r.ts_ms") - 3600000))
    return r.join(s, ok, "left_anti").select("req_id")


@query(with_views("requests states", "") + " SELECT doc_id, req_id AS entry, etag FROM states QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY valid_from DESC, req_id DESC) = 1 AND etag IS NOT NULL")
def changelog_latest(spark, sf_dir):
    """Replay of the metadata log: the last entry of each key, tombstones left out."""
    log = trace.object_states(spark, sf_dir)
    return history.latest(log, ["doc_id"], ["valid_from", "req_id"], ["req_id", "etag"]).filter("etag is not null").select("doc_id", F.col("req_id").alias("entry"), "etag")


UPDOWN = "updown AS (SELECT user_id % 12 AS node_id, (epoch_us(ts) // 1000) AS t_ms, event_id, CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END AS state FROM events WHERE event_type IN ('error', 'signup'))"


@query(
    f"WITH {UPDOWN}, c AS (SELECT *, lag(state) OVER (PARTITION BY node_id ORDER BY t_ms, event_id) AS before FROM updown) SELECT node_id, state, t_ms AS valid_from, lead(t_ms) OVER (PARTITION BY node_id ORDER BY t_ms, event_id) AS valid_to FROM c WHERE before IS DISTINCT FROM state"
)
def ring_intervals(spark, sf_dir):
    """Intervals in which members were up or down, from membership events."""
    e = trace.read(spark, sf_dir, "events").filter("event_type in ('error', 'signup')")
    e = e.select((F.col("user_id") % 12).alias("node_id"), trace.millis("ts").alias("at"), "event_id", F.when(F.col("event_type") == "error", "down").otherwise("up").alias("state"))
    w = Window.partitionBy("node_id").orderBy("at", "event_id")
    changed = e.withColumn("before", F.lag("state").over(w)).filter(~F.col("before").eqNullSafe(F.col("state")))
    return history.intervals(changed, "node_id", "at", ["at", "event_id"]).select("node_id", "state", "valid_from", "valid_to")


@query(
    f"WITH {UPDOWN}, last AS (SELECT node_id, max_by(state, (t_ms, event_id)) AS state FROM updown GROUP BY 1) SELECT node_id FROM (SELECT node_id FROM last WHERE state = 'up' UNION SELECT 0::BIGINT) EXCEPT SELECT node_id FROM last WHERE node_id = 5"
)
def ring_merge(spark, sf_dir):
    """Members now: those last heard up, and this node; a leaving one is removed."""
    e = trace.read(spark, sf_dir, "events").filter("event_type in ('error', 'signup')")
    e = e.select((F.col("user_id") % 12).alias("node_id"), trace.millis("ts").alias("at"), "event_id", F.when(F.col("event_type") == "error", "down").otherwise("up").alias("state"))
    last = history.latest(e, ["node_id"], ["at", "event_id"], ["state"])
    up = last.filter("state = 'up'").select("node_id").union(spark.range(1).select(F.col("id").alias("node_id")))
    return up.distinct().subtract(last.filter("node_id = 5").select("node_id"))


@query(
    with_views("requests states", "")
    + " SELECT p.doc_id, n.node_id FROM (SELECT doc_id FROM states WHERE etag IS NULL GROUP BY doc_id) p CROSS JOIN (SELECT s_suppkey AS node_id FROM supplier WHERE s_suppkey BETWEEN 1 AND 4) n WHERE NOT EXISTS (SELECT 1 FROM requests r WHERE r.doc_id = p.doc_id AND r.client % 4 + 1 = n.node_id AND r.req_id % 5 = 0)"
)
def pending_purges(spark, sf_dir):
    """Nodes that have still to confirm a purge (anti-join of the confirmations)."""
    p = trace.object_states(spark, sf_dir).filter("etag is null").select("doc_id").distinct()
    every = p.crossJoin(placement.bounded_ring(trace.ring(spark, sf_dir, 4).select("node_id")))
    done = trace.requests(spark, sf_dir).filter("req_id % 5 = 0").select("doc_id", (F.col("client") % 4 + 1).alias("node_id"))
    return every.join(done, ["doc_id", "node_id"], "left_anti")


@query(
    with_views("requests", "")
    + " SELECT req_id, (SELECT max(w.ts_ms) FROM requests w WHERE w.client = r.client AND w.doc_id = r.doc_id AND w.method = 'PUT' AND w.ts_ms < r.ts_ms) AS after_write FROM requests r WHERE method <> 'PUT'"
)
def read_your_writes(spark, sf_dir):
    """For each read, the time of its client's last earlier write of the object."""
    r = trace.requests(spark, sf_dir).select("req_id", "client", "doc_id", "ts_ms", "method")
    w = Window.partitionBy("client", "doc_id").orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -1)
    return r.withColumn("after_write", F.max(F.when(F.col("method") == "PUT", F.col("ts_ms"))).over(w)).filter("method <> 'PUT'").select("req_id", "after_write")


@query(
    with_views("requests", "")
    + """, f AS (SELECT doc_id, ts_ms AS s, ts_ms + first_byte_us * 100 AS e FROM requests WHERE method = 'GET'), n AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
 i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM n) SELECT doc_id, min(s) AS flight_start, max(e) AS flight_end, count(*) AS members FROM i GROUP BY doc_id, isl"""
)
def single_flight(spark, sf_dir):
    """Reads that overlap an earlier one's fetch share it."""
    f = trace.requests(spark, sf_dir).filter("method = 'GET'").select("doc_id", F.col("ts_ms").alias("s"), (F.col("ts_ms") + F.col("first_byte_us") * 100).alias("e"))
    return history.islands(f, "doc_id", "s", "e")


# -- events -----------------------------------------------------------------------------------------------------------

EVENT_JSON = """'{"Records":[{"eventName":"' || CASE WHEN event_id % 3 = 0 THEN 'ObjectRemoved:Delete' ELSE 'ObjectCreated:Put' END || '","eventTime":"2026-09-27T12:34:' || lpad((event_id % 62)::VARCHAR, 2, '0') || '.' || (event_id % 1000) || 'Z","s3":{"bucket":{"name":"docs"},"object":{"key":"a+b%2Bc/' || user_id || '","eTag":"' || event_id || '"}}}]}'"""


@query(
    f"WITH b AS (SELECT event_id, {EVENT_JSON} AS body FROM events) SELECT event_id, json_extract_string(body, '$.Records[0].s3.bucket.name') AS bucket, 'a b+c/' || split_part(json_extract_string(body, '$.Records[0].s3.object.key'), '/', 2) AS key, "
    "CASE WHEN event_id % 3 <> 0 THEN '\"' || event_id || '\"' END AS etag, CASE WHEN event_id % 62 <= 60 THEN epoch_ms(TIMESTAMP '2026-09-27 12:34:00') + (event_id % 62) * 1000 + substr((event_id % 1000)::VARCHAR || '00', 1, 3)::BIGINT END AS event_ms FROM b"
)
def event_parse(spark, sf_dir):
    """Change events from their JSON bodies (made here from ``events``), keys URL-decoded, tags re-quoted."""
    from ..sources.events import parse_changes

    e = trace.read(spark, sf_dir, "events")
    body = F.expr(EVENT_JSON.replace("::VARCHAR", "").replace("lpad((event_id % 62), 2, '0')", "lpad(cast(event_id % 62 as string), 2, '0')"))
    return parse_changes(e.select("event_id", body.alias("body")), "body").select("event_id", "bucket", "key", "etag", "event_ms")


@query(
    with_views("requests", "")
    + " SELECT doc_id, max_by(req_id, (ts_ms, req_id)) AS req_id, max(ts_ms) AS ts_ms, count(DISTINCT req_id) AS events FROM (SELECT doc_id, req_id, ts_ms FROM requests WHERE method = 'PUT' UNION ALL SELECT doc_id, req_id, ts_ms FROM requests WHERE method = 'PUT' AND req_id % 2 = 0) GROUP BY doc_id"
)
def event_dedup_latest(spark, sf_dir):
    """At-least-once deliveries: duplicates dropped, the last change of each key kept."""
    p = trace.requests(spark, sf_dir).filter("method = 'PUT'").select("doc_id", "req_id", "ts_ms")
    twice = p.unionByName(p.filter("req_id % 2 = 0")).dropDuplicates(["req_id"])
    return twice.groupBy("doc_id").agg(F.max_by("req_id", F.struct("ts_ms", "req_id")).alias("req_id"), F.max("ts_ms").alias("ts_ms"), F.count(F.lit(1)).alias("events"))


# -- metrics ----------------------------------------------------------------------------------------------------------

BUCKET = "CASE " + " ".join(f"WHEN s <= {b} THEN {i}" for i, b in enumerate(units.LATENCY_BOUNDS)) + f" ELSE {len(units.LATENCY_BOUNDS)} END"


@query(
    with_views("requests", "")
    + f", h AS (SELECT event_type, {BUCKET} AS bucket, count(*) AS n FROM (SELECT event_type, first_byte_us / 1000000.0 AS s FROM requests) GROUP BY ALL) SELECT *, (sum(n) OVER (PARTITION BY event_type ORDER BY bucket))::BIGINT AS cumulative FROM h"
)
def hist_fixed(spark, sf_dir):
    return metrics.fixed_histogram(trace.requests(spark, sf_dir), ["event_type"], F.col("first_byte_us") / 1e6)


LOGLINEAR = "CASE WHEN v < 256 THEN v ELSE (length(bin(v)) - 1 - 7 + 1) * 128 + (v >> (length(bin(v)) - 8)) - 128 END"
HIST = f"hist AS (SELECT event_type, {LOGLINEAR} AS bucket, count(*) AS n, max(v) AS max_value FROM (SELECT event_type, first_byte_us AS v FROM requests) GROUP BY ALL)"
HIGHEST = "CASE WHEN bucket < 256 THEN bucket ELSE ((bucket % 128 + 128) << ((bucket // 128 - 1)::INT)) + (1::BIGINT << ((bucket // 128 - 1)::INT)) - 1 END"


@query(with_views("requests", "") + f", {HIST} SELECT event_type, bucket, n, max_value FROM hist")
def hist_loglinear(spark, sf_dir):
    return metrics.loglinear_histogram(trace.requests(spark, sf_dir), ["event_type"], F.col("first_byte_us"), 7)


@query(
    with_views("requests", "")
    + f", {HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY event_type) AS total, max(max_value) OVER (PARTITION BY event_type) AS top FROM hist) "
    f"SELECT event_type, share, least({HIGHEST}, top)::BIGINT AS percentile FROM (SELECT event_type, share, min(bucket) AS bucket, any_value(top) AS top FROM c CROSS JOIN (VALUES (0.5::DOUBLE), (0.9), (0.99), (1.0)) s(share) WHERE seen >= least(greatest(ceil(share * total), 1), total) GROUP BY ALL)"
)
def hist_percentiles(spark, sf_dir):
    h = metrics.loglinear_histogram(trace.requests(spark, sf_dir), ["event_type"], F.col("first_byte_us"), 7)
    return metrics.percentiles(h, ["event_type"], [0.5, 0.9, 0.99, 1.0], 7)


@query(with_views("requests", "") + f", {HIST} SELECT bucket, sum(n)::BIGINT AS n, max(max_value) AS max_value FROM hist GROUP BY bucket")
def hist_merge(spark, sf_dir):
    h = metrics.loglinear_histogram(trace.requests(spark, sf_dir), ["event_type"], F.col("first_byte_us"), 7)
    return metrics.merge_histograms(h, [])


@query(with_views("requests", "") + " SELECT event_type, list_sort(list(first_byte_us))[1 + least(floor(count(*) * 0.99)::BIGINT, count(*) - 1)] AS quantile FROM requests GROUP BY event_type")
def exact_quantiles(spark, sf_dir):
    return metrics.exact_quantile(trace.requests(spark, sf_dir).select("event_type", "first_byte_us"), ["event_type"], "first_byte_us", 0.99)


@query(
    with_views("requests", "")
    + f", h AS (SELECT {BUCKET} AS bucket, count(*) FILTER (WHERE ts_ms % 2 = 0) AS n FROM (SELECT ts_ms, first_byte_us / 1000000.0 AS s FROM requests) GROUP BY 1), c AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS seen, sum(n) OVER () AS total FROM h) SELECT min(bucket) AS bucket FROM c WHERE seen >= 0.99 * total"
)
def prom_quantile(spark, sf_dir):
    """The first cumulative bucket that holds 99 % of the growth between two scrapes."""
    h = trace.requests(spark, sf_dir).groupBy(units.fixed_bucket(F.col("first_byte_us") / 1e6).alias("bucket")).agg((F.count(F.lit(1)) - F.count(F.when(F.col("ts_ms") % 2 != 0, 1))).alias("n"))
    c = h.withColumn("seen", F.sum("n").over(Window.orderBy("bucket"))).withColumn("total", F.sum("n").over(Window.partitionBy()))  # 17 rows
    return c.filter("seen >= 0.99 * total").agg(F.min("bucket").alias("bucket"))


@query(with_views("requests", "") + " SELECT event_type AS class, CASE event_type WHEN 'error' THEN 503 ELSE 200 END AS status, count(*) AS n, sum(first_byte_us)::BIGINT AS total_us FROM requests GROUP BY ALL")
def class_merge(spark, sf_dir):
    """Statuses of each class, merged over hosts (clients): maps are exploded and summed."""
    r = trace.requests(spark, sf_dir).withColumn("status", F.when(F.col("event_type") == "error", 503).otherwise(200))
    host = r.groupBy("client", "event_type", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("first_byte_us").alias("us"))
    per = host.groupBy("client", "event_type").agg(F.map_from_entries(F.collect_list(F.struct("status", F.struct("n", "us")))).alias("statuses"))
    e = per.select(F.col("event_type").alias("class"), F.explode("statuses").alias("status", "v"))
    return e.groupBy("class", "status").agg(F.sum("v.n").alias("n"), F.sum("v.us").alias("total_us"))


@query(with_views("requests", "") + " SELECT event_type AS class, count(*) FILTER (WHERE event_type <> 'error') AS successes, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT client % 4) AS hosts, max(ts_ms) - min(ts_ms) AS span_ms FROM requests GROUP BY 1")
def host_merge(spark, sf_dir):
    r = trace.requests(spark, sf_dir)
    bad = F.col("event_type") == "error"
    return r.groupBy(F.col("event_type").alias("class")).agg(F.count_if(~bad).alias("successes"), F.count_if(bad).alias("errors"), F.count_distinct(F.col("client") % 4).alias("hosts"), (F.max("ts_ms") - F.min("ts_ms")).alias("span_ms"))


@query(with_views("requests", "") + " SELECT floor((ts_ms - 1704067200000) / 10000)::BIGINT AS chunk, count(*) AS n, round(count(*) / count(DISTINCT ts_ms // 1000)::DOUBLE, 6) AS rate FROM requests GROUP BY 1")
def timeline_10s(spark, sf_dir):
    r = trace.requests(spark, sf_dir)
    seconds = F.count_distinct(F.floor(F.col("ts_ms") / 1000))
    return r.groupBy(F.floor((F.col("ts_ms") - 1704067200000) / 10000).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / seconds, 6).alias("rate"))


@query(with_views("requests", "") + " SELECT (ts_ms + first_byte_us // 1000 - 1704067200000) // 1000 AS second, count(*) AS n FROM requests WHERE ts_ms >= 1704067200000 + 86400000 GROUP BY 1")
def per_second(spark, sf_dir):
    """Completions a second, of requests due after the warm-up."""
    r = trace.requests(spark, sf_dir).filter(F.col("ts_ms") >= 1704067200000 + 86400000)
    return r.groupBy(F.floor((F.col("ts_ms") + F.floor(F.col("first_byte_us") / 1000) - 1704067200000) / 1000).alias("second")).agg(F.count(F.lit(1)).alias("n"))


SAMPLES = """samples AS (SELECT client % 8 AS process, event_type AS name, CASE WHEN ts_ms % 2 = 0 THEN 'before' ELSE 'after' END AS moment, count(*) AS value FROM requests GROUP BY ALL),
scrapes AS (SELECT process, name, moment, CASE WHEN process = 3 AND moment = 'after' THEN 2 ELSE 1 END AS started, value FROM samples WHERE NOT (process = 5 AND moment = 'after'))"""


def _scrapes(spark, sf_dir):
    s = trace.requests(spark, sf_dir).groupBy((F.col("client") % 8).alias("process"), F.col("event_type").alias("name"), F.when(F.col("ts_ms") % 2 == 0, "before").otherwise("after").alias("moment")).agg(F.count(F.lit(1)).alias("value"))
    return s.withColumn("started", F.when((F.col("process") == 3) & (F.col("moment") == "after"), 2).otherwise(1)).filter("not (process = 5 and moment = 'after')")


@query(
    with_views("requests", "")
    + f", {SAMPLES} SELECT a.process, a.name, a.value - CASE WHEN b.started = a.started THEN b.value ELSE 0 END AS growth FROM (SELECT * FROM scrapes WHERE moment = 'after') a LEFT JOIN (SELECT * FROM scrapes WHERE moment = 'before') b USING (process, name)"
)
def counter_growth(spark, sf_dir):
    return metrics.counter_growth(_scrapes(spark, sf_dir), ["process", "name"])


@query(
    with_views("requests", "")
    + """, t AS (SELECT client % 4 AS host, ts_ms // 3600000 AS t, sum(first_byte_us)::BIGINT AS v FROM requests GROUP BY ALL), d AS (SELECT host, t, v - lag(v) OVER w AS dv, t - lag(t) OVER w AS dt, lag(t) OVER w AS before FROM t WINDOW w AS (PARTITION BY host ORDER BY t))
 SELECT host, before + dt / 2.0 AS midpoint, round(dv / dt::DOUBLE, 6) AS rate FROM d WHERE dt > 0 AND dv >= 0"""
)
def sample_rates(spark, sf_dir):
    """Rates between neighbouring samples, at their midpoints; restarts (negative growth) left out."""
    t = trace.requests(spark, sf_dir).groupBy((F.col("client") % 4).alias("host"), F.floor(F.col("ts_ms") / 3600000).alias("t")).agg(F.sum("first_byte_us").alias("v"))
    w = Window.partitionBy("host").orderBy("t")
    d = t.select("host", (F.col("v") - F.lag("v").over(w)).alias("dv"), (F.col("t") - F.lag("t").over(w)).alias("dt"), F.lag("t").over(w).alias("before"))
    return d.filter("dt > 0 and dv >= 0").select("host", (F.col("before") + F.col("dt") / 2).alias("midpoint"), F.round(F.col("dv") / F.col("dt"), 6).alias("rate"))


SERVED = "served AS (SELECT b.*, row_number() OVER (PARTITION BY key, block_index ORDER BY ts_ms, req_id) AS nth FROM blocks b)"


@query(
    with_views("objects requests resolved gets blocks", "")
    + f", {SERVED} SELECT client % 4 AS node, count(*) FILTER (WHERE nth > 2) AS hits, count(*) FILTER (WHERE nth <= 2) AS fetched, round(count(*) FILTER (WHERE nth > 2) / nullif(count(*), 0)::DOUBLE, 6) AS block_hits, round(100.0 * sum(CASE WHEN nth > 2 THEN least((block_index + 1) * 256 - 1, last) - greatest(block_index * 256, first) + 1 ELSE 0 END) / nullif(sum(least((block_index + 1) * 256 - 1, last) - greatest(block_index * 256, first) + 1), 0), 6) AS byte_percent, (100 * count(*) FILTER (WHERE nth > 2)) // nullif(count(*), 0) AS hit_percent FROM served GROUP BY 1"
)
def hit_ratio(spark, sf_dir):
    """Block, byte and integer hit ratios of a second-read cache, a node."""
    w = Window.partitionBy("key", "block_index").orderBy("ts_ms", "req_id")
    b = blocks_of(spark, sf_dir).withColumn("hit", (F.row_number().over(w) > 2).cast("int"))
    hits, n = F.sum("hit"), F.count(F.lit(1))
    size = F.least((F.col("block_index") + 1) * 256 - 1, F.col("last")) - F.greatest(F.col("block_index") * 256, F.col("first")) + 1
    return b.groupBy((F.col("client") % 4).alias("node")).agg(hits.alias("hits"), (n - hits).alias("fetched"), F.round(F.try_divide(hits, n), 6).alias("block_hits"), F.round(F.try_divide(F.sum(F.col("hit") * size) * 100.0, F.sum(size)), 6).alias("byte_percent"), F.floor(hits * 100 / n).alias("hit_percent"))


@query(
    with_views("objects requests resolved gets blocks", "")
    + f", {SERVED} SELECT count(*) FILTER (WHERE nth = 2) * 256 AS written, sum(least((block_index + 1) * 256 - 1, last) - greatest(block_index * 256, first) + 1)::BIGINT AS served, round(count(*) FILTER (WHERE nth = 2) * 256 / sum(least((block_index + 1) * 256 - 1, last) - greatest(block_index * 256, first) + 1)::DOUBLE, 6) AS amplification FROM served"
)
def write_amp(spark, sf_dir):
    w = Window.partitionBy("key", "block_index").orderBy("ts_ms", "req_id")
    b = blocks_of(spark, sf_dir).withColumn("nth", F.row_number().over(w))
    size = F.least((F.col("block_index") + 1) * 256 - 1, F.col("last")) - F.greatest(F.col("block_index") * 256, F.col("first")) + 1
    a = b.agg((F.count_if(F.col("nth") == 2) * 256).alias("written"), F.sum(size).alias("served"))
    return a.withColumn("amplification", F.round(F.col("written") / F.col("served"), 6))


@query(with_views("requests", "") + f", {SAMPLES} SELECT name || CASE WHEN moment = 'after' THEN '{{process=\"' || process || '\",moment=\"after\"}}' ELSE '' END || ' ' || value AS line FROM scrapes")
def exposition_render(spark, sf_dir):
    s = _scrapes(spark, sf_dir).withColumn("label_text", F.when(F.col("moment") == "after", F.concat(F.lit('process="'), "process", F.lit('",moment="after"'))).otherwise(""))
    return metrics.render_exposition(s.select("name", "label_text", "value"))


LINES = "lines AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '# HELP x' WHEN 1 THEN 'requests_total{op=\"' || event_type || '\",status=\"' || (200 + event_id % 3) || '\"} ' || (event_id % 100) WHEN 2 THEN 'up 1' ELSE 'junk line x' END AS line FROM events)"


@query(
    f"WITH {LINES} SELECT event_id, regexp_extract(line, '^([^{{ ]*)', 1) AS name, CASE WHEN contains(line, '{{') THEN regexp_extract(line, 'op=\"([^\"]*)\"', 1) END AS op, CASE WHEN contains(line, '{{') THEN regexp_extract(line, 'status=\"([^\"]*)\"', 1) END AS status, regexp_extract(line, ' ([^ ]*)$', 1)::DOUBLE AS value FROM lines WHERE event_id % 4 IN (1, 2)"
)
def exposition_parse(spark, sf_dir):
    line = F.expr(LINES.split("SELECT event_id, ")[1].rsplit(" AS line", 1)[0])
    p = trace.read(spark, sf_dir, "events").select("event_id", metrics.parse_exposition(line).alias("s")).filter("s is not null")
    return p.select("event_id", "s.name", F.col("s.labels")["op"].alias("op"), F.col("s.labels")["status"].alias("status"), "s.value")


@query(f"WITH {LINES} SELECT sum((event_id % 100))::DOUBLE AS total FROM events WHERE event_id % 4 = 1 AND event_type = 'view' AND starts_with((200 + event_id % 3)::VARCHAR, '20')")
def labelled_sum(spark, sf_dir):
    line = F.expr(LINES.split("SELECT event_id, ")[1].rsplit(" AS line", 1)[0])
    p = trace.read(spark, sf_dir, "events").select(metrics.parse_exposition(line).alias("s")).filter("s is not null").select("s.*")
    return metrics.labelled_sum(p, "requests_total", {"op": "view", "status": "20*"})


@query(with_views("requests", "") + " SELECT CASE WHEN client % 3 = 0 THEN event_type END AS class, client % 2 AS host, count(*) AS n FROM requests GROUP BY GROUPING SETS ((class, host))")
def usage_by_class(spark, sf_dir):
    return trace.requests(spark, sf_dir).groupBy(F.when(F.col("client") % 3 == 0, F.col("event_type")).alias("class"), (F.col("client") % 2).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(with_views("objects requests resolved", "") + " SELECT client, count(*) AS responses, bit_xor(('0x' || substr(md5(t), 1, 13))::BIGINT) AS low, bit_xor(('0x' || substr(md5(t), 14, 13))::BIGINT) AS high FROM (SELECT client, req_id || ':' || coalesce(first, -1) || '-' || coalesce(last, -1) AS t FROM resolved) GROUP BY client")
def run_fingerprint(spark, sf_dir):
    """A digest of every response of a client (each names its request, so their
    order is told): digests are combined by a partial aggregate, never gathered."""
    j = trace.requests(spark, sf_dir).join(trace.objects(spark, sf_dir, etags=False), "doc_id")
    r = j.select("client", "req_id", rg.resolve(F.col("kind"), F.col("a"), F.col("b"), F.col("size")).alias("r"))
    digest = F.md5(F.concat(F.col("req_id"), F.lit(":"), F.coalesce("r.first", F.lit(-1)), F.lit("-"), F.coalesce("r.last", F.lit(-1))))
    part = lambda at: F.bit_xor(F.conv(F.substring(digest, at, 13), 16, 10).cast("long"))
    return r.groupBy("client").agg(F.count(F.lit(1)).alias("responses"), part(1).alias("low"), part(14).alias("high"))


@query(
    with_views("objects requests resolved gets blocks", "")
    + " SELECT 'missing' AS side, client, n FROM (SELECT client, count(*) AS n FROM blocks GROUP BY 1 EXCEPT ALL SELECT client, sum(last // 256 - first // 256 + 1)::BIGINT FROM gets GROUP BY 1)"
)
def counter_reconcile(spark, sf_dir):
    """Blocks counted one by one against blocks counted from ranges: differences (there must be none)."""
    a = blocks_of(spark, sf_dir).groupBy("client").agg(F.count(F.lit(1)).alias("n"))
    b = trace.gets(spark, sf_dir).groupBy("client").agg(F.sum(F.floor(F.col("last") / 256) - F.floor(F.col("first") / 256) + 1).alias("n"))
    return a.exceptAll(b).select(F.lit("missing").alias("side"), "client", "n").unionByName(b.exceptAll(a).select(F.lit("extra").alias("side"), "client", "n"))


# -- admission, scans, workload ---------------------------------------------------------------------------------------


@query(with_views("objects requests resolved gets blocks", "") + f", {SERVED} SELECT key, block_index, req_id, nth > 1 AS admitted FROM served")
def doorkeeper_exact(spark, sf_dir):
    return admission.doorkeeper_exact(blocks_of(spark, sf_dir), ["key", "block_index"], ["ts_ms", "req_id"]).select("key", "block_index", "req_id", "admitted")


@query(with_views("objects requests resolved gets blocks", "") + " SELECT key, chunk, (ts_ms // 86400000) * 86400000 AS window_start, count(*) AS reads FROM (SELECT DISTINCT req_id, ts_ms, key, chunk FROM blocks) GROUP BY ALL HAVING count(*) >= 4")
def hot_keys_aligned(spark, sf_dir):
    b = blocks_of(spark, sf_dir).select("req_id", "ts_ms", "key", "chunk").distinct()
    return admission.hot_windows(b, ["key", "chunk"], "ts_ms", 86_400_000, 4)


STORED = "stored AS (SELECT DISTINCT key, block_index FROM blocks WHERE req_id % 2 = 0)"


@query(with_views("objects requests resolved gets blocks", "") + f", {STORED} SELECT b.req_id, bool_and(s.key IS NOT NULL) AS served FROM blocks b LEFT JOIN stored s ON s.key = b.key AND s.block_index = b.block_index GROUP BY b.req_id")
def stored_only_scan(spark, sf_dir):
    """Reads a store can answer alone: all covering blocks are there."""
    b = blocks_of(spark, sf_dir)
    s = b.filter("req_id % 2 = 0").select("key", "block_index").distinct().withColumn("there", F.lit(True))
    return b.select("req_id", "key", "block_index").join(s, ["key", "block_index"], "left").groupBy("req_id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("served"))


@query(with_views("objects requests", "") + " SELECT r.req_id, CASE WHEN o.doc_id IS NULL THEN 404 ELSE 200 END AS status, o.size FROM requests r LEFT JOIN (SELECT * FROM objects WHERE doc_id % 3 <> 0) o USING (doc_id)")
def metadata_only_scan(spark, sf_dir):
    o = trace.objects(spark, sf_dir, etags=False).filter("doc_id % 3 <> 0").select("doc_id", "size")
    return trace.requests(spark, sf_dir).join(o, "doc_id", "left").select("req_id", F.when(F.col("size").isNull(), 404).otherwise(200).alias("status"), "size")


@query(with_views("objects requests resolved gets blocks", "") + " SELECT req_id, string_agg(block_index::VARCHAR, ',' ORDER BY block_index) AS body FROM blocks GROUP BY req_id")
def ordered_merge(spark, sf_dir):
    """Parts put together strictly in order, whatever order they came in."""
    b = blocks_of(spark, sf_dir)
    return b.groupBy("req_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("block_index")), lambda x: x.cast("string")), ",").alias("body"))


@query("SELECT event_id AS n, (CASE WHEN 1 = 1 THEN ((event_id % 100) // 10 * 5 + (event_id % 100 - event_id % 100 // 10 * 10) % 5) END * 2 + 1)::BIGINT AS key FROM events")
def sequential_keys(spark, sf_dir):
    """Host 1 of 2 over 100 keys: windows of 5 keys, each read twice."""
    e = trace.read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("n"), workload.sequential_key(F.col("event_id"), 5, 2, 1, 2, 100).alias("key"))


@query(f"SELECT event_id AS rank, ((event_id::HUGEINT * {workload.scatter_multiplier(1009)}) % 1009)::BIGINT AS key FROM events")
def zipf_scatter(spark, sf_dir):
    return trace.read(spark, sf_dir, "events").select(F.col("event_id").alias("rank"), workload.scatter(F.col("event_id"), 1009).alias("key"))


@query(with_views("requests", "") + " SELECT req_id, greatest(0, ts_ms * 1000 - (1704067200000000 + req_id * 200000)) + first_byte_us AS latency_us FROM requests")
def open_loop_latency(spark, sf_dir):
    due = F.lit(1704067200000000) + F.col("req_id") * 200000
    return trace.requests(spark, sf_dir).select("req_id", workload.open_loop_latency(due, F.col("ts_ms") * 1000, F.col("first_byte_us")).alias("latency_us"))


@query("SELECT event_id, CASE WHEN (event_id % 1000) / 1000.0 * 10 < 7 THEN 0 WHEN (event_id % 1000) / 1000.0 * 10 < 9 THEN 1 ELSE 2 END AS pick FROM events")
def weighted_mix(spark, sf_dir):
    return trace.read(spark, sf_dir, "events").select("event_id", workload.weighted_pick((F.col("event_id") % 1000) / 1000.0, [7, 2, 1]).alias("pick"))


@query(
    with_views("objects", "")
    + " SELECT doc_id, CASE WHEN 512 >= size THEN 'whole' ELSE 'inclusive' END AS kind, CASE WHEN 512 < size THEN (doc_id * 7919) % (size - 512 + 1) END AS a, CASE WHEN 512 < size THEN (doc_id * 7919) % (size - 512 + 1) + 511 END AS b FROM objects"
)
def range_draw(spark, sf_dir):
    """A 512-byte range at a hashed place of each object; the whole object if it is no larger."""
    o = trace.objects(spark, sf_dir, etags=False)
    big = F.col("size") > 512
    at = (F.col("doc_id") * 7919) % F.when(big, F.col("size") - 512 + 1)
    return o.select("doc_id", F.when(big, "inclusive").otherwise("whole").alias("kind"), at.alias("a"), (at + 511).alias("b"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 97) * 1024 WHEN 1 THEN (o_orderkey % 97) * 1048576 WHEN 2 THEN o_orderkey % 97 END AS bytes, CASE o_orderkey % 5 WHEN 3 THEN (o_orderkey % 97) * 1000000 WHEN 4 THEN (o_orderkey % 97) * 1000 END AS micros FROM orders")
def unit_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat((k % 97).cast("string"), F.when(k % 5 == 0, "KiB").when(k % 5 == 1, " MiB").when(k % 5 == 2, "").when(k % 5 == 3, "s").otherwise("ms"))
    return trace.read(spark, sf_dir, "orders").select("o_orderkey", units.parse_bytes(text).alias("bytes"), units.parse_duration(text).alias("micros"))


@query("SELECT least(greatest(1 << length(bin(greatest(l_quantity::BIGINT * 64 - 1, 1))), 256), 4096) AS slot, count(*) AS blocks FROM lineitem GROUP BY 1")
def class_usage_slots(spark, sf_dir):
    n = (F.col("l_quantity").cast("long") * 64).alias("n")
    return trace.read(spark, sf_dir, "lineitem").groupBy(units.size_class(n, 256, 4096).alias("slot")).agg(F.count(F.lit(1)).alias("blocks"))


@query(
    with_views("bulk", "")
    + ", b AS (SELECT order_key, size, unnest(range(first // 256, greatest(stop - 1, first) // 256 + 1)) AS i FROM bulk), p AS (SELECT order_key, CASE WHEN i < 4 OR (i + 1) * 256 > greatest(size - 1024, 0) THEN -1 ELSE i // 4 END AS c FROM b), d AS (SELECT order_key, c, count(*) AS n FROM p GROUP BY ALL), "
    "o AS (SELECT order_key, c, n, max_by(k, (h, k)) AS node FROM (SELECT order_key, c, n, k, ('0x' || substr(md5(order_key || '#' || c || '@' || k), 1, 13))::BIGINT AS h FROM d CROSS JOIN (SELECT unnest(range(1, 6)) AS k)) GROUP BY ALL) SELECT node, count(*) AS placements, sum(n)::BIGINT AS blocks FROM o GROUP BY node"
)
def bulk_node_load(spark, sf_dir):
    """Load of five equal nodes under the benchmark trace; placements are ranked
    once each. Blocks are counted a chunk at a time, so no row a block is made."""
    t = trace.bulk_reads(spark, sf_dir).filter("first is not null")
    t = t.select("order_key", "size", F.floor(F.col("first") / 256).alias("lo"), F.floor(F.greatest(F.col("stop") - 1, F.col("first")) / 256).alias("hi"))
    span = [F.col(c) for c in ("lo", "hi", "size")]
    b = t.select("*", F.explode(LAYOUT.chunks(*span)).alias("at"))
    chunk, n = LAYOUT.in_chunk(F.col("at"), *span)
    b = b.select("order_key", F.coalesce(chunk, F.lit(-1)).alias("c"), n.alias("n")).filter("n > 0")
    d = b.groupBy("order_key", "c").agg(F.sum("n").alias("n"))
    text = lambda k: F.concat(F.col("order_key"), F.lit("#"), F.col("c"), F.lit("@"), F.lit(k))
    best = F.array_max(F.array(*[F.struct(portable(text(k)).alias("h"), F.lit(k).alias("k")) for k in range(1, 6)]))
    return d.withColumn("node", best["k"].cast("long")).groupBy("node").agg(F.count(F.lit(1)).alias("placements"), F.sum("n").alias("blocks"))


# -- not expressible in SQL: held against golden vectors and replays in tests -----------------------------------------


def _node_blocks(spark, sf_dir):
    b = blocks_of(spark, sf_dir)
    size = F.least((F.col("block_index") + 1) * 256, F.col("size")) - F.col("block_index") * 256
    return b.select((F.col("client") % 4).alias("node"), "ts_ms", "req_id", "block_index", F.xxhash64("key", "block_index").alias("block"), size.alias("len"))


def _sim(spark, sf_dir):
    from ..operators.cache_sim import simulate

    return simulate(_node_blocks(spark, sf_dir), "node", ["ts_ms", "req_id", "block_index"], "block", "len", extent_size=4096, extents=16, least_slot=16, most_slot=256, window=1024)


@query(None)
def cache_sim_summary(spark, sf_dir):
    return _sim(spark, sf_dir).filter("not startswith(name, 'class_') and not startswith(name, 'miss_')")


@query(None)
def miss_classes(spark, sf_dir):
    return _sim(spark, sf_dir).filter("startswith(name, 'miss_')")


@query(None)
def class_usage(spark, sf_dir):
    return _sim(spark, sf_dir).filter("startswith(name, 'class_')")


@query(None)
def lease_log(spark, sf_dir):
    from ..operators.cache_sim import leases

    r = trace.requests(spark, sf_dir).filter("method = 'GET'").select("doc_id", "ts_ms", "req_id")
    return leases(r, ["doc_id"], "ts_ms", ["ts_ms", "req_id"], 86_400_000, 3, 43_200_000)


@query(None)
def placement_xxh3(spark, sf_dir):
    """Owners under the faithful hash; scores are compared on 53-bit draws."""
    from ..functions.hashing import xxh3_draw, xxh3_placement

    p = places_of(spark, sf_dir).withColumn("placement", xxh3_placement(F.lit("docs"), F.col("key"), F.col("chunk")))
    j = p.crossJoin(placement.bounded_ring(trace.ring(spark, sf_dir, 4)))
    j = j.withColumn("draw", xxh3_draw(F.col("placement"), F.col("node_id")))
    score = F.col("weight") / -F.ln((F.col("draw") + F.lit(0.5)) / F.lit(float(1 << 53)))
    return j.groupBy("key", "chunk").agg(F.max_by("node_id", F.struct(score.alias("s"), "node_id")).alias("node_id"))


FORMAT = "CASE doc_id % 4 WHEN 0 THEN 'parquet' WHEN 1 THEN 'orc' WHEN 2 THEN 'safetensors' END"


@query(
    with_views("objects", "")
    + f""", f AS (SELECT key, {FORMAT} AS format, size, size // 4 AS footer, 13 AS tail FROM objects),
s AS (SELECT key, format, size, CASE format WHEN 'parquet' THEN size - 8 - footer WHEN 'orc' THEN size - 1 - tail - footer - 5 WHEN 'safetensors' THEN 8 END AS first, CASE format WHEN 'parquet' THEN size - 8 WHEN 'orc' THEN size - 1 - tail WHEN 'safetensors' THEN 8 + footer END AS stop FROM f)
SELECT key, format, CASE WHEN ok THEN first END AS start, CASE WHEN ok THEN stop END AS "end" FROM (SELECT *, first >= CASE format WHEN 'parquet' THEN 4 WHEN 'orc' THEN 3 ELSE 8 END AND first < stop AND stop <= size AS ok FROM s)"""
)
def format_spans(spark, sf_dir):
    """Metadata spans from the trailers of each object's format (made here, byte by byte)."""
    from ..sources.formats import detect, spans

    o = trace.objects(spark, sf_dir, etags=False).withColumn("format", detect(F.col("key")))
    byte = lambda n: F.unhex(F.lpad(F.hex(n.bitwiseAND(255)), 2, "0"))
    le = lambda n, width: F.concat(*[byte(F.shiftright(n, 8 * i)) for i in range(width)])
    varint = lambda n: F.concat(byte(n.bitwiseAND(127).bitwiseOR(128)), byte(F.shiftright(n, 7).bitwiseAND(127).bitwiseOR(128)), byte(F.shiftright(n, 14)))
    raw_bytes = lambda h: F.unhex(F.lit(h))
    footer = F.floor(F.col("size") / 4).cast("long")
    # an ORC postscript: footer length (field 1), metadata length 5 (field 5), the magic (field 8000), then its own length
    postscript = F.concat(raw_bytes("08"), varint(footer), raw_bytes("280582F403034F5243"))
    orc = F.concat(postscript, byte(F.octet_length(postscript)))
    raw = F.when(F.col("format") == "parquet", F.concat(le(footer, 4), F.lit("PAR1").cast("binary"))).when(F.col("format") == "safetensors", le(footer, 8)).when(F.col("format") == "orc", orc)
    return o.select("key", "format", spans(F.col("format"), F.col("size"), raw).alias("s")).select("key", "format", "s.start", "s.end")


@query(None)
def sigv4_verify(spark, sf_dir):
    """Signatures of access-log rows; a tenth are signed with another secret."""
    from ..functions import sigv4

    j = trace.requests(spark, sf_dir).join(trace.objects(spark, sf_dir, etags=False), "doc_id").withColumn("amz_date", F.lit("20260927T123456Z"))

    def sign(i: pd.Series, m: pd.Series, k: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for n, met, key, day in zip(i, m, k, d, strict=True):
            req = sigv4.canonical_request(met, f"/docs/{key}", "", {"host": "s3.example", "x-amz-content-sha256": "UNSIGNED-PAYLOAD", "x-amz-date": day}, "UNSIGNED-PAYLOAD")
            out.append(sigv4.signature("wrong" if n % 10 == 0 else "secret", day, "us-east-1", req))
        return pd.Series(out)

    j = j.withColumn("given", F.pandas_udf(sign, "string")("req_id", "method", "key", "amz_date"))
    ok = sigv4.verify(F.lit("secret"), F.col("amz_date"), F.lit("us-east-1"), F.col("method"), F.concat(F.lit("/docs/"), "key"), F.lit(""), F.lit("s3.example"), F.col("given"))
    return j.select("req_id", ok.alias("valid"))
