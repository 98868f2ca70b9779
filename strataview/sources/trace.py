"""Trace views: objects, requests and the rest of the data model, derived
deterministically from the star-schema tables. Each view has the same
definition in DuckDB (:data:`SQL`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task sorts or groups, whatever the table's size.
TASK_ROWS = 250_000


def parts(spark: SparkSession, rows: int) -> int:
    """Partitions of at most about TASK_ROWS rows each, and those of any shuffle at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def millis(c: str) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def objects(spark: SparkSession, sf_dir: str, etags: bool = True) -> DataFrame:
    """bucket, key, doc_id, size, etag. Without ``etags`` the texts are never read."""
    d = read(spark, sf_dir, "documents")
    suffix = F.when(F.col("doc_id") % 4 == 0, ".parquet").when(F.col("doc_id") % 4 == 1, ".orc").when(F.col("doc_id") % 4 == 2, ".safetensors").otherwise(".txt")
    cols = [F.lit("docs").alias("bucket"), F.concat("lang", F.lit("/"), "doc_id", suffix).alias("key"), "doc_id", F.col("n_chars").alias("size")]
    return d.select(*cols, *([F.concat(F.lit('"'), F.md5("text"), F.lit('"')).alias("etag")] if etags else []))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """req_id, ts_ms, client, method, event_type, doc_id, kind, a, b, first_byte_us."""
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    a, b = (i * 97) % 4096, (i * 31) % 2048
    m = i % 5
    return e.select(
        i.alias("req_id"),
        millis("ts").alias("ts_ms"),
        F.col("user_id").alias("client"),
        F.when(F.col("event_type") == "view", "HEAD").when(F.col("event_type") == "purchase", "PUT").otherwise("GET").alias("method"),
        "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("doc_id"),
        F.when(m == 0, "whole").when(m == 2, "from").when(m == 3, "suffix").otherwise("inclusive").alias("kind"),
        F.when(m == 3, b + 1).when(m == 4, a + 1).otherwise(a).alias("a"),
        F.when(m == 1, a + b).when(m == 4, a).alias("b"),
        F.round(F.col("value") * 1000).cast("long").alias("first_byte_us"),
    )


def gets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served reads joined with their objects and resolved; unsatisfiable ranges left out."""
    from ..functions.ranges import resolve

    r = requests(spark, sf_dir).filter(F.col("event_type").isin("click", "signup"))
    j = r.join(objects(spark, sf_dir, etags=False), "doc_id")
    j = j.withColumn("r", resolve(F.col("kind"), F.col("a"), F.col("b"), F.col("size")))
    return j.select("req_id", "ts_ms", "client", "doc_id", "bucket", "key", "size", F.col("r.first").alias("first"), F.col("r.last").alias("last"), "first_byte_us").filter("first is not null")


def bulk_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark trace: line items as range reads of their orders, dealt by
    order to as many tasks as the counted rows need."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.greatest(F.lit(1), F.floor("o_totalprice")).cast("long").alias("size"))
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate")
    first = (F.floor("l_extendedprice") % F.col("size")).cast("long")
    if (rows := l.count()) > TASK_ROWS:
        n = parts(spark, rows)
        l, o = l.repartition(n, "l_orderkey"), o.repartition(n, "o_orderkey").hint("merge")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), millis("l_shipdate").alias("ts_ms"), "size", first.alias("first"), F.least(first + (F.col("l_quantity") * 64).cast("long"), F.col("size")).cast("long").alias("stop")
    )


def ring(spark: SparkSession, sf_dir: str, nodes: int, uniform: bool = False) -> DataFrame:
    s = read(spark, sf_dir, "supplier").filter(F.col("s_suppkey").between(1, nodes))
    return s.select(F.col("s_suppkey").alias("node_id"), (F.lit(1) if uniform else (1 + F.col("s_suppkey") % 3)).cast("int").alias("weight"))


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client, bucket, prefix, level (1 read, 2 write, 3 admin)."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    lang = F.when(k % 4 == 0, "en/").when(k % 4 == 1, "de/").when(k % 4 == 2, "fr/").otherwise("es/")
    level = F.when(F.col("c_mktsegment") == "MACHINERY", 3).when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), 2).otherwise(1)
    return c.select((k % 150).alias("client"), F.when(k % 50 == 7, "*").otherwise("docs").alias("bucket"), F.when(k % 50 == 7, "").otherwise(lang).alias("prefix"), level.alias("level")).distinct()


def object_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of objects: doc_id, valid_from, valid_to (null: still), etag (null: deleted)."""
    from pyspark.sql.window import Window

    p = requests(spark, sf_dir).filter("event_type = 'purchase'")
    w = Window.partitionBy("doc_id").orderBy("ts_ms", "req_id")
    etag = F.when(F.col("req_id") % 7 != 0, F.concat(F.lit('"v'), "req_id", F.lit('"')))
    return p.select("doc_id", "req_id", F.col("ts_ms").alias("valid_from"), F.lead("ts_ms").over(w).alias("valid_to"), etag.alias("etag"))


#: The same views in DuckDB, as common table expressions.
SQL = {
    "objects": """objects AS (SELECT 'docs' AS bucket, lang || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.parquet' WHEN 1 THEN '.orc' WHEN 2 THEN '.safetensors' ELSE '.txt' END AS key,
  doc_id, n_chars AS size, '"' || md5(text) || '"' AS etag FROM documents)""",
    "requests": """requests AS (SELECT event_id AS req_id, (epoch_us(ts) // 1000) AS ts_ms, user_id AS client, CASE event_type WHEN 'view' THEN 'HEAD' WHEN 'purchase' THEN 'PUT' ELSE 'GET' END AS method, event_type,
  json_extract(props, '$.k')::BIGINT AS doc_id, CASE event_id % 5 WHEN 0 THEN 'whole' WHEN 2 THEN 'from' WHEN 3 THEN 'suffix' ELSE 'inclusive' END AS kind,
  CASE event_id % 5 WHEN 3 THEN (event_id * 31) % 2048 + 1 WHEN 4 THEN (event_id * 97) % 4096 + 1 ELSE (event_id * 97) % 4096 END AS a,
  CASE event_id % 5 WHEN 1 THEN (event_id * 97) % 4096 + (event_id * 31) % 2048 WHEN 4 THEN (event_id * 97) % 4096 END AS b, round(value * 1000)::BIGINT AS first_byte_us FROM events)""",
    "resolved": """resolved AS (SELECT *, CASE WHEN first IS NULL THEN NULL WHEN ignored OR kind <> 'inclusive' THEN size - 1 ELSE least(b, size - 1) END AS last FROM (
  SELECT *, CASE WHEN size <= 0 THEN NULL WHEN ignored THEN 0 WHEN kind = 'suffix' THEN CASE WHEN a > 0 THEN size - least(a, size) END WHEN a < size THEN a END AS first FROM (
  SELECT r.*, o.bucket, o.key, o.size, o.etag, (kind = 'whole' OR (kind = 'inclusive' AND b < a)) AS ignored FROM requests r JOIN objects o USING (doc_id))))""",
    "gets": "gets AS (SELECT req_id, ts_ms, client, doc_id, bucket, key, size, first, last, first_byte_us FROM resolved WHERE event_type IN ('click', 'signup') AND first IS NOT NULL)",
    "blocks": """blocks AS (SELECT *, CASE WHEN block_index < 4 OR (block_index + 1) * 256 > greatest(size - 1024, 0) THEN NULL ELSE block_index // 4 END AS chunk FROM (
  SELECT *, unnest(range(first // 256, last // 256 + 1)) AS block_index FROM gets))""",
    "ring4": "ring4 AS (SELECT s_suppkey AS node_id, (1 + s_suppkey % 3)::INT AS weight FROM supplier WHERE s_suppkey BETWEEN 1 AND 4)",
    "ring5": "ring5 AS (SELECT s_suppkey AS node_id, (1 + s_suppkey % 3)::INT AS weight FROM supplier WHERE s_suppkey BETWEEN 1 AND 5)",
    "places": "places AS (SELECT DISTINCT key, chunk FROM blocks)",
    "grants": """grants AS (SELECT DISTINCT c_custkey % 150 AS client, CASE WHEN c_custkey % 50 = 7 THEN '*' ELSE 'docs' END AS bucket,
  CASE WHEN c_custkey % 50 = 7 THEN '' ELSE CASE c_custkey % 4 WHEN 0 THEN 'en/' WHEN 1 THEN 'de/' WHEN 2 THEN 'fr/' ELSE 'es/' END END AS prefix,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 3 WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 2 ELSE 1 END AS level FROM customer)""",
    "states": """states AS (SELECT doc_id, req_id, ts_ms AS valid_from, lead(ts_ms) OVER (PARTITION BY doc_id ORDER BY ts_ms, req_id) AS valid_to,
  CASE WHEN req_id % 7 <> 0 THEN '"v' || req_id || '"' END AS etag FROM requests WHERE event_type = 'purchase')""",
    "bulk": """bulk AS (SELECT l_orderkey AS order_key, l_linenumber AS line, (epoch_us(l_shipdate) // 1000) AS ts_ms, size, first, least(first + (l_quantity * 64)::BIGINT, size) AS stop FROM (
  SELECT l.*, greatest(1, floor(o_totalprice))::BIGINT AS size, (floor(l_extendedprice)::BIGINT % greatest(1, floor(o_totalprice))::BIGINT) AS first FROM lineitem l JOIN orders ON l_orderkey = o_orderkey))""",
}


def with_views(names: str, body: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
