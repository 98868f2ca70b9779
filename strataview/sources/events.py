"""Change events of an object store: JSON bodies to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORDS = "struct<Records: array<struct<eventName: string, eventTime: string, s3: struct<bucket: struct<name: string>, object: struct<key: string, eTag: string>>>>, Message: string>"


def parse_time(text: Column) -> Column:
    """Milliseconds of ``YYYY-MM-DDThh:mm:ss[.f]Z``; anything else, or a second above 60, is null."""
    ok = text.rlike(r"^\d{1,4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?Z$")
    second = F.regexp_extract(text, r":(\d{1,2})(?:\.\d+)?Z$", 1).try_cast("long")
    minute = F.try_to_timestamp(F.concat(F.regexp_replace(F.substring_index(text, ":", 2), "T", " "), F.lit(":00")))
    part = F.substring(F.concat(F.regexp_extract(text, r"\.(\d+)Z$", 1), F.lit("000")), 1, 3).try_cast("long")
    return F.when(ok & (second <= 60), F.unix_seconds(minute) * 1000 + second * 1000 + part)


def parse_changes(df: DataFrame, body: str) -> DataFrame:
    """One row per record of a body, or of the body an envelope carries as its
    ``Message``; bodies without records give none. Keys are URL-decoded; only
    creations carry a tag, quoted again."""
    direct = F.from_json(body, RECORDS)
    j = df.withColumn("__d", direct).withColumn("__r", F.coalesce("__d.Records", F.from_json("__d.Message", RECORDS)["Records"]))
    r = j.select(*df.columns, F.explode("__r").alias("__e"))
    tag = F.when(F.col("__e.eventName").startswith("ObjectCreated"), F.concat(F.lit('"'), F.regexp_replace("__e.s3.object.eTag", '^"|"$', ""), F.lit('"')))
    return r.select(*df.columns, F.col("__e.s3.bucket.name").alias("bucket"), F.url_decode("__e.s3.object.key").alias("key"), tag.alias("etag"), parse_time(F.col("__e.eventTime")).alias("event_ms"))
