"""Byte ranges, entity tags and answers, as column expressions.

A range is three columns: ``kind`` (whole, inclusive, from, suffix) and two
numbers ``a``, ``b``. Null kind means no range was asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(kind: Column, a: Column, b: Column) -> Column:
    """An inclusive range that ends before it starts is invalid, and ignored."""
    return ~F.coalesce((kind == "inclusive") & (b < a), F.lit(False))


def resolve(kind: Column, a: Column, b: Column, size: Column) -> Column:
    """``struct<first,last>`` of the bytes asked for; null fields if none can be given."""
    whole = kind.isNull() | (kind == "whole") | ~is_valid(kind, a, b)
    first = (
        F.when(size <= 0, None)
        .when(whole, F.lit(0).cast("long"))
        .when(kind == "suffix", F.when(a > 0, size - F.least(a, size)))
        .when(a < size, a)
    )
    last = F.when(first.isNull(), None).when(whole | (kind != "inclusive"), size - 1).otherwise(F.least(b, size - 1))
    return F.struct(first.cast("long").alias("first"), last.cast("long").alias("last"))


def parse_range(header: Column) -> Column:
    """``bytes=a-b``, ``bytes=a-``, ``bytes=-n``; lists and anything else give nulls."""
    spec = F.regexp_extract(F.trim(header), r"^bytes=([^,]*)$", 1)
    lo = F.regexp_extract(spec, r"^\s*(\d*)\s*-\s*(\d*)\s*$", 1)
    hi = F.regexp_extract(spec, r"^\s*(\d*)\s*-\s*(\d*)\s*$", 2)
    a, b = lo.try_cast("long"), hi.try_cast("long")
    kind = F.when((lo != "") & (hi != "") & a.isNotNull() & b.isNotNull(), "inclusive").when((lo != "") & (hi == "") & a.isNotNull(), "from").when((lo == "") & (hi != "") & b.isNotNull(), "suffix")
    return F.struct(kind.alias("kind"), F.when(kind == "suffix", b).when(kind.isNotNull(), a).alias("a"), F.when(kind == "inclusive", b).alias("b"))


def format_range(kind: Column, a: Column, b: Column) -> Column:
    return F.when(kind == "inclusive", F.concat(F.lit("bytes="), a, F.lit("-"), b)).when(kind == "from", F.concat(F.lit("bytes="), a, F.lit("-"))).when(kind == "suffix", F.concat(F.lit("bytes=-"), a))


def format_content_range(first: Column, last: Column, size: Column) -> Column:
    return F.concat(F.lit("bytes "), first, F.lit("-"), last, F.lit("/"), size)


def parse_content_range(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, r"^bytes (\d+)-(\d+)/(\d+)$", i).try_cast("long")
    return F.struct(part(1).alias("first"), part(2).alias("last"), part(3).alias("size"))


def etag_condition(header: Column) -> Column:
    """``struct<usable, etag>``: one strong tag, quoted; none without a header;
    not usable for a wildcard, a list or a weak tag."""
    v = F.trim(header)
    bad = (v == "*") | v.contains(",") | v.startswith("W/")
    return F.struct(F.coalesce(~bad, F.lit(True)).alias("usable"), F.when(~bad, F.when(v.startswith('"'), v).otherwise(F.concat(F.lit('"'), v, F.lit('"')))).alias("etag"))


def precondition(if_match: Column, if_none_match: Column, etag: Column) -> Column:
    """412 for a failed If-Match, before 304 for a matching If-None-Match; else null."""
    return F.when(if_match.isNotNull() & (if_match != etag), F.lit(412)).when(if_none_match == etag, F.lit(304))


def answer(method: Column, kind: Column, a: Column, b: Column, if_match: Column, if_none_match: Column, etag: Column, size: Column) -> Column:
    """``struct<status, first, last, content_length>`` of a read; a null etag is an absent object."""
    cond = precondition(if_match, if_none_match, etag)
    asked = kind.isNotNull() & (kind != "whole") & is_valid(kind, a, b)
    r = resolve(kind, a, b, size)
    status = F.when(etag.isNull(), 404).when(cond.isNotNull(), cond).when(asked & r["first"].isNull(), 416).when(asked, 206).otherwise(200)
    has = status.isin(200, 206)
    body = has & (method == "GET") & r["first"].isNotNull()
    return F.struct(
        status.alias("status"),
        F.when(body, r["first"]).alias("first"),
        F.when(body, r["last"]).alias("last"),
        F.when(has, F.coalesce(r["last"] - r["first"] + 1, F.lit(0).cast("long"))).alias("content_length"),
    )


#: S3 error codes and messages by status.
ERROR_CODES = {400: "InvalidRequest", 403: "AccessDenied", 404: "NoSuchKey", 412: "PreconditionFailed", 416: "InvalidRange", 501: "NotImplemented", 503: "ServiceUnavailable"}
#: The message S3 gives with each status.
ERROR_MESSAGES = {
    400: "The request is invalid.",
    403: "Access Denied",
    404: "The specified key does not exist.",
    412: "At least one of the pre-conditions you specified did not hold",
    416: "The requested range is not satisfiable",
    501: "A header you provided implies functionality that is not implemented.",
    503: "Please reduce your request rate.",
}


def by_status(status: Column, table: dict[int, str], other: str) -> Column:
    out = None
    for code, text in table.items():
        out = F.when(status == code, text) if out is None else out.when(status == code, text)
    return out.otherwise(other)
