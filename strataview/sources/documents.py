"""Small documents from outside: result JSON, metric JSON, key lists in XML, kernel counters."""

from __future__ import annotations

import io
import xml.sax
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "struct<step: string, host: int, seconds: double, classes: array<struct<name: string, bytes: bigint, statuses: map<string, bigint>>>>"
LARGEST_XML = 8 << 20


def merge_results(df: DataFrame, body: str) -> DataFrame:
    """Host results merged by step and class, classes by their place: bytes and
    statuses summed, seconds the longest host's."""
    r = df.select(F.from_json(body, RESULT).alias("r")).select("r.*")
    steps = r.groupBy("step").agg(F.max("seconds").alias("seconds"), F.count_distinct("host").alias("hosts"))
    c = r.select("step", F.posexplode("classes").alias("place", "c"))
    classes = c.select("step", "place", "c.name", "c.bytes", F.explode("c.statuses").alias("status", "n"))
    byte = c.groupBy("step", "place").agg(F.first("c.name").alias("class"), F.sum("c.bytes").alias("bytes"))
    n = classes.groupBy("step", "place", "status").agg(F.sum("n").alias("n"))
    return n.join(byte, ["step", "place"]).join(steps, "step")


def flat_metrics(body: Column) -> Column:
    """``map<string,double>`` of a flat JSON object."""
    return F.from_json(body, "map<string,double>")


class _Keys(xml.sax.ContentHandler):
    def __init__(self):
        super().__init__()
        self.keys: list[str] = []
        self.text: list[str] | None = None

    def startElementNS(self, name, qname, attrs):  # noqa: N802
        if name[1] == "Key":
            self.text = []

    def characters(self, content):
        if self.text is not None:
            self.text.append(content)

    def endElementNS(self, name, qname):  # noqa: N802
        if name[1] == "Key" and self.text is not None:
            self.keys.append("".join(self.text))
            self.text = None


def listed_keys(text: str | None) -> list[str] | None:
    """The text of every ``Key`` element of any namespace; None for a document
    that is malformed, too large, or declares a type."""
    if text is None or len(text.encode()) > LARGEST_XML or "<!DOCTYPE" in text:
        return None
    parser = xml.sax.make_parser()
    parser.setFeature(xml.sax.handler.feature_namespaces, True)
    handler = _Keys()
    parser.setContentHandler(handler)
    try:
        parser.parse(io.StringIO(text))
    except xml.sax.SAXException:
        return None
    return handler.keys


def xml_keys(text: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([listed_keys(t) for t in s]), "array<string>")(text)


def kernel_counters(text: str) -> dict[str, float]:
    """Counters of a snapshot with ``== section`` blocks: time, cpu, net, tcp, nic, disk."""
    out: dict[str, float] = {}
    section, names = "", []
    for line in text.splitlines():
        if line.startswith("== "):
            section, names = line[3:].strip(), []
            continue
        p = line.split()
        if not p:
            continue
        if section == "time":
            out["time"] = float(p[0])
        elif section == "cpu" and p[0] == "cpu":
            v = [float(x) for x in p[1:]]
            out["cpu_total"], out["cpu_busy"] = sum(v), sum(v) - sum(v[3:5])
        elif section == "net" and p[0].endswith(":") and p[0] != "lo:":
            out["rx_bytes"] = out.get("rx_bytes", 0) + float(p[1])
            out["tx_bytes"] = out.get("tx_bytes", 0) + float(p[9])
        elif section == "tcp" and p[0].endswith(":"):
            if names[:1] == [p[0]]:  # the row of values follows the row of names
                out |= {f"{p[0][:-1]}_{n}".lower(): float(x) for n, x in zip(names[1:], p[1:], strict=False)}
                names = []
            else:
                names = p
        elif section == "nic" and ":" in line:
            name, _, value = line.partition(":")
            out[f"nic_{name.strip()}"] = float(value)
        elif section == "disk" and len(p) > 9:
            out["read_bytes"] = out.get("read_bytes", 0) + float(p[5]) * 512
            out["written_bytes"] = out.get("written_bytes", 0) + float(p[9]) * 512
    return out


def kernel_table(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, name, value`` from snapshots, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(*[r[k] for k in keys], n, v) for r in f.to_dict("records") for n, v in sorted(kernel_counters(r[text]).items())]
            yield pd.DataFrame(rows, columns=[*keys, "name", "value"])

    kinds = dict(df.dtypes)
    return df.select(*keys, text).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", name string, value double")


def host_rates(counters: DataFrame, keys: list[str]) -> DataFrame:
    """What hosts did between two snapshots (``moment`` before/after) of
    :func:`kernel_table`: CPU busy, GiB/s of the network and GiB of disks over
    the snapshots' own interval, segments sent again, allowance drops."""
    gib = float(1 << 30)
    name = F.when(F.col("name").contains("allowance_exceeded"), "allowance").otherwise(F.col("name"))
    d = counters.groupBy(*keys, name.alias("name")).agg((F.sum(F.when(F.col("moment") == "after", F.col("value"))) - F.sum(F.when(F.col("moment") == "before", F.col("value")))).alias("d"))
    wanted = ["time", "cpu_busy", "cpu_total", "rx_bytes", "tx_bytes", "read_bytes", "written_bytes", "tcp_outsegs", "tcp_retranssegs", "allowance"]
    v = d.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("name") == w, F.col("d"))), F.lit(0.0)).alias(w) for w in wanted])
    per = lambda c, by: F.round(F.col(c) / gib / by, 6)
    return v.select(
        *keys,
        F.round(100 * F.col("cpu_busy") / F.greatest("cpu_total", F.lit(1.0)), 6).alias("cpu_busy_percent"),
        per("rx_bytes", F.col("time")).alias("received_gib_s"),
        per("tx_bytes", F.col("time")).alias("sent_gib_s"),
        per("read_bytes", 1).alias("read_gib"),
        per("written_bytes", 1).alias("written_gib"),
        F.round(100 * F.col("tcp_retranssegs") / F.greatest("tcp_outsegs", F.lit(1.0)), 6).alias("retransmitted_percent"),
        F.col("allowance").alias("allowance_drops"),
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``host time metric value`` of every process, summed over processes."""
    p = spark.read.text(path).select(F.split("value", " ").alias("p")).filter(F.size("p") == 4)
    p = p.select(F.col("p")[0].alias("host"), F.col("p")[1].try_cast("long").alias("t"), F.col("p")[2].alias("metric"), F.col("p")[3].try_cast("double").alias("value"))
    return p.filter("t is not null and value is not null").groupBy("host", "t", "metric").agg(F.sum("value").alias("value"))


def write_timeline(df: DataFrame, path: str) -> None:
    """A CSV sink with a header, one file a partition."""
    df.write.mode("overwrite").option("header", True).csv(path)
