"""Sources: Parquet tables, and inputs derived from them."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same derivation for DuckDB: a request log of hosts, out of events.
FETCH_LOG = """SELECT 'h' || (user_id % 20) AS host, 'https://h' || (user_id % 20) || '/' || event_type || '/' || event_id AS url, ts, event_id, CAST(floor(value * 100) AS BIGINT) AS latency_ms,
CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 304 WHEN 'purchase' THEN 201 ELSE 200 END AS status, event_type <> 'error' AS ok FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    now = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in now.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (here, now) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, url, ts, event_id, latency_ms, status, ok."""
    host = F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string"))
    kind = F.col("event_type")
    status = F.when(kind == "error", 503).when(kind == "signup", 304).when(kind == "purchase", 201).otherwise(200)
    return table(spark, sf_dir, "events").select(
        host.alias("host"), F.concat(F.lit("https://"), host, F.lit("/"), kind, F.lit("/"), F.col("event_id").cast("string")).alias("url"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id", F.floor(F.col("value") * 100).cast("long").alias("latency_ms"), status.alias("status"), (kind != "error").alias("ok"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that executors share: spark.checkpoint.dir; our own only where that is unset and all runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), f"gleaner-{os.getpid()}")
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df into the folder that executors share and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def expand_glob(url: str) -> list[str]:
    """Seeds of a URL template: `{a,b}` lists, `[1-10:2]` and `[a-c]` ranges with zero padding; no pattern: none."""
    import itertools

    parts = re.split(r"(\{[^{}]*\}|\[[^\[\]]*\])", url)
    options, found = [], False
    for p in parts:
        m = re.fullmatch(r"\[(\d+)-(\d+)(?::(\d+))?\]", p)
        c = re.fullmatch(r"\[([a-zA-Z])-([a-zA-Z])(?::(\d+))?\]", p)
        if p.startswith("{") and p.endswith("}"):
            options.append(p[1:-1].split(","))
        elif m:
            width = len(m[1]) if m[1].startswith("0") else 0
            options.append([str(i).zfill(width) for i in range(int(m[1]), int(m[2]) + 1, max(1, int(m[3] or 1)))])
        elif c:
            options.append([chr(i) for i in range(ord(c[1]), ord(c[2]) + 1, max(1, int(c[3] or 1)))])
        else:
            options.append([p])
            continue
        found = True
    return ["".join(x) for x in itertools.product(*options)] if found else []


def seeds(spark: SparkSession, templates: list[str]) -> DataFrame:
    """(template, url) of the expanded seeds, expanded on the executors."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            yield pd.DataFrame([(t, u) for t in b["template"] for u in expand_glob(t)], columns=["template", "url"])

    return spark.createDataFrame([(t,) for t in templates], "template string").mapInPandas(run, "template string, url string")


def sitemap(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """One row a <loc> of sitemap texts."""
    return docs.select(F.explode(F.xpath(F.regexp_replace(xml, ' xmlns="[^"]*"', ""), F.lit("urlset/url/loc/text()"))).alias("url"))
