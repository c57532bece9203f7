"""Sinks: WARC text, JSON lines, files by local path, visited sets."""

from __future__ import annotations

import re
import unicodedata
from hashlib import md5
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_type(body: Column) -> Column:
    """Guess from the first bytes."""
    start = F.ltrim(F.substring(body, 1, 64))
    return (
        F.when(start.startswith("<"), "text/html").when(start.startswith("{") | start.startswith("["), "application/json").when(start.startswith("%PDF"), "application/pdf")
        .when(start.startswith("GIF8"), "image/gif").when(F.substring(body, 2, 3) == "PNG", "image/png").when(start.rlike(r"^[\x09\x0a\x0d\x20-\x7e]*$"), "text/plain").otherwise("application/octet-stream")
    )


def warc_record(url: Column, status: Column, body: Column, epoch: Column) -> Column:
    """A WARC/1.0 response record; null for an empty URL. The record id comes from the URL and time, so reruns agree."""
    block = F.concat(F.lit("HTTP/1.1 "), status.cast("string"), F.lit("\r\nContent-Type: "), content_type(body), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    h = F.md5(F.concat_ws("|", url, epoch.cast("string")))
    uid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: "), F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\r\nWARC-Record-ID: <urn:uuid:"), uid,
        F.lit(">\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))
    return F.when(url != "", head)


def warc_info(software: str) -> str:
    body = f"software: {software}\r\nformat: WARC File Format 1.0\r\n"
    return f"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"


def write_warc(pages: DataFrame, path: str, software: str = "gleaner", mode: str = "error") -> None:
    """One file a task, each beginning with a warcinfo record."""
    records = pages.select(warc_record(F.col("url"), F.col("status"), F.col("html"), F.col("epoch")).alias("value")).filter("value is not null")

    def headed(batches):
        yield pd.DataFrame({"value": [warc_info(software)]})
        yield from batches

    # Records end in a line feed, which the text sink adds.
    records.mapInPandas(headed, "value string").select(F.expr("substr(value, 1, length(value) - 1)").alias("value")).write.mode(mode).text(path, lineSep="\n")


def write_json(pages: DataFrame, path: str) -> None:
    pages.write.json(path)


def append_unseen(new: DataFrame, path: str, key: str = "url") -> None:
    """Insert if absent, ignoring case: an anti join, then an append. One writer at a time: what two write at once can come twice."""
    spark = new.sparkSession
    fresh = new.withColumn("_k", F.lower(key)).dropDuplicates(["_k"])
    try:
        seen = spark.read.parquet(path).select(F.lower(key).alias("_k"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen = None
    (fresh.join(seen, "_k", "left_anti") if seen is not None else fresh).drop("_k").write.mode("append").parquet(path)


RESERVED = {"con", "prn", "aux", "nul", *(f"{n}{i}" for n in ("com", "lpt") for i in range(1, 10))}


def local_path(url_path: str) -> str:
    """A safe file path for a URL path: decoded, composed, forbidden characters replaced, reserved names and long ones changed."""
    out = []
    for part in unquote(url_path.split("?", 1)[0].split("#", 1)[0]).split("/"):
        name = re.sub(r'[<>:"|?*\\\x00-\x1f]', "_", unicodedata.normalize("NFC", part)).strip(" .")
        if not name:
            continue
        if name.split(".", 1)[0].lower() in RESERVED:
            name += "_"
        if len(name) > 120:
            name = name[:100] + "_" + md5(name.encode()).hexdigest()[:16]
        out.append(name)
    if not out:
        return "index.html"
    if url_path.endswith("/") or "." not in out[-1]:
        out[-1] += ".html"
    return "/".join(out)


def with_local_path(rows: DataFrame, url_path: str, out: str = "local_path") -> DataFrame:
    """rows with the file path of a URL path column, in Arrow batches."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else local_path(x))

    return rows.withColumn(out, F.pandas_udf(run, "string")(F.col(url_path)))


def warc_sink(path: str, software: str = "gleaner"):
    """A subscriber for streaming.events.fan_out: each batch (url, status, html, epoch) as WARC files in a folder of its own, so that running a batch again adds nothing."""

    def sink(rows: DataFrame, number: int) -> None:
        write_warc(rows, f"{path}/batch={number}", software, mode="overwrite")

    return sink
