"""Queries over a request log: telemetry, throttles, status rules, block-page detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import blocks, folds, html
from gleaner.functions.dialect import Duck, Spark
from gleaner.plans.registry import query
from gleaner.sources.tables import FETCH_LOG, fetch_log, table

LOG = f"WITH f AS ({FETCH_LOG}) "


@query(LOG + f"""SELECT host, round(list_reduce(list_transform(x, lambda v: CAST(v AS DOUBLE)), lambda e, v: e + 0.15 * (v - e)), 6) AS ema_ms,
greatest(100, least(60000, CAST(floor(list_reduce(list_transform(x, lambda v: CAST(v AS DOUBLE)), lambda e, v: e + 0.15 * (v - e)) / 2.0) AS BIGINT))) AS delay_ms FROM (SELECT host, list(latency_ms ORDER BY ts, event_id) AS x FROM f GROUP BY host)""")
def latency_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Float EMA of latency, and the throttle delay at a target of two requests in flight.

    The last 256 requests of a host are read: older ones weigh less than 1e-18, which a double doesn't hold beside the rest.
    """
    rows = folds.last_rows(fetch_log(spark, sf_dir), "host", folds.EMA_ROWS)
    g = rows.groupBy("host").agg(folds.ordered(F.col("latency_ms")).alias("x")).withColumn("e", folds.ema(F.col("x")))
    return g.select("host", F.round("e", 6).alias("ema_ms"), F.greatest(F.lit(100), F.least(F.lit(60000), F.floor(F.col("e") / 2.0))).cast("long").alias("delay_ms"))


@query(LOG + """, g AS (SELECT host, list(latency_ms ORDER BY ts, event_id) AS x FROM f GROUP BY host), h AS (SELECT host, list_reduce(x, lambda e, v: (4 * e + v) // 5) AS ema, list_reduce(list_transform(x, lambda v: v * v), lambda e, v: (4 * e + v) // 5) AS sq FROM g)
SELECT host, ema, CAST(floor(sqrt(greatest(0, sq - ema * ema))) AS BIGINT) AS sd_ms, greatest(200, ema + CAST(floor(sqrt(greatest(0, sq - ema * ema))) AS BIGINT)) AS hedge_ms FROM h""")
def latency_ema_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer EMA, its spread, and the hedge delay over a base of 200 ms."""
    g = fetch_log(spark, sf_dir).groupBy("host").agg(folds.ordered(F.col("latency_ms")).alias("x"))
    h = g.select("host", folds.ema_fifths(F.col("x")).alias("ema"), folds.ema_fifths(F.transform("x", lambda v: v * v)).alias("sq"))
    sd = F.floor(F.sqrt(F.greatest(F.lit(0), F.col("sq") - F.col("ema") * F.col("ema")))).cast("long")
    return h.select("host", "ema", sd.alias("sd_ms"), F.greatest(F.lit(200).cast("long"), F.col("ema") + sd).alias("hedge_ms"))


@query(LOG + """, g AS (SELECT host, list(ok ORDER BY ts, event_id) AS x FROM f GROUP BY host)
SELECT host, list_reduce(list_prepend(CAST(10000000 AS BIGINT), list_transform(x, lambda o: CAST(o AS BIGINT))), lambda s, o: CASE WHEN o = 0 THEN greatest(s // 1000000 // 2, 1) * 1000000 WHEN s % 1000000 + 1 >= 5 THEN least(s // 1000000 + 1, 64) * 1000000 ELSE s + 1 END) // 1000000 AS max_inflight FROM g""")
def aimd_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fetch_log(spark, sf_dir).groupBy("host").agg(folds.ordered(F.col("ok")).alias("x"))
    return g.select("host", folds.aimd(F.col("x"), 10, 1, 64, 5).alias("max_inflight"))


@query(LOG + """, i AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isle FROM f),
s AS (SELECT *, CASE WHEN ok THEN 0 ELSE sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY host, isle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS streak FROM i)
SELECT event_id, CAST(streak AS BIGINT) AS streak, streak >= 3 AS flagged, CAST(greatest(8000 >> CAST(least(streak // 3, 10) AS INT), 500) AS BIGINT) AS timeout_ms, CAST(least(30000, 100 * power(2, streak)) AS BIGINT) AS backoff_cap_ms FROM s""")
def wait_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = folds.failure_runs(fetch_log(spark, sf_dir))
    return s.select("event_id", "streak", (F.col("streak") >= 3).alias("flagged"), folds.guarded_timeout(8000, F.col("streak")).alias("timeout_ms"), folds.backoff_cap(F.col("streak"), 100, 30000).alias("backoff_cap_ms"))


@query(LOG + """SELECT host, count(*) AS n, count(*) FILTER (NOT ok) AS n_errors, count(*) FILTER (NOT ok) * 100 // count(*) AS error_pct, count(*) FILTER (ok) * 100 // count(*) AS win_pct, max(latency_ms) AS most_ms, max_by(status, ts) AS last_status, count(DISTINCT status) AS n_status,
count(*) FILTER (status IN (408, 429, 500, 502, 503, 504, 507, 508, 598, 599)) AS n_retryable, count(*) FILTER (status BETWEEN 200 AND 299) AS n_success, count(*) FILTER (status BETWEEN 300 AND 399) AS n_redirect FROM f GROUP BY host""")
def vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fetch_log(spark, sf_dir)
    bad = F.count_if(~F.col("ok"))
    n = F.count(F.lit(1))
    return f.groupBy("host").agg(
        n.alias("n"), bad.alias("n_errors"), F.expr("count_if(not ok) * 100 div count(1)").alias("error_pct"), F.expr("count_if(ok) * 100 div count(1)").alias("win_pct"),
        F.max("latency_ms").alias("most_ms"), F.max_by("status", "ts").alias("last_status"), F.countDistinct("status").alias("n_status"),
        F.count_if(blocks.retryable(F.col("status"))).alias("n_retryable"), F.count_if(F.col("status").between(200, 299)).alias("n_success"), F.count_if(F.col("status").between(300, 399)).alias("n_redirect"))


@query(LOG + "SELECT event_id, rank FROM (SELECT event_id, row_number() OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC) AS rank FROM f) WHERE rank <= 5")
def recent_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.last_rows(fetch_log(spark, sf_dir), "host", 5).select("event_id", F.col("_rn").cast("long").alias("rank"))


@query(LOG + "SELECT event_id, proxies[CAST((n - 1) % 3 + 1 AS INT)] AS proxy, CAST(n AS BIGINT) AS attempt FROM (SELECT event_id, ['p0', 'p1', 'p2'] AS proxies, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS n FROM f)")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("host").orderBy("ts", "event_id")
    f = fetch_log(spark, sf_dir).withColumn("attempt", F.row_number().over(w).cast("long"))
    return f.select("event_id", F.element_at(F.array(F.lit("p0"), F.lit("p1"), F.lit("p2")), F.pmod(F.col("attempt") - 1, F.lit(3)).cast("int") + 1).alias("proxy"), "attempt")


@query(LOG + "SELECT host, min_by(event_id, ts) AS winner, arg_max(event_id, (latency_ms, event_id)) AS slowest FROM f WHERE ok GROUP BY host")
def race_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch_log(spark, sf_dir).filter("ok").groupBy("host").agg(F.min_by("event_id", "ts").alias("winner"), F.max_by("event_id", F.struct("latency_ms", "event_id")).alias("slowest"))


@query(LOG + "SELECT host, sum(latency_ms) AS spent_ms, max_by(url, ts) AS last_url, arg_max(status, ts) AS fresh_status, max(ts) >= TIMESTAMP '2024-01-15 00:00:00' AS is_fresh FROM f GROUP BY host")
def latest_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row of each host, as validators and caches look it up; fresh if not older than a fixed time."""
    return fetch_log(spark, sf_dir).groupBy("host").agg(F.sum("latency_ms").alias("spent_ms"), F.max_by("url", "ts").alias("last_url"), F.max_by("status", "ts").alias("fresh_status"), (F.max("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("is_fresh"))


def _detect(d) -> str:
    return f"page_id, {blocks.from_url(d, 'url')} AS by_url, {blocks.from_body(d, 'html')} AS by_body, {blocks.soft_block(d, 'html')} AS soft_block, {blocks.smart_fallback(d, '200', 'html')} AS falls_back, {blocks.captcha(d, 'html')} AS has_captcha"


_ODD = "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'https://x.test/cdn-cgi/challenge-platform/a' WHEN page_id % 7 = 1 THEN 'https://geo.captcha-delivery.datadome.co/x' ELSE url END AS url, CASE WHEN page_id % 5 = 0 THEN '<html><body>verify you are human</body></html>' WHEN page_id % 5 = 1 THEN '<title>Access Denied</title>px-captcha DataDome' ELSE html END AS html FROM {0}"


@query(f"SELECT {_detect(Duck)} FROM ({_ODD.format('pages')}) AS p")
def block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-page detection; some pages are replaced by challenge pages, by id, as the tables hold none."""
    return spark.sql(f"SELECT {_detect(Spark)} FROM ({_ODD.format('{pages}')}) AS p", pages=table(spark, sf_dir, "pages"))


TYPES = ("text/html; charset=utf-8", "TEXT/XML", "text/csv", "audio/mpeg", "application/json", "image/png", "application/pdf", "font/woff2", "")


@query("SELECT * FROM (SELECT ct, " + html.content_class(Duck, "ct") + " AS class, " + blocks.binary_type(Duck, "ct") + " AS is_binary FROM (VALUES " + ", ".join(f"('{t}')" for t in TYPES) + ") AS t(ct))")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([(t,) for t in TYPES], "ct string")
    return t.selectExpr("ct", html.content_class(Spark, "ct") + " AS class", blocks.binary_type(Spark, "ct") + " AS is_binary")
