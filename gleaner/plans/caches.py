"""Queries of conditional and cached fetches, protocol memory, cache figures and bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import folds, html
from gleaner.functions.dialect import Duck, Spark
from gleaner.operators import caching
from gleaner.plans.fetches import LOG
from gleaner.plans.registry import query
from gleaner.sources.tables import fetch_log, table

_VISITS = "SELECT 'https://h' || user_id || '/' || event_type AS url, ts, event_id, 'v' || (event_id % 2) AS etag_now, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'day ' || dayofmonth(ts) END AS modified, props AS body_now FROM events"


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a page over time, and what the server has then (its validators change with the event)."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("url"), "ts", n, F.concat(F.lit("v"), (n % 2).cast("string")).alias("etag_now"),
        F.when(n % 5 != 0, F.concat(F.lit("day "), F.dayofmonth("ts").cast("string"))).alias("modified"), F.col("props").alias("body_now"))


@query(f"""WITH v AS ({_VISITS}), p AS (SELECT *, lag(etag_now) OVER w AS etag, lag(modified) OVER w AS last_modified FROM v WINDOW w AS (PARTITION BY url ORDER BY ts, event_id))
SELECT event_id, CASE WHEN etag = etag_now THEN 304 ELSE 200 END AS status, CASE WHEN etag = etag_now THEN NULL ELSE body_now END AS body, url AS final_url, etag AS if_none_match, last_modified AS if_modified_since FROM p""")
def conditional_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request with the validators stored before it: 304 without a body where they still hold."""
    v = visits(spark, sf_dir)
    stored = caching.validators(v.select("url", "ts", "event_id", F.col("etag_now").alias("etag"), F.col("modified").alias("last_modified"), F.lit(200).alias("status")))
    c = caching.conditional(v.drop("modified"), stored)
    return c.select("event_id", "status", "body", "final_url", F.try_element_at("headers", F.lit("if-none-match")).alias("if_none_match"), F.try_element_at("headers", F.lit("if-modified-since")).alias("if_modified_since"))


_CACHE = "SELECT url, 1000 - min(page_id) % 100 AS stored_at, min(html) AS body FROM pages GROUP BY url"


@query(f"""WITH c AS ({_CACHE}), ok AS (SELECT url, body FROM c WHERE 1000 - stored_at < 60 AND NOT {html.empty_body(Duck, 'body')}),
r AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url WHEN url LIKE '%/' THEN rtrim(url, '/') ELSE url || '/' END AS url FROM pages),
a AS (SELECT *, CASE WHEN url LIKE '%/' THEN rtrim(url, '/') ELSE url || '/' END AS other FROM r)
SELECT page_id, coalesce(o1.url, o2.url) AS cached_url, md5(coalesce(o1.body, o2.body, 'fetched ' || a.url)) AS digest, CASE WHEN coalesce(o1.body, o2.body) IS NULL THEN 'fetch' ELSE 'cache' END AS origin FROM a LEFT JOIN ok AS o1 ON a.url = o1.url LEFT JOIN ok AS o2 ON a.other = o2.url""")
def cached_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache reads by the URL and with its trailing slash toggled; stale and empty entries are fetched anew."""
    p = table(spark, sf_dir, "pages")
    cache = p.groupBy("url").agg((1000 - F.min("page_id") % 100).alias("stored_at"), F.min("html").alias("body"))
    asked = p.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(caching.other_slash(F.col("url"))).alias("url"))
    hits = caching.cached(asked, cache, F.lit(1000), F.lit(60), useless=F.expr(html.empty_body(Spark, "body")))
    fresh = asked.select("url").distinct().withColumn("fetched_body", F.concat(F.lit("fetched "), F.col("url")))
    both = caching.with_fallback(hits.withColumn("cached_at", F.col("cached_url")), fresh)
    return both.select("page_id", F.col("cached_at").alias("cached_url"), F.md5(F.col("body").cast("binary")).alias("digest"), "origin")


@query(LOG + "SELECT host, round(count(*) FILTER (status = 304) / count(*), 6) AS hit_rate, arg_max(CASE WHEN event_id % 3 = 0 THEN 'h2' ELSE 'http/1.1' END, (ts, event_id)) AS protocol FROM f GROUP BY host")
def host_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache hit rate and the protocol seen last, by host."""
    hit = F.count_if(F.col("status") == 304)
    protocol = F.when(F.col("event_id") % 3 == 0, "h2").otherwise("http/1.1")
    return fetch_log(spark, sf_dir).groupBy("host").agg(F.round(caching.hit_rate(hit, F.count_if(F.col("status") != 304)), 6).alias("hit_rate"), F.max_by(protocol, F.struct("ts", "event_id")).alias("protocol"))


@query("""WITH w AS (SELECT event_type, event_id, count(*) OVER o AS n, sum(strlen(props)) OVER o AS s FROM events WINDOW o AS (PARTITION BY event_type ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_type, event_id FROM w WHERE n <= 40 AND s <= 300""")
def bounded_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of each type keeps under bounds of entries and bytes."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", F.octet_length("props").alias("n_bytes"))
    return caching.bounded(e, 40, 300, used="ts", key="event_id", per="event_type").select("event_type", "event_id")


@query(LOG + """, g AS (SELECT host, event_id % 3 AS backend, list(latency_ms ORDER BY ts, event_id) AS x FROM f GROUP BY ALL)
SELECT host, backend, list_reduce(x, lambda e, v: (4 * e + v) // 5) AS ema_ms FROM g""")
def backend_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncating integer EMA of each backend of a host; the first race seeds it."""
    g = fetch_log(spark, sf_dir).groupBy("host", (F.col("event_id") % 3).alias("backend")).agg(folds.ordered(F.col("latency_ms")).alias("x"))
    return g.select("host", "backend", folds.ema_fifths(F.col("x")).alias("ema_ms"))


_HEDGE = LOG + """, g AS (SELECT host, list(latency_ms ORDER BY ts, event_id) AS x, count(*) AS n, count(*) FILTER (event_id % 4 = 0) AS fires, count(*) FILTER (event_id % 4 = 0 AND (event_id // 4) % 3 > 0) AS wins FROM f GROUP BY host),
k AS (SELECT host, count(*) AS streak FROM (SELECT *, max(CASE WHEN ok THEN (ts, event_id) END) OVER (PARTITION BY host) AS good FROM f) WHERE good IS NULL OR (ts, event_id) > good GROUP BY host),
h AS (SELECT g.*, coalesce(streak, 0) AS streak, list_reduce(x, lambda e, v: (4 * e + v) // 5) AS ema, list_reduce(list_transform(x, lambda v: v * v), lambda e, v: (4 * e + v) // 5) AS sq FROM g LEFT JOIN k USING (host)),
a AS (SELECT *, ema + CAST(floor(sqrt(greatest(0, sq - ema * ema))) AS BIGINT) AS d0 FROM h), b AS (SELECT *, CASE WHEN streak >= 3 THEN d0 // 2 ELSE d0 END AS d1 FROM a)
SELECT host, CAST(fires AS BIGINT) AS fires, CASE WHEN fires = 0 THEN 0 ELSE wins * 100 // fires END AS win_pct, CAST(streak AS BIGINT) AS streak, CASE WHEN n < 10 THEN 200 ELSE greatest(200, CASE WHEN fires >= 5 AND wins * 100 // fires > 50 THEN d1 * 3 // 4 ELSE d1 END) END AS delay_ms, n >= 10 AND 5000 > ema * 150 // 100 AS hedges FROM b"""


@query(_HEDGE)
def hedge_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hedge trigger and delay of each host: EMA and deviation, halved after three failures in a row, three quarters where hedges win most."""
    log = fetch_log(spark, sf_dir)
    fired = F.col("event_id") % 4 == 0
    won = fired & (F.expr("event_id div 4") % 3 > 0)
    last_good = F.max(F.when(F.col("ok"), F.struct("ts", "event_id")))
    g = log.groupBy("host").agg(folds.ordered(F.col("latency_ms")).alias("x"), F.count(F.lit(1)).alias("n"), F.count_if(fired).alias("fires"), F.count_if(won).alias("wins"), last_good.alias("good"))
    bad = log.filter("not ok").join(g.select("host", "good"), "host").filter(F.col("good").isNull() | (F.struct("ts", "event_id") > F.col("good")))
    g = g.join(bad.groupBy("host").agg(F.count(F.lit(1)).alias("streak")), "host", "left").withColumn("streak", F.coalesce("streak", F.lit(0)))
    ema, sq = folds.ema_fifths(F.col("x")), folds.ema_fifths(F.transform("x", lambda v: v * v))
    g = g.select("host", "n", "fires", "wins", "streak", ema.alias("ema"), sq.alias("sq"))
    return g.select("host", "fires", folds.win_pct(F.col("wins"), F.col("fires")).alias("win_pct"), "streak", folds.hedge_delay(F.lit(200), F.col("n"), F.col("ema"), F.col("sq"), F.col("streak"), F.col("fires"), F.col("wins")).alias("delay_ms"), folds.should_hedge(F.lit(5000), F.col("n"), F.col("ema")).alias("hedges"))


@query(LOG + """, t AS (SELECT host, ts, event_id, CAST(latency_ms AS DOUBLE) / 1000 AS retry_after FROM f WHERE status = 503)
SELECT host, round(greatest(0.01, 1 / greatest(1.0, arg_max(retry_after, (ts, event_id)))), 9) AS rate, CAST(0 AS DOUBLE) AS tokens FROM t GROUP BY host""")
def throttled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rate of each host after its last Retry-After: one token in that time, and an empty bucket."""
    t = fetch_log(spark, sf_dir).filter("status = 503")
    last = t.groupBy("host").agg(F.max_by(F.col("latency_ms") / 1000.0, F.struct("ts", "event_id")).alias("wait"))
    return last.select("host", F.round(folds.throttled_rate(F.col("wait")), 9).alias("rate"), F.lit(0.0).alias("tokens"))


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) AS attempts, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) >= 86400000000 AS expired FROM events""")
def attempts_and_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts so far of each (user, level), and whether the user's crawl has run for a day."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events")
    begun = e.groupBy("user_id").agg(F.min("ts").alias("begun"))
    j = e.join(begun, "user_id")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return j.select("event_id", F.row_number().over(w).cast("long").alias("attempts"), (micros("ts") - micros("begun") >= 86_400_000_000).alias("expired"))


@query(LOG + """, m AS (SELECT host, (epoch_us(ts) // 1000 + k) // 60000 AS minute FROM f, (VALUES (0), (1)) AS v(e), LATERAL (SELECT CASE WHEN e = 0 THEN 0 ELSE latency_ms END AS k) WHERE e = 0 OR (epoch_us(ts) // 1000 + latency_ms) // 60000 > epoch_us(ts) // 60000000)
SELECT host, minute, count(*) AS in_flight, count(*) > 1 AS under_load FROM m GROUP BY host, minute""")
def load_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in flight in each minute of a host (a request counts in the minute it begins and in that it ends), and which are above the threshold."""
    ms = F.unix_millis("ts")
    a, b = F.floor(ms / 60000), F.floor((ms + F.col("latency_ms")) / 60000)
    m = fetch_log(spark, sf_dir).select("host", F.explode(F.array_distinct(F.array(a, b))).alias("minute"))
    return m.groupBy("host", "minute").agg(F.count(F.lit(1)).alias("in_flight")).withColumn("under_load", F.col("in_flight") > 1)


@query("""WITH a AS (SELECT user_id, ts, event_id, event_type IN ('purchase', 'click') AS success, 1 + event_id % 3 AS attempts, event_type FROM events)
SELECT user_id, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, round(count(*) FILTER (success) / count(*), 6) AS success_rate, coalesce(arg_max(attempts, (ts, event_id)) FILTER (healed), 0) AS last_attempts, count(*) FILTER (event_type = 'error') AS n_errors
FROM (SELECT *, bool_or(success) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS healed FROM a) GROUP BY user_id""")
def healing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts, successes, rate and issues of healing by user; the attempts figure is that of the last one once any has succeeded."""
    from gleaner.operators import steps

    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").isin("purchase", "click").alias("success"), (1 + F.col("event_id") % 3).alias("attempts"), F.col("event_type").alias("issue"))
    return steps.healing(e, "user_id", "error").select("user_id", "total", "successful", "failed", F.round("success_rate", 6).alias("success_rate"), "last_attempts", "n_errors")
