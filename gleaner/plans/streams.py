"""Structured Streaming queries over events, run to the end of what is there (availableNow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans.registry import query
from gleaner.streaming import events as S


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.finished(S.tumbling(S.read(spark, sf_dir), "1 hour"), "complete")


@query("""WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * k AS start, value FROM events, range(2) AS r(k))
SELECT start, count(*) AS n, round(max(value), 6) AS most FROM w GROUP BY 1""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.finished(S.sliding(S.read(spark, sf_dir), "1 hour", "30 minutes"), "complete")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, by gaps of two hours; batch form of the session window."""
    return S.sessions(S.batch(spark, sf_dir), "2 hours")


@query("SELECT DISTINCT event_type, user_id FROM events")
def coalesced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (type, user) while none of the same key is in flight: repeats within the watermark are dropped, and the table is one batch."""
    r = S.read(spark, sf_dir).withColumn("key", F.concat_ws("/", "event_type", F.col("user_id").cast("string")))
    return S.finished(S.in_flight(r, "key").select("event_type", "user_id"), "append")


_TTL = 6 * 3600 * 1000


@query(f"""WITH x AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, list_reduce(list({{'n': n, 'stored': ms, 'hits': CAST([] AS BIGINT[])}} ORDER BY n), lambda a, b: CASE WHEN b.stored - a.stored < {_TTL} THEN {{'n': b.n, 'stored': a.stored, 'hits': list_append(a.hits, b.n)}} ELSE {{'n': b.n, 'stored': b.stored, 'hits': a.hits}} END) AS e FROM x GROUP BY user_id)
SELECT event_id, user_id, list_contains(e.hits, n) AS hit FROM x JOIN r USING (user_id)""")
def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a cache by user with a time to live of six hours, in streaming state."""
    e = S.read(spark, sf_dir).withColumnRenamed("user_id", "key")
    return S.finished(S.ttl_cache(e, _TTL).withColumnRenamed("key", "user_id"), "append")


@query("SELECT 'all' AS sink, event_id, CAST(NULL AS BIGINT) AS n FROM events UNION ALL SELECT event_type, CAST(NULL AS BIGINT), count(*) FROM events GROUP BY event_type")
def page_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch goes to two subscribers: one keeps the rows, one counts them by type."""
    at = S.place(spark)
    S.fan_out(S.read(spark, sf_dir), [S.to_folder(f"{at}/all", lambda r: r.select("event_id")), S.to_folder(f"{at}/counts", lambda r: r.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))], at)
    rows = spark.read.parquet(f"{at}/all").select(F.lit("all").alias("sink"), "event_id", F.lit(None).cast("long").alias("n"))
    counts = spark.read.parquet(f"{at}/counts").groupBy("event_type").agg(F.sum("n").alias("n"))
    return rows.unionByName(counts.select(F.col("event_type").alias("sink"), F.lit(None).cast("long").alias("event_id"), "n"))


@query("SELECT event_id, event_type FROM events")
def resumed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is stopped and resumed at its checkpoint: every event once."""
    return S.stop_and_resume(spark, lambda: S.read(spark, sf_dir).select("event_id", "event_type"))


@query("""WITH g AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(x, lambda e, v: e + 0.15 * (v - e)), 6) AS ema, CAST(len(x) AS BIGINT) AS n FROM g""")
def stateful_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user EMA kept in streaming state: the last update of each user."""
    return S.last_ema(S.read(spark, sf_dir))
