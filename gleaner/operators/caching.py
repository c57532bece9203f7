"""Validators, caches and their lookups, as joins on the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def validators(responses: DataFrame) -> DataFrame:
    """(url, ts, event_id, etag, last_modified) of the responses that carry a validator, but 304 ones, which store nothing."""
    return responses.filter((F.col("status") != 304) & (F.col("etag").isNotNull() | F.col("last_modified").isNotNull())).select("url", "ts", "event_id", "etag", "last_modified")


def as_of(requests: DataFrame, stored: DataFrame, key: str, values: list[str]) -> DataFrame:
    """requests (key, ts, event_id, ...) with `values` of the latest stored row of the key before them (null: none).

    One union and one running window by key: a single shuffle, memory of one row a task (rows of a key are sorted, and
    spill), and no pair of rows is made.
    """
    side = [c for c in requests.columns if c not in (key, "ts", "event_id")]
    kept = F.struct(*values)
    left = requests.select(key, "ts", "event_id", F.lit(1).alias("_side"), F.lit(None).cast(stored.select(kept.alias("x")).schema["x"].dataType).alias("_stored"), F.struct(*side).alias("_row"))
    right = stored.select(key, "ts", "event_id", F.lit(0).alias("_side"), kept.alias("_stored"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(key).orderBy("ts", "event_id", F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    last = left.unionByName(right).withColumn("_last", F.last("_stored", ignorenulls=True).over(w)).filter("_side = 1")
    return last.select(key, "ts", "event_id", *[F.col(f"_row.{c}").alias(c) for c in side], *[F.col(f"_last.{v}").alias(v) for v in values])


def conditional_headers(etag: Column, last_modified: Column) -> Column:
    """if-none-match and if-modified-since, of the validators there are."""
    pairs = F.array(F.struct(F.lit("if-none-match"), etag.alias("v")), F.struct(F.lit("if-modified-since"), last_modified.alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def conditional(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Conditional fetches: requests (url, ts, event_id, etag_now, body_now) against the validators stored before them.

    Adds headers, status (304 where the validator still holds, else 200), body (null at 304) and final_url.
    """
    j = as_of(requests, stored, "url", ["etag", "last_modified"])
    same = F.coalesce(F.col("etag") == F.col("etag_now"), F.lit(False))
    return j.withColumns({"headers": conditional_headers(F.col("etag"), F.col("last_modified")), "status": F.when(same, 304).otherwise(200), "body": F.when(~same, F.col("body_now")), "final_url": F.col("url")})


def other_slash(url: Column) -> Column:
    """The URL with its trailing slash taken off or put on."""
    return F.when(url.endswith("/"), F.nullif(F.regexp_replace(url, "/+$", ""), F.lit(""))).otherwise(F.concat(url, F.lit("/")))


def cached(requests: DataFrame, cache: DataFrame, now: Column, ttl: Column, allow_stale: bool = False, useless: Column | None = None) -> DataFrame:
    """requests (url, ...) with cached_body and cached_url (null: a miss): by the URL, then with the slash toggled.

    cache: (url, stored_at, body), a row a URL. Stale entries are rejected (unless allowed), and so are `useless` bodies.
    """
    good = F.lit(True) if allow_stale else (now - F.col("stored_at") < ttl)
    live = cache.filter(good & ~(F.lit(False) if useless is None else useless)).select(F.col("url").alias("_url"), "body")
    first = live.select(F.col("_url").alias("_u1"), F.col("body").alias("_b1"))
    second = live.select(F.col("_url").alias("_u2"), F.col("body").alias("_b2"))
    j = requests.join(first, F.col("url") == F.col("_u1"), "left").join(second, other_slash(F.col("url")) == F.col("_u2"), "left")
    return j.select(*requests.columns, F.coalesce("_b1", "_b2").alias("cached_body"), F.coalesce("_u1", "_u2").alias("cached_url"))


def with_fallback(hits: DataFrame, fetched: DataFrame) -> DataFrame:
    """Cached fetch: the cached body, else the fetched one (url, fetched_body); and where it came from."""
    j = hits.join(fetched, "url", "left")
    return j.select(*[c for c in hits.columns if c not in ("cached_body", "cached_url")], F.coalesce("cached_body", "fetched_body").alias("body"), F.when(F.col("cached_body").isNotNull(), "cache").when(F.col("fetched_body").isNotNull(), "fetch").alias("origin"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """hits / (hits + misses), 0 without any."""
    return F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0))


def bounded(cache: DataFrame, most_rows: int, most_bytes: int, used: str = "used_at", size: str = "n_bytes", key: str = "key", per: str | None = None) -> DataFrame:
    """The most recently used entries that fit both bounds (of each cache `per`), ties to the smaller key."""
    w = Window.partitionBy(per if per else F.lit(1)).orderBy(F.desc(used), F.asc(key)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = cache.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_sum", F.sum(size).over(w))
    return ranked.filter((F.col("_n") <= most_rows) & (F.col("_sum") <= most_bytes)).drop("_n", "_sum")
