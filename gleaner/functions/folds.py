"""Per-key ordered folds over a request log.

Latest-value folds that forget (the float EMA) need the last rows of a key alone, so a bounded top-k (pruned before
the shuffle) feeds them. Folds whose state never forgets (AIMD, integer EMA, token bucket) go through a key's whole
history in order: distributed forms of those are the streaming ones in gleaner.streaming, whose state is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: (1 - 0.15) ** 256 is below 1e-18: older samples don't reach a double.
EMA_ROWS = 256


def last_rows(log: DataFrame, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return log.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)


def ordered(value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", value.alias("x")))), lambda r: r["x"])


def ema(xs: Column, alpha: float = 0.15) -> Column:
    """First sample seeds; then e += a * (x - e)."""
    a = min(1.0, max(0.01, alpha))
    d = F.transform(xs, lambda x: x.cast("double"))
    return F.aggregate(F.slice(d, 2, 2**31 - 2), F.get(d, F.lit(0)), lambda e, x: e + F.lit(a) * (x - e))


def ema_fifths(xs: Column) -> Column:
    """Truncating integer form: (4 * old + x) / 5."""
    return F.aggregate(F.slice(xs, 2, 2**31 - 2), F.get(xs, F.lit(0)), lambda e, x: F.floor((e * 4 + x) / 5).cast("long"))


def aimd(oks: Column, start: int, least: int, most: int, threshold: int) -> Column:
    """Limit after a run of outcomes: one more after `threshold` successes, half after a failure (always half)."""
    zero = F.struct(F.lit(start).cast("long").alias("limit"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, ok: Column) -> Column:
        full = s["n"] + 1 >= threshold
        limit = F.when(ok, F.when(full, F.least(s["limit"] + 1, F.lit(most))).otherwise(s["limit"])).otherwise(F.greatest(F.floor(s["limit"] / 2), F.lit(least)))
        return F.struct(limit.cast("long").alias("limit"), F.when(ok & ~full, s["n"] + 1).otherwise(0).cast("long").alias("n"))

    return F.aggregate(oks, zero, step, lambda s: s["limit"])


def token_bucket(times_ms: Column, rate: float, burst: float) -> Column:
    """Wait in ms of the last request of ordered times: refill by elapsed time, take one, or wait for the deficit (a denied request takes none)."""
    zero = F.struct(F.lit(float(burst)).alias("tokens"), F.get(times_ms, F.lit(0)).alias("at"), F.lit(0.0).alias("wait"), F.lit(0).cast("long").alias("denied"))

    def step(s: Column, t: Column) -> Column:
        have = F.least(F.lit(float(burst)), s["tokens"] + (t - s["at"]) / 1000.0 * rate)
        ok = have >= 1.0
        return F.struct(F.when(ok, have - 1.0).otherwise(have).alias("tokens"), t.alias("at"), F.when(ok, 0.0).otherwise((1.0 - have) / rate * 1000.0).alias("wait"), (s["denied"] + F.when(ok, 0).otherwise(1)).cast("long").alias("denied"))

    return F.aggregate(times_ms, zero, step)


def failure_runs(log: DataFrame, key: str = "host") -> DataFrame:
    """log with `streak`: consecutive failures up to and with each row (0 at a success); gaps and islands."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    island = log.withColumn("_isle", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.withColumn("streak", F.when(F.col("ok"), 0).otherwise(F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy(key, "_isle").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))).cast("long")).drop("_isle")


def guarded_timeout(base_ms: int, streak: Column, threshold: int = 3, floor_ms: int = 500) -> Column:
    """Base halved once for each `threshold` failures in a row, ten times at most, not below the floor (smaller bases stay)."""
    halved = F.call_function("shiftright", F.lit(base_ms), F.least(F.floor(streak / threshold), F.lit(10)).cast("int"))
    return F.when(F.lit(base_ms) <= floor_ms, F.lit(base_ms)).otherwise(F.greatest(halved, F.lit(floor_ms))).cast("long")


def backoff_cap(attempt: Column, base_ms: int, max_ms: int) -> Column:
    """Upper end of the full-jitter interval: min(max, base * 2^attempt)."""
    return F.least(F.lit(max_ms).cast("double"), base_ms * F.pow(F.lit(2.0), attempt)).cast("long")


def win_pct(wins: Column, fires: Column) -> Column:
    """Hedges won in a hundred; 0 without any."""
    return F.when(fires == 0, 0).otherwise(F.floor(wins * 100 / F.nullif(fires, F.lit(0)))).cast("long")


def should_hedge(elapsed_ms: Column, samples: Column, ema: Column, threshold_pct: int = 150, least_samples: int = 10) -> Column:
    """After the warm-up: longer than the EMA times the threshold."""
    return (samples >= least_samples) & (elapsed_ms > F.floor(ema * threshold_pct / 100))


def hedge_delay(base_ms: Column, samples: Column, ema: Column, ema_sq: Column, streak: Column, fires: Column, wins: Column, least_samples: int = 10) -> Column:
    """EMA and deviation; half of it at three failures in a row; three quarters where more than half of five or more hedges won; never below the base."""
    delay = ema + F.floor(F.sqrt(F.greatest(F.lit(0), ema_sq - ema * ema).cast("double")))
    delay = F.when(streak >= 3, F.floor(delay / 2)).otherwise(delay)
    delay = F.when((fires >= 5) & (win_pct(wins, fires) > 50), F.floor(delay * 3 / 4)).otherwise(delay)
    return F.when(samples < least_samples, base_ms).otherwise(F.greatest(base_ms, delay)).cast("long")


def throttled_rate(retry_after_s: Column) -> Column:
    """Tokens a second after a Retry-After: one in that time, between 0.01 and 1."""
    return F.greatest(F.lit(0.01), F.lit(1.0) / F.greatest(F.lit(1.0), retry_after_s))
