"""Graphs of steps, rankings and small decision rules."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.sources.tables import materialise


def levels(steps: DataFrame, most: int = 1000) -> DataFrame:
    """(id, level) of steps (id, depends_on: array): 0 without needs, else one more than the highest need. Unknown ids and cycles raise."""
    edges = materialise(steps.select("id", F.explode("depends_on").alias("need")))
    if not edges.join(steps.select(F.col("id").alias("need")), "need", "left_anti").isEmpty():
        raise ValueError("a step needs an unknown step")
    left, done, k = steps.select("id"), None, 0
    while not left.isEmpty():
        waiting = edges.join(left.withColumnRenamed("id", "need"), "need", "left_semi").select("id").distinct()
        ready = materialise(left.join(waiting, "id", "left_anti").withColumn("level", F.lit(k)))
        if ready.isEmpty() or k > most:
            raise ValueError("the steps have a cycle")
        done = ready if done is None else done.unionByName(ready)
        left, k = materialise(left.join(ready, "id", "left_anti")), k + 1
    return done if done is not None else steps.select("id").withColumn("level", F.lit(0))


def threshold_for(attempt: Column, base: float = 0.8, decay: float = 0.1) -> Column:
    """Reckoned in decimals, so that 0.8 less 0.1 is 0.7 and a confidence of just that passes."""
    exact = lambda x: F.lit(Decimal(str(x)))
    return F.greatest(exact(0.2), exact(base) - exact(decay) * attempt.cast("decimal(19,0)")).cast("double")


def reliability(good: Column, bad: Column) -> Column:
    """Share of good ones; 0 without any."""
    return F.coalesce(F.try_divide(good, good + bad), F.lit(0.0))


#: A part of the rows of at most this many is looked at by one task.
FEW = 100_000


def evict_oldest(cache: DataFrame, stamp: str = "used_at", share: int = 8) -> DataFrame:
    """Without the oldest 1/share of the rows; of equal stamps at the cut just so many go as must (the least by a hash of the row).

    The place of the cut is closed in by approximate quantiles until FEW rows (or equal stamps) are left, so no task sorts them all.
    """
    from pyspark.sql.window import Window

    n = cache.count() // share
    if not n:
        return cache
    s, part, need = F.col("_s"), cache.select(F.col(stamp).cast("double").alias("_s")), n
    m = part.count()
    while m > FEW:
        low, high = part.approxQuantile("_s", [max(0.0, need / m - 0.01), min(1.0, need / m + 0.01)], 0.001)
        need -= part.filter(s < low).count()
        part = part.filter(s.between(low, high))
        if low == high:
            break
        m = part.count()
    at = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    few = part.groupBy("_s").agg(F.count(F.lit(1)).alias("_c")).withColumn("_to", F.sum("_c").over(at))
    cut = few.filter(F.col("_to") >= need).orderBy("_s").first()
    more = need - (cut["_to"] - cut["_c"])  # so many of the rows at the cut go
    place = F.col(stamp).cast("double")
    kept = cache.filter(place > cut["_s"])
    if more == cut["_c"]:
        return kept
    tied = cache.filter(place == cut["_s"]).withColumn("_rn", F.row_number().over(Window.orderBy(F.xxhash64(*cache.columns))))
    return kept.unionByName(tied.filter(F.col("_rn") > more).drop("_rn"))


def is_fresh(stamp: str, ttl: str, now: Column, inclusive: bool = False) -> Column:
    """Not older than its time to live: strictly (step caches), or with the edge (others)."""
    age = now - F.col(stamp)
    return age <= F.col(ttl) if inclusive else age < F.col(ttl)


def fresh(cache: DataFrame, stamp: str, ttl: str, now: Column, inclusive: bool = False) -> DataFrame:
    """The fresh rows."""
    return cache.filter(is_fresh(stamp, ttl, now, inclusive))


def best_response(responses: DataFrame, key: str, good_enough: int, grace_ms: int) -> DataFrame:
    """Winner of each race: the first response if its score is good enough, else the best by the deadline counted from the first."""
    first = responses.groupBy(key).agg(F.min(F.struct("arrived_ms", "score", "backend")).alias("f"))
    j = responses.join(first, key).filter(F.col("arrived_ms") <= F.col("f.arrived_ms") + grace_ms)
    best = j.groupBy(key, "f").agg(F.max_by("backend", F.struct("score", -F.col("arrived_ms"), "backend")).alias("b"))
    return best.select(key, F.when(F.col("f.score") >= good_enough, F.col("f.backend")).otherwise(F.col("b")).alias("winner"))


def rank_models(models: DataFrame, least_context: int, vision: bool = False) -> DataFrame:
    """Models that meet the hard needs, by quality less a tenth of the cost: a plain rule of this package. gleaner.operators.models has the strategies."""
    ok = (F.col("context") >= least_context) & (F.lit(not vision) | F.col("vision"))
    return models.filter(ok).withColumn("score", F.col("quality") - F.col("cost") / 10).orderBy(F.desc("score"), "name")


def stats(steps: DataFrame, least: float) -> DataFrame:
    """Mean, least, largest, count and share below a threshold of confidences; zeros without rows."""
    c = F.col("confidence")
    return steps.agg(F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"), F.coalesce(F.min(c), F.lit(0.0)).alias("least"), F.max(c).alias("most"), F.count_if(c < least).alias("n_low"), F.coalesce(F.avg((c < least).cast("int")), F.lit(0.0)).alias("low_ratio"))


def confident(confidence: Column, threshold: Column | float = 0.8) -> Column:
    return confidence >= threshold


def accepted(confidence: Column, attempt: Column, base: float = 0.8, decay: float = 0.1) -> Column:
    """Whether a step passes at an attempt, whose threshold falls from one to the next."""
    return confident(confidence, threshold_for(attempt, base, decay))


def try_alternatives(n_alternatives: Column, attempt: Column, use: bool = True, most: int = 3) -> Column:
    return F.lit(use) & (n_alternatives > 0) & (attempt < most)


def healing(results: DataFrame, key: str, issue: str) -> DataFrame:
    """Counts, success rate and one issue's count of healing results (success, attempts, issue, ts, event_id) by key.

    last_attempts: of the last result, if any up to it succeeded (the figure isn't a mean, as the original's isn't).
    """
    at = F.struct("ts", "event_id")
    g = results.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.count_if(F.col("issue") == issue).alias("n_errors"),
        F.max_by("attempts", at).alias("_last"))
    rate = F.coalesce(F.try_divide(F.col("successful"), F.col("total")), F.lit(0.0))
    return g.select("*", rate.alias("success_rate"), F.when(F.col("successful") > 0, F.col("_last")).otherwise(0).alias("last_attempts")).drop("_last")


def diff_totals(rounds: DataFrame, key: str) -> DataFrame:
    """Totals of diff rounds (original, condensed: bytes; changed) by key; a null condensed size counts as the original one."""
    condensed = F.sum(F.coalesce("condensed", "original"))
    g = rounds.groupBy(key).agg(F.count(F.lit(1)).alias("rounds"), F.sum("original").alias("original_bytes"), condensed.alias("condensed_bytes"), F.count_if("changed").alias("rounds_with_changes"))
    saved = F.col("original_bytes") - F.col("condensed_bytes")
    return g.select(key, "rounds", "original_bytes", "condensed_bytes", F.round(1 - F.col("condensed_bytes") / F.col("original_bytes"), 6).alias("savings"), F.greatest(F.lit(0), saved).alias("bytes_saved"), "rounds_with_changes")


def ready(steps: DataFrame, done: DataFrame) -> DataFrame:
    """Steps (id, depends_on) that aren't done and whose needs all are."""
    needs = steps.select("id", F.explode("depends_on").alias("need"))
    waiting = needs.join(done.select(F.col("id").alias("need")), "need", "left_anti").select("id").distinct()
    return steps.join(done.select("id"), "id", "left_anti").join(waiting, "id", "left_anti").select("id")


def latest_fresh(snapshots: DataFrame, key: str, stamp: str, ttl: str, now: Column) -> DataFrame:
    """The latest snapshot of each key, if it is still fresh (strictly)."""
    names = [c for c in snapshots.columns if c != key]
    last = snapshots.groupBy(key).agg(F.max_by(F.struct(*names), stamp).alias("_r")).select(key, "_r.*")
    return fresh(last, stamp, ttl, now)
