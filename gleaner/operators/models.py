"""Choice of models by cost tier and by score. A catalogue of models is small (a row a model)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIERS = ("low", "medium", "high")
BASE_MS = {"low": 500, "medium": 1500, "high": 3000}
STRATEGIES = ("quality", "cheapest", "context", "value")
UNKNOWN = 50.0


def latency(tier: Column, tokens: Column) -> Column:
    """Rough milliseconds of a call: by tier, and 50 for each whole hundred tokens."""
    base = F.when(tier == "low", BASE_MS["low"]).when(tier == "medium", BASE_MS["medium"]).otherwise(BASE_MS["high"])
    return base + F.floor(tokens / 100) * 50


def constrained(tier: Column, tokens: Column, most_tier: str = "high", most_ms: int | None = None, allow_large: bool = True) -> Column:
    """The tier under a policy: capped; one step lower where the latency is too long (and then nothing else applies); else no high one where large models aren't allowed."""
    capped = F.when(F.lit(most_tier == "low"), "low").when(F.lit(most_tier == "medium") & (tier == "high"), "medium").otherwise(tier)
    lower = F.when(capped == "high", "medium").otherwise("low")
    allowed = F.when((capped == "high") & F.lit(not allow_large), "medium").otherwise(capped)
    return allowed if most_ms is None else F.when(latency(capped, tokens) > most_ms, lower).otherwise(allowed)


def model_for(tier: Column, small: str, medium: str, large: str, allow_large: bool = True) -> Column:
    return F.when(tier == "low", small).when((tier == "high") & F.lit(allow_large), large).otherwise(medium)


def score(strategy: str, arena: Column, cost: Column, context: Column, own: Column | None = None) -> Column:
    """Score of a model (higher: better): the caller's own priority, else by the strategy; unknown figures are neutral."""
    quality = F.coalesce(arena, F.lit(UNKNOWN))
    priced = cost > 0
    by = {
        "quality": quality, "cheapest": F.when(priced, 1000.0 / F.nullif(cost, F.lit(0.0))).otherwise(UNKNOWN), "context": context / 1000.0,
        "value": quality * F.sqrt(F.when(priced, 100.0 / F.nullif(cost, F.lit(0.0))).otherwise(1.0)),
    }[strategy]
    return by if own is None else F.coalesce(own, by)


def meets(need: dict) -> Column:
    """Hard needs: capabilities, least context, highest cost (unknown: passes), least arena score (unknown: passes)."""
    ok = F.lit(True)
    for capability in ("vision", "audio", "video", "pdf"):
        if need.get(capability):
            ok = ok & F.col(capability)
    if need.get("least_context"):
        ok = ok & (F.coalesce("context", F.lit(0)) >= need["least_context"])
    if need.get("most_cost"):
        ok = ok & F.coalesce(F.col("cost") <= need["most_cost"], F.lit(True))
    if need.get("least_arena"):
        ok = ok & F.coalesce(F.col("arena") >= need["least_arena"], F.lit(True))
    return ok


def ranked(models: DataFrame, need: dict, strategy: str = "quality") -> DataFrame:
    """The models (place, name, arena, cost, context, capabilities) that meet the needs, with score and rank; ties to the one named first."""
    fit = models.filter(meets(need)).withColumn("score", score(strategy, F.col("arena"), F.col("cost"), F.col("context")))
    return fit.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "place")))


def selected(models: DataFrame, need: dict, strategy: str = "quality") -> DataFrame:
    """The best one; of a pool of two or fewer, the first that meets the needs."""
    if models.limit(3).count() <= 2:
        return models.filter(meets(need)).withColumn("score", score(strategy, F.col("arena"), F.col("cost"), F.col("context"))).orderBy("place").limit(1)
    return ranked(models, need, strategy).filter("rank = 1").drop("rank")


def selected_for_each(models: DataFrame, needs: list[dict], strategy: str = "quality") -> DataFrame:
    """(need, name, score): for each need in turn the best model that no earlier one took; a taken one where nothing else fits; null where none does."""
    spark, taken, out = models.sparkSession, [], []
    for k, need in enumerate(needs):
        best = ranked(models, need, strategy).filter(~F.col("name").isin(taken) if taken else F.lit(True)).orderBy("rank").select("name", "score").first()
        if best:
            taken.append(best["name"])
        else:
            best = selected(models, need, strategy).select("name", "score").first()
        out.append((k, best["name"] if best else None, best["score"] if best else None))
    return spark.createDataFrame(out, "need int, name string, score double")
