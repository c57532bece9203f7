"""Queries of model choice, step acceptance and diff figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import html, urls
from gleaner.functions.dialect import Duck, Spark
from gleaner.operators import models, steps
from gleaner.plans.registry import query
from gleaner.sources.tables import table

_MODELS = """SELECT s_suppkey AS place, s_name AS name, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey * 37 % 101 AS DOUBLE) END AS arena, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN 0.0 ELSE CAST(s_suppkey % 40 AS DOUBLE) / 4 END AS cost,
CAST(8000 * (1 + s_suppkey % 6) AS INT) AS context, s_nationkey % 2 = 0 AS vision, s_nationkey % 3 = 0 AS audio FROM supplier"""
_SCORES = {
    "quality": "coalesce(arena, 50)", "cheapest": "CASE WHEN cost > 0 THEN 1000 / cost ELSE 50 END", "context": "context / 1000.0",
    "value": "coalesce(arena, 50) * sqrt(CASE WHEN cost > 0 THEN 100 / cost ELSE 1 END)",
}


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("place"), F.col("s_name").alias("name"), F.when(k % 9 != 0, (k * 37 % 101).cast("double")).alias("arena"), F.when(k % 7 == 0, None).when(k % 13 == 0, 0.0).otherwise((k % 40).cast("double") / 4).alias("cost"),
        (8000 * (1 + k % 6)).cast("int").alias("context"), (F.col("s_nationkey") % 2 == 0).alias("vision"), (F.col("s_nationkey") % 3 == 0).alias("audio"))


@query(f"WITH m AS ({_MODELS}) SELECT place, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _SCORES.items()) + ", vision AND context >= 24000 AND coalesce(cost <= 5, true) AND coalesce(arena >= 20, true) AS fits FROM m")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy's score of each model, and which meet hard needs (suppliers stand in for models)."""
    need = {"vision": True, "least_context": 24000, "most_cost": 5.0, "least_arena": 20.0}
    return catalogue(spark, sf_dir).select("place", *[F.round(models.score(s, F.col("arena"), F.col("cost"), F.col("context")), 6).alias(s) for s in models.STRATEGIES], models.meets(need).alias("fits"))


_Q = "coalesce(arena, 50)"


@query(f"""WITH m AS ({_MODELS}), a AS (SELECT name, {_Q} AS score FROM m WHERE vision ORDER BY score DESC, place LIMIT 1), b AS (SELECT name, {_Q} AS score FROM m WHERE vision AND name NOT IN (SELECT name FROM a) ORDER BY score DESC, place LIMIT 1),
c AS (SELECT name, {_Q} AS score FROM m WHERE audio AND context >= 16000 AND name NOT IN (SELECT name FROM a) AND name NOT IN (SELECT name FROM b) ORDER BY score DESC, place LIMIT 1)
SELECT CAST(0 AS INTEGER) AS need, name, score FROM a UNION ALL SELECT 1, name, score FROM b UNION ALL SELECT 2, name, score FROM c UNION ALL SELECT 3, NULL, NULL""")
def models_for_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each of several needs, none twice while another fits."""
    return models.selected_for_each(catalogue(spark, sf_dir), [{"vision": True}, {"vision": True}, {"audio": True, "least_context": 16000}, {"least_context": 1_000_000}])


@query("""WITH t AS (SELECT conv_id, turn, strlen(text) // 4 AS tokens, CASE WHEN strlen(text) // 4 < 60 THEN 'low' WHEN strlen(text) // 4 < 200 THEN 'medium' ELSE 'high' END AS tier FROM conversations WHERE text IS NOT NULL),
c AS (SELECT *, CASE WHEN tier = 'high' THEN 'medium' ELSE tier END AS capped FROM t), l AS (SELECT *, (CASE tier WHEN 'low' THEN 500 WHEN 'medium' THEN 1500 ELSE 3000 END) + tokens // 100 * 50 AS ms FROM c)
SELECT conv_id, turn, capped, CASE WHEN ms > 1550 THEN CASE tier WHEN 'high' THEN 'medium' ELSE 'low' END ELSE tier END AS fast, CASE tier WHEN 'low' THEN 's' WHEN 'medium' THEN 'm' ELSE 'l' END AS model, CASE tier WHEN 'low' THEN 's' ELSE 'm' END AS no_large FROM l""")
def tier_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost tier of each message under policies (a cap, a latency), and the model of a tier with and without large ones."""
    tokens = F.floor(F.octet_length("text") / 4)
    t = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", tokens.alias("tokens"), F.when(tokens < 60, "low").when(tokens < 200, "medium").otherwise("high").alias("tier"))
    tier, n = F.col("tier"), F.col("tokens")
    return t.select("conv_id", "turn", models.constrained(tier, n, "medium").alias("capped"), models.constrained(tier, n, most_ms=1550).alias("fast"), models.model_for(tier, "s", "m", "l").alias("model"), models.model_for(tier, "s", "m", "l", False).alias("no_large"))


@query("""WITH c AS (SELECT event_id, value / 100.0 AS confidence, event_id % 5 AS attempt, user_id % 3 AS n_alternatives FROM events)
SELECT event_id, confidence >= 0.8 AS confident, confidence >= greatest(0.2, 0.8 - 0.1 * attempt) AS accepted, n_alternatives > 0 AND attempt < 3 AS tries_others FROM c""")
def step_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident steps, steps accepted at an attempt, and where alternatives are tried."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100.0).alias("confidence"), (F.col("event_id") % 5).alias("attempt"), (F.col("user_id") % 3).alias("n"))
    c = F.col("confidence")
    return e.select("event_id", steps.confident(c).alias("confident"), steps.accepted(c, F.col("attempt")).alias("accepted"), steps.try_alternatives(F.col("n"), F.col("attempt")).alias("tries_others"))


_ROUNDS = "SELECT page_id, {host} AS host, {path} AS path, url, coalesce({title}, '') AS title, html FROM {t}"


def _diffs(d, t: str) -> str:
    return _ROUNDS.format(host=urls.host(d, "url"), path=urls.path(d, "url"), title=html.title(d, "html"), t=t)


@query(f"""WITH p AS ({_diffs(Duck, 'pages')}), b AS (SELECT *, lag(html) OVER w AS before, lag(url) OVER w AS url_before, lag(title) OVER w AS title_before FROM p WINDOW w AS (PARTITION BY host, path ORDER BY page_id)),
c AS (SELECT *, strlen(html) AS n, CASE WHEN before IS NULL THEN strlen(html) WHEN before = html THEN strlen('[No changes]' || chr(10) || url || chr(10) || title) ELSE strlen(html) // 2 END AS condensed, before IS NOT NULL AND (before <> html OR url <> url_before OR title <> title_before) AS changed FROM b)
SELECT host, count(*) AS rounds, CAST(sum(n) AS BIGINT) AS original_bytes, CAST(sum(condensed) AS BIGINT) AS condensed_bytes, round(1 - sum(condensed) / sum(n), 6) AS savings, CAST(greatest(0, sum(n) - sum(condensed)) AS BIGINT) AS bytes_saved, count(*) FILTER (changed) AS rounds_with_changes FROM c GROUP BY host""")
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over rounds of page diffs: bytes before and after condensing, savings, rounds with changes."""
    from pyspark.sql.window import Window

    p = spark.sql(_diffs(Spark, "{pages}"), pages=table(spark, sf_dir, "pages"))
    w = Window.partitionBy("host", "path").orderBy("page_id")
    b = p.withColumns({"before": F.md5(F.lag("html").over(w).cast("binary")), "now": F.md5(F.col("html").cast("binary")), "url_before": F.lag("url").over(w), "title_before": F.lag("title").over(w)})
    none = F.octet_length(F.concat_ws("\n", F.lit("[No changes]"), "url", "title"))
    n = F.octet_length("html")
    condensed = F.when(F.col("before").isNull(), n).when(F.col("before") == F.col("now"), none).otherwise(F.floor(n / 2))
    changed = F.col("before").isNotNull() & ((F.col("before") != F.col("now")) | (F.col("url") != F.col("url_before")) | (F.col("title") != F.col("title_before")))
    return steps.diff_totals(b.select("host", n.cast("long").alias("original"), condensed.cast("long").alias("condensed"), changed.alias("changed")), "host")
