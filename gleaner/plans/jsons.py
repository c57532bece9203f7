"""Queries over JSON, prompts and conversations."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import jsonx
from gleaner.functions.dialect import Duck, Spark
from gleaner.plans.registry import query
from gleaner.sources.tables import table

_TOKENS = "sum({0} + 1 + 4)"


@query(f"SELECT conv_id, CAST({_TOKENS.format(Duck.div(Duck.bytes('text'), '4'))} AS BIGINT) AS tokens, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.expr(_TOKENS.format(Spark.div(Spark.bytes("text"), "4"))).cast("long").alias("tokens"), F.count(F.lit(1)).alias("n_turns"))


_FLAGS = ", ".join(f"{{{k}}} AS {k}" for k in jsonx.FLAGS)


def _complexity(d) -> str:
    flags = {k: jsonx.flag(d, "text", k) for k in jsonx.FLAGS}
    tokens = d.div(d.bytes("text"), "4") + " + 1"
    inner = f"SELECT conv_id, turn, {tokens} AS tokens, " + _FLAGS.format(**flags) + " FROM {0}"
    score = "CASE WHEN tokens > 2000 THEN 3 WHEN tokens > 500 THEN 2 ELSE 1 END + CASE WHEN reasoning THEN 2 ELSE 0 END + CASE WHEN code THEN 2 ELSE 0 END + CASE WHEN structured THEN 1 ELSE 0 END + CASE WHEN steps THEN 1 ELSE 0 END"
    tiers = f"SELECT *, CASE WHEN {score} <= 2 THEN 'low' WHEN {score} <= 5 THEN 'medium' ELSE 'high' END AS tier FROM ({inner}) AS a"
    return f"SELECT *, CAST(CASE tier WHEN 'low' THEN 500 WHEN 'medium' THEN 1500 ELSE 3000 END + {d.div('tokens', '100')} * 50 AS BIGINT) AS latency_ms FROM ({tiers}) AS b"


@query(_complexity(Duck).format("conversations"))
def task_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_complexity(Spark).format("{conv}"), conv=table(spark, sf_dir, "conversations"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(json_extract_string(props, '$.k')) AS n_with_key FROM events GROUP BY event_type")
def props_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k.try_cast("bigint")).alias("total"), F.count(k).alias("n_with_key"))


@query("SELECT conv_id, turn, rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank <= 3")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations").withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).cast("long"))
    return c.filter("rank <= 3").select("conv_id", "turn", "rank")


@query()
def json_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON Schema of each event type's props: schemas of the distinct shapes, merged."""
    e = table(spark, sf_dir, "events")

    def one(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"event_type": b["event_type"], "schema": [jsonx.dumps(jsonx.infer_schema(jsonx.parse_lenient(p or ""))) for p in b["props"]]})

    shapes = e.select("event_type", "props").mapInPandas(one, "event_type string, schema string").distinct()

    def merge(b):
        import pandas as pd

        return pd.DataFrame([(b["event_type"].iloc[0], jsonx.dumps(jsonx.merge_schemas([jsonx.loads(s) for s in sorted(b["schema"])])), len(b))], columns=["event_type", "schema", "n_shapes"])

    return shapes.groupBy("event_type").applyInPandas(merge, "event_type string, schema string, n_shapes long")
