"""Queries of frontier pushes, single links, evictions, recall by similarity, contexts and byte hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import records
from gleaner.operators import frontier, steps
from gleaner.plans.registry import query
from gleaner.sources.tables import table


@query("SELECT 'u' || user_id || '/' || event_type AS url, CAST(arg_min(event_id * 37 % 100, event_id) AS BIGINT) AS priority, min(event_id) AS seq FROM events GROUP BY 1")
def frontier_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs pushed again and again: the first insert stays, with its priority."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("url"), (F.col("event_id") * 37 % 100).alias("priority"), F.col("event_id").alias("seq"))
    return frontier.push(e)


@query("SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def unvisited_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that no visited set holds (parts of small size are visited)."""
    found = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"))
    return frontier.unvisited(found, table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("part")), "part")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n, count(*) OVER () // 8 AS out FROM events) WHERE n > out")
def evicted_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache without the eighth that was used longest ago (no two were used at once)."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("used_at"))
    return steps.evict_oldest(e).select("event_id")


_BAG = "SELECT doc_id AS id, regexp_extract_all(lower(text), '(\\w+)', 1) AS bag FROM documents WHERE text IS NOT NULL"
_RECALL = f"""WITH b AS ({_BAG}), w AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(bag) AS word FROM b) GROUP BY id, word),
s AS (SELECT id, coalesce(sum(n * CASE word WHEN 'the' THEN 2 WHEN 'of' THEN 1 ELSE 0 END) / (sqrt(sum(n * n)) * sqrt(5)), 0) AS relevance FROM w GROUP BY id),
k AS (SELECT id, relevance, row_number() OVER (ORDER BY relevance DESC, id) AS rank FROM s WHERE relevance >= 0.1 ORDER BY relevance DESC, id LIMIT 20) """


def _recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text")
    return records.recall(d, "The of the", 20, 0.1)


@query(_RECALL + "SELECT id, round(relevance, 9) AS relevance FROM k")
def recalled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records most like a text, by cosine of word counts."""
    return _recalled(spark, sf_dir).select("id", F.round("relevance", 9).alias("relevance"))


@query(_RECALL + ", e AS (SELECT rank, substr(text, 1, 50) AS t FROM k JOIN documents ON doc_id = id), c AS (SELECT *, sum(strlen(t) + 1) OVER (ORDER BY rank) AS total FROM e) SELECT md5(string_agg(t, chr(10) ORDER BY rank)) AS digest FROM c WHERE total <= 400")
def memory_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was recalled, cut and joined until a budget of bytes is spent."""
    from pyspark.sql.window import Window

    r = _recalled(spark, sf_dir).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("relevance"), "id")))  # 20 rows
    c = records.context_string(r.select("rank", F.substring("text", 1, 50).alias("text")), 400)
    return c.select(F.md5(F.col("context").cast("binary")).alias("digest"))


@query("""WITH b AS (SELECT doc_id, list_transform(string_split(md5(text), ''), lambda x: CAST(ascii(x) AS HUGEINT)) AS x FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), x), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS h FROM b)
SELECT doc_id, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash FROM h""")
def byte_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit FNV-1a, here of the texts' digests."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("d"))
    return records.fnv1a64(d, "d").select("doc_id", "hash")
