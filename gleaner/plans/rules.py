"""Queries of small rules: headers, races, rankings, reliabilities, step graphs, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import blocks, headers, records, robots
from gleaner.functions.dialect import Duck, Spark
from gleaner.operators import steps
from gleaner.plans.registry import query
from gleaner.sources import tables
from gleaner.sources.tables import table

_RAW = "SELECT page_id, concat('HTTP/1.1 ', CAST(200 + page_id % 320 AS VARCHAR(9)), {crlf}, 'Content-Type: text/html; charset=utf-8', {crlf}, 'content-length: ', CAST({n} AS VARCHAR(20))) AS raw, CASE WHEN page_id % 3 = 0 THEN 'cf-ray' WHEN page_id % 3 = 1 THEN 'zz-proxied-server' ELSE 'x-iinfo' END AS h FROM {t}"


def _headers(d, crlf: str, t: str) -> str:
    raw = _RAW.format(crlf=crlf, n=d.bytes("html"), t=t)
    tech = blocks.from_headers(d, "map(h, 'x')" if d is Spark else "MAP([h], ['x'])")
    inner = f"SELECT page_id, h, {headers.status(d, 'raw')} AS status, {headers.content_length(d, 'raw')} AS n_bytes, {headers.content_type(d, 'raw')} AS content_type FROM ({raw}) AS r"
    return f"SELECT page_id, status, n_bytes, content_type, {headers.status_class(d, 'status')} AS status_class, {headers.without_prefix(d, 'h')} AS unprefixed, {tech} AS vendor FROM ({inner}) AS q"


@query(_headers(Duck, "chr(13) || chr(10)", "pages"))
def header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_headers(Spark, "'\\r\\n'", "{pages}"), pages=table(spark, sf_dir, "pages"))


_RESPONSES = "SELECT user_id AS race, event_type AS backend, epoch_us(ts) // 1000 % 5000 AS arrived_ms, event_id % 101 AS score FROM events"


@query(f"""WITH r AS ({_RESPONSES}), f AS (SELECT race, min((arrived_ms, score, backend)) AS f FROM r GROUP BY race)
SELECT r.race, CASE WHEN f[2] >= 90 THEN f[3] ELSE arg_max(backend, (score, -arrived_ms, backend)) END AS winner FROM r JOIN f USING (race) WHERE arrived_ms <= f[1] + 500 GROUP BY r.race, f""".replace("f[2]", "struct_extract(f, 2)").replace("f[3]", "struct_extract(f, 3)").replace("f[1]", "struct_extract(f, 1)"))
def backend_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("race"), F.col("event_type").alias("backend"), (F.unix_millis(F.col("ts").cast("timestamp")) % 5000).alias("arrived_ms"), (F.col("event_id") % 101).alias("score"))
    return steps.best_response(e, "race", 90, 500)


@query("SELECT source, round(coalesce(sum(toxic) / nullif(count(*), 0), 0), 6) AS reliability, round(avg(quality), 6) AS mean, min(quality) AS least, max(quality) AS most, count(*) FILTER (quality < 1) AS n_low FROM labels JOIN documents USING (doc_id) GROUP BY source")
def reliabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    good, bad = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    return j.groupBy("source").agg(F.round(steps.reliability(good, bad), 6).alias("reliability"), F.round(F.avg("quality"), 6).alias("mean"), F.min("quality").alias("least"), F.max("quality").alias("most"), F.count_if(F.col("quality") < 1).alias("n_low"))


@query("SELECT id, CAST(level AS INTEGER) AS level FROM (WITH RECURSIVE l AS (SELECT p_partkey AS id, 0 AS level FROM part WHERE p_partkey % 4 = 0 OR p_partkey // 4 = 0 UNION ALL SELECT p_partkey, level + 1 FROM part JOIN l ON p_partkey // 4 = l.id WHERE p_partkey % 4 <> 0 AND p_partkey // 4 <> 0) SELECT * FROM l)")
def step_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a dependency graph: part k needs part k div 4, unless k is divisible by 4."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    need = F.expr("id div 4")
    free = (F.col("id") % 4 == 0) | (need == 0)
    return steps.levels(p.select("id", F.when(free, F.expr("cast(array() as array<bigint>)")).otherwise(F.array(need)).alias("depends_on")))


@query("SELECT s_name AS name, score FROM (SELECT s_name, round(s_acctbal - s_suppkey / 10.0, 6) AS score FROM supplier WHERE s_nationkey >= 5)")
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that meet a hard need, scored by quality against cost (suppliers stand in)."""
    m = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("quality"), F.col("s_suppkey").cast("double").alias("cost"), F.col("s_nationkey").alias("context"), F.lit(False).alias("vision"))
    return steps.rank_models(m, 5).select("name", F.round("score", 6).alias("score"))


@query("SELECT event_id, event_type IN ('click', 'view') AS kept, value * 1000 < 30000 AS fresh_strict, value * 1000 <= 30000 AS fresh_edge FROM events")
def cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-to-live tests with and without the edge, over event values as ages."""
    e = table(spark, sf_dir, "events").withColumns({"stored_at": -F.col("value") * 1000, "ttl": F.lit(30000.0)})
    strict, edge = (steps.is_fresh("stored_at", "ttl", F.lit(0.0), inclusive) for inclusive in (False, True))
    return e.select("event_id", F.col("event_type").isin("click", "view").alias("kept"), strict.alias("fresh_strict"), edge.alias("fresh_edge"))


@query("SELECT 'https://h' || a || '/p' || lpad(CAST(b AS VARCHAR), 2, '0') AS url FROM (VALUES ('x'), ('y')) AS t(a), range(1, 11, 3) AS r(b)")
def glob_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.table(spark, sf_dir, "region")
    return tables.seeds(spark, ["https://h{x,y}/p[01-10:3]"]).select("url")


@query("SELECT 'https://s.test/' || n_nationkey AS url FROM nation")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("<urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\"><url><loc>https://s.test/"), F.col("n_nationkey").cast("string"), F.lit("</loc></url></urlset>")).alias("xml"))
    return tables.sitemap(n)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 600 IN (401, 403) THEN 'none' WHEN o_orderkey % 600 BETWEEN 400 AND 499 THEN 'all' WHEN o_orderkey % 600 = 200 THEN 'rules' ELSE 'all' END AS access FROM orders")
def robots_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", robots.access(F.col("o_orderkey") % 600).alias("access"))


@query("SELECT c_mktsegment, CAST(approx AS BIGINT) AS n_nations, round(most, 2) AS most FROM (SELECT c_mktsegment, count(DISTINCT c_nationkey) AS approx, max(c_acctbal) AS most FROM customer GROUP BY c_mktsegment)")
def segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("n_nations"), F.round(F.max("c_acctbal"), 2).alias("most"))


@query("SELECT l_orderkey, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS n_flagged, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS best, arg_min(l_linenumber, l_linenumber) AS first FROM lineitem GROUP BY l_orderkey")
def order_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of alternatives (the lines of an order): flagged ones, the best, the first as given."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_returnflag") == "R").alias("flag"), F.col("l_quantity").alias("score")))).alias("xs"))
    x = F.col("xs")
    return rows.select("l_orderkey", F.size(records.flagged(x, "flag")).cast("long").alias("n_flagged"), F.get(records.by_score(x), F.lit(0))["l_linenumber"].alias("best"), records.first_alternative(x)["l_linenumber"].alias("first"))


@query("SELECT page_id, (url LIKE '%example%' AND NOT url LIKE 'http://%' ) OR instr(html, 'zzzz') > 0 AS holds FROM pages")
def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumns({"text": F.col("html"), "selectors": F.array(F.lit("a")), "ok": F.lit(True)})
    tree = {"any": [{"all": [{"url_has": "example"}, {"not": {"url_glob": "http://*"}}, {"selector": "a"}, {"previous": True}]}, {"text_has": "zzzz"}]}
    return p.select("page_id", records.condition(tree).alias("holds"))


@query("SELECT o_custkey, CAST(sum(1) AS BIGINT) AS calls, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 0 END) AS BIGINT) AS urgent, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n_tools FROM orders GROUP BY o_custkey")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage records merged: counts summed, maps of tool calls summed by tool."""
    u = table(spark, sf_dir, "orders").select("o_custkey", F.lit(1).alias("calls"), F.create_map("o_orderpriority", F.lit(2)).alias("tools"))
    m = records.merge_usage(u, "o_custkey", ["calls"], "tools")
    return m.select("o_custkey", "calls", F.coalesce(F.try_element_at("tools", F.lit("1-URGENT")), F.lit(0)).cast("long").alias("urgent"), F.size("tools").cast("long").alias("n_tools"))
