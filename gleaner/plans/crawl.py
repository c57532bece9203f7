"""Queries of crawl rules, frontier, visited sets, budgets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import html, robots, urls
from gleaner.functions.dialect import Duck, Spark
from gleaner.operators import frontier
from gleaner.plans.registry import query
from gleaner.sources.tables import table

_SCORED = "SELECT page_id, url, lower({host}) AS host, {score} AS priority, {path} AS path FROM {{0}}"


def _scored(d) -> str:
    return _SCORED.format(host=urls.host(d, "url"), score=urls.score(d, "url", urls.depth(d, "url")), path=urls.path(d, "url"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_scored(Spark).format("{pages}"), pages=table(spark, sf_dir, "pages"))


S = f"WITH s AS ({_scored(Duck).format('pages')}) "


@query(S + "SELECT page_id, url, priority FROM s ORDER BY priority DESC, url DESC LIMIT 100")
def frontier_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.top(scored(spark, sf_dir), 100).select("page_id", "url", "priority")


@query(S + "SELECT page_id, host FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority DESC, url DESC) AS rn FROM s) WHERE rn <= 2")
def budget_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.budget(scored(spark, sf_dir), F.col("host"), 2, [F.desc("priority"), F.desc("url")]).select("page_id", "host")


DENY = r"(/de/|[?]utm_|example[.]org)"


@query(f"SELECT page_id, {Duck.has('url', DENY)} AS denied, {Duck.has('url', '^https://')} AS admitted FROM pages WHERE NOT ({Duck.has('url', '/es/')})")
def allow_and_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter(~F.expr(Spark.has("url", "/es/"))).selectExpr("page_id", Spark.has("url", DENY) + " AS denied", Spark.has("url", "^https://") + " AS admitted")


RULES = [("*", 1, "/fr/1", True), ("*", 2, "/fr/*", False), ("*", 3, "/de/", False), ("*", 4, "/en", False)]
_MATCH = "(rule IN ('*', '/') OR (rule LIKE '%*' AND starts_with(path, rtrim(rule, '*'))) OR (rule LIKE '%/' AND starts_with(path, rule)) OR path = rule)"


@query(S + f", r(line, rule, allow) AS (VALUES {', '.join(f'({n}, {p!r}, {str(a).lower()})' for _, n, p, a in RULES)}) SELECT page_id, coalesce(arg_min(allow, line) FILTER ({_MATCH}), true) AS allowed FROM s, r GROUP BY page_id")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page against the rules of its host (here all hosts have the same few): first matching line."""
    pages = scored(spark, sf_dir).select("page_id", "host", "path")
    hosts = pages.select(F.col("host").alias("rule_host")).distinct()
    rules = hosts.select("rule_host", F.inline(F.array(*[F.struct(F.lit(n).alias("line"), F.lit(p).alias("rule"), F.lit(a).alias("allow")) for _, n, p, a in RULES])))
    return robots.allowed(pages, rules).select("page_id", "allowed")


def _signed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sig) of all documents, and the signatures of the labelled ones."""
    d = table(spark, sf_dir, "documents").withColumn("sig", F.md5(F.col("text").cast("binary"))).select("doc_id", "sig")
    return d, d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("sig").distinct()


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)")
def visited_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text isn't among those already seen (the labelled ones), by digest."""
    d, seen = _signed(spark, sf_dir)
    return d.filter("sig is not null").join(seen, "sig", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents JOIN labels USING (doc_id))")
def visited_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is among those already seen."""
    d, seen = _signed(spark, sf_dir)
    return d.join(seen, "sig", "left_semi").select("doc_id")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
b AS (SELECT 's1' AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 4)
SELECT node, min(depth) AS depth FROM b GROUP BY node""")
def link_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first expansion to depth 4 on a graph of suppliers and parts."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p")).distinct()
    edges = li.select(F.col("s").alias("src"), F.col("p").alias("dst")).unionByName(li.select(F.col("p").alias("src"), F.col("s").alias("dst")))
    return frontier.expand(edges, spark.createDataFrame([("s1",)], "node string"), 4)


_REL = "strlen(text)"


@query("""WITH r AS (SELECT doc_id AS page_id, source AS topic, text, row_number() OVER (PARTITION BY source ORDER BY strlen(text) DESC, doc_id) AS rank FROM documents),
k AS (SELECT *, least(4000 // count(*) OVER (PARTITION BY topic), 500) AS share FROM r WHERE rank <= 10) SELECT page_id, rank, share, strlen(substr(text, 1, CAST(share * 4 AS INT))) AS n_bytes FROM k""")
def fit_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("topic"), "text", F.octet_length("text").alias("relevance"))
    return frontier.fit_to_budget(d, 10, 4000, 500).select("page_id", F.col("rank").cast("long").alias("rank"), "share", F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT lang, source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY CUBE (lang, source)")
def corpus_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query(f"SELECT page_id, running <= 200000 AS kept FROM (SELECT page_id, sum({Duck.bytes('html')}) OVER (PARTITION BY {urls.host(Duck, 'url')} ORDER BY page_id) AS running FROM pages) WHERE running - 0 > 0")
def byte_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages until a host's bytes are spent."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(F.expr(urls.host(Spark, "url"))).orderBy("page_id")
    return table(spark, sf_dir, "pages").select("page_id", (F.sum(F.octet_length("html")).over(w) <= 200000).alias("kept"))


@query(f"SELECT DISTINCT {urls.trie_path(Duck, 'url')} AS node, arg_max(page_id, page_id) OVER (PARTITION BY {urls.trie_path(Duck, 'url')}) AS value FROM pages")
def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by place in the path tree; the last write wins."""
    return table(spark, sf_dir, "pages").groupBy(F.expr(urls.trie_path(Spark, "url")).alias("node")).agg(F.max("page_id").alias("value"))


_CRLF = "chr(13) || chr(10)"


@query(f"""WITH k AS (SELECT page_id, url, html, 1700000000 + page_id AS epoch, CASE WHEN {Duck.has('html', '^[ ]*<')} THEN 'text/html' ELSE 'text/plain' END AS kind FROM pages WHERE url <> ''),
b AS (SELECT *, concat('HTTP/1.1 200', {_CRLF}, 'Content-Type: ', kind, {_CRLF}, 'Content-Length: ', strlen(html), {_CRLF}, {_CRLF}, html) AS block, md5(url || '|' || epoch) AS h FROM k),
r AS (SELECT page_id, kind, strlen(html) AS n_bytes, concat('WARC/1.0', {_CRLF}, 'WARC-Type: response', {_CRLF}, 'WARC-Target-URI: ', url, {_CRLF}, 'WARC-Date: ', strftime(make_timestamp(epoch * 1000000), '%Y-%m-%dT%H:%M:%SZ'), {_CRLF},
 'WARC-Record-ID: <urn:uuid:', substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12), '>', {_CRLF}, 'Content-Type: application/http; msgtype=response', {_CRLF}, 'Content-Length: ', strlen(block), {_CRLF}, {_CRLF}, block, {_CRLF}, {_CRLF}) AS record FROM b)
SELECT page_id, split_part(record, {_CRLF}, 1) AS version, n_bytes, kind, md5(record) AS record_md5 FROM r""")
def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.sources import sinks

    p = table(spark, sf_dir, "pages").filter("url <> ''").select("page_id", sinks.warc_record(F.col("url"), F.lit(200), F.col("html"), 1_700_000_000 + F.col("page_id")).alias("record"), "html")
    return p.select("page_id", F.substring_index("record", "\r\n", 1).alias("version"), F.octet_length("html").cast("long").alias("n_bytes"), sinks.content_type(F.col("html")).alias("kind"), F.md5(F.col("record").cast("binary")).alias("record_md5"))


@query(f"SELECT h AS host, count(*) AS n FROM (SELECT {urls.host(Duck, 'url')} AS h, {html.empty_body(Duck, 'html')} AS e FROM pages) WHERE NOT e GROUP BY h HAVING count(*) >= 2")
def cacheable_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").filter(f"not {html.empty_body(Spark, 'html')}")
    return p.groupBy(F.expr(urls.host(Spark, "url")).alias("host")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
