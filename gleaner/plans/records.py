"""Queries of records in arrays, excerpts, condensed diffs, hooks, snapshots, gates in one, and the crawl loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import blocks, records, urls
from gleaner.functions.dialect import Duck, Spark
from gleaner.operators import frontier, steps
from gleaner.plans.registry import query
from gleaner.sources import sinks
from gleaner.sources.tables import table

_ELEMENTS = """SELECT l_orderkey AS page, count(*) FILTER (l_returnflag <> 'A' AND l_linenumber % 2 = 1 AND l_suppkey % 4 < 2) AS clickable, count(*) FILTER (l_suppkey % 4 >= 2) AS inputs, count(*) FILTER (l_suppkey % 4 = 0) AS buttons,
count(*) FILTER (l_linestatus = 'F') AS required, count(*) FILTER (l_linestatus = 'F' AND l_partkey % 3 <> 0) AS required_empty, count(*) FILTER (l_returnflag = 'R') AS in_category, count(*) FILTER (l_partkey % 5 = 0) AS with_checkpoint, CAST(sum(l_linenumber) AS BIGINT) AS calls FROM lineitem GROUP BY l_orderkey"""


@query(_ELEMENTS)
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements, form fields, URLs, steps and tool counts of a page (the lines of an order stand in), taken by their kind."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.get(F.array(F.lit("button"), F.lit("link"), F.lit("input_text"), F.lit("textarea")), (F.col("l_suppkey") % 4).cast("int"))
    element = F.struct(kind.alias("type"), (F.col("l_returnflag") != "A").alias("visible"), (F.col("l_linenumber") % 2 == 1).alias("enabled"))
    field = F.struct((F.col("l_linestatus") == "F").alias("required"), F.when(F.col("l_partkey") % 3 == 0, "v").when(F.col("l_partkey") % 3 == 1, "").alias("value"))
    link = F.struct(F.when(F.col("l_returnflag") == "R", "External").otherwise("page").alias("category"))
    step = F.struct(F.when(F.col("l_partkey") % 5 == 0, F.lit("cp")).alias("checkpoint"))
    tool = F.struct(F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("name"), F.col("l_linenumber").cast("long").alias("n"))
    g = li.groupBy(F.col("l_orderkey").alias("page")).agg(*[F.collect_list(x).alias(n) for n, x in (("e", element), ("f", field), ("u", link), ("s", step), ("t", tool))])
    n = lambda x: F.size(x).cast("long")
    e, f = F.col("e"), F.col("f")
    return g.select(
        "page", n(records.clickable(e)).alias("clickable"), n(records.inputs(e)).alias("inputs"), n(records.of_type(e, "button")).alias("buttons"), n(records.required(f)).alias("required"), n(records.required(f, empty=True)).alias("required_empty"),
        n(records.in_category(F.col("u"), "external")).alias("in_category"), n(records.with_value(F.col("s"), "checkpoint")).alias("with_checkpoint"), records.map_total(F.map_from_entries("t")).alias("calls"))


@query("""WITH d AS (SELECT *, doc_id % 2 = 0 AS initial, (doc_id % 10) / 10.0 AS savings FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END) AS excerpt, md5(CASE WHEN strlen('<p>a</p><main>' || text) > 300 THEN '[excerpt]' || chr(10) || substr('<main>' || text, 1, 300) || chr(10) || '[end of excerpt]' ELSE '<p>a</p><main>' || text END) AS context,
md5('URL: u' || doc_id || chr(10) || 'TITLE: t' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'CHANGED:' || chr(10) || 'a' || chr(10) || 'b' ELSE '' END || CASE WHEN doc_id % 3 = 1 THEN chr(10) || 'NEW:' || chr(10) || 'c' ELSE '' END || CASE WHEN doc_id % 3 = 2 THEN chr(10) || 'REMOVED:' || chr(10) || 'd' ELSE '' END || chr(10) || 'UNCHANGED: 5') AS diff,
CASE WHEN initial OR savings < 0.5 THEN 'full' ELSE 'condensed' END AS chosen, strlen(text) > 10000 AND doc_id % 4 > 0 AS diffs_auto, doc_id % 4 > 0 AS diffs_always, false AS diffs_never,
CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 5 = 1 THEN 77 ELSE least(100, greatest(0, n_chars % 90 + (doc_id % 3 - 1) * 30)) END AS quality FROM d""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts, context windows, condensed diffs, when a diff is used, and validated scores."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    i, t = F.col("doc_id"), F.col("text")
    some = lambda k, *xs: F.when(i % 3 == k, F.array(*map(F.lit, xs))).otherwise(F.array().cast("array<string>"))
    diff = records.diff_text(F.concat(F.lit("u"), i.cast("string")), F.lit("t"), some(0, "b", "a"), some(1, "c"), some(2, "d"), F.lit(5))
    digest = lambda x: F.md5(x.cast("binary"))
    adjusted = records.validated(F.col("n_chars") % 90, i % 5 == 0, F.when(i % 5 == 1, 77), (i % 3 - 1) * 30)
    return d.select(
        "doc_id", digest(records.excerpt(t, 100)).alias("excerpt"), digest(records.context_window(F.concat(F.lit("<p>a</p><main>"), t), 300)).alias("context"), digest(diff).alias("diff"),
        records.diff_or_full(i % 2 == 0, (i % 10) / 10.0, 0.5, F.lit("full"), F.lit("condensed")).alias("chosen"), records.should_diff("auto", F.octet_length(t), i % 4).alias("diffs_auto"), records.should_diff("enabled", F.octet_length(t), i % 4).alias("diffs_always"),
        records.should_diff("disabled", F.octet_length(t), i % 4).alias("diffs_never"), adjusted.cast("long").alias("quality"))


@query("""SELECT round(avg(value / 100.0), 6) AS mean, min(value / 100.0) AS least, max(value / 100.0) AS most, count(*) FILTER (value / 100.0 < 0.3) AS n_low, round(avg(CASE WHEN value / 100.0 < 0.3 THEN 1 ELSE 0 END), 6) AS low_ratio FROM events""")
def confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, least, largest, count and share below a threshold of step confidences."""
    s = steps.stats(table(spark, sf_dir, "events").select((F.col("value") / 100.0).alias("confidence")), 0.3)
    return s.withColumns({"mean": F.round("mean", 6), "low_ratio": F.round("low_ratio", 6)})


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 4 <> 0 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20) AND (p_partkey // 4 = 0 OR p_partkey // 4 IN (SELECT p_partkey FROM part WHERE p_size < 20)) UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 4 = 0 AND p_size >= 20")
def ready_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that can run now: part k needs part k div 4 (unless k is divisible by 4); those of a small size are done."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    need = F.expr("id div 4")
    s = p.select("id", F.when((F.col("id") % 4 == 0) | (need == 0), F.expr("cast(array() as array<bigint>)")).otherwise(F.array(need)).alias("depends_on"))
    return steps.ready(s, p.filter("p_size < 20"))


@query("WITH l AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), e AS (SELECT max(ts) AS now FROM events) SELECT user_id, event_id FROM l, e WHERE n = 1 AND epoch_us(now) - epoch_us(ts) < 43200000000")
def fresh_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest snapshot of each host's rules that is younger than half a day at the end of the log (users stand in for hosts)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    now = e.agg(F.max("us")).first()[0]
    s = e.select("user_id", "event_id", F.struct("us", "event_id").alias("stamp"), "us", F.lit(43_200_000_000).alias("ttl"))
    last = s.groupBy("user_id").agg(F.max_by(F.struct("event_id", "us", "ttl"), "stamp").alias("r")).select("user_id", "r.*")
    return steps.latest_fresh(last, "user_id", "us", "ttl", F.lit(now)).select("user_id", "event_id")


_GATE = "CASE WHEN NOT {crawlable} THEN 'scheme' WHEN {media} THEN 'media' WHEN {denied} THEN 'denied' WHEN NOT {admitted} THEN 'not admitted' ELSE 'open' END"


def _gated(d, t: str) -> str:
    made = "CASE WHEN page_id % 9 = 0 THEN concat('ftp', substr(url, instr(url, ':'))) WHEN page_id % 9 = 1 THEN concat(url, '.png') ELSE url END"
    gate = _GATE.format(crawlable=urls.crawlable(d, "u"), media=urls.media_url(d, "u"), denied=d.has("u", "/de/|utm_"), admitted=d.has("u", "/en/|/es/"))
    return f"SELECT page_id, {gate} AS verdict FROM (SELECT page_id, {made} AS u FROM {t}) AS m"


@query(_gated(Duck, "pages"))
def url_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that stops a URL: scheme, media file, blacklist, whitelist."""
    return spark.sql(_gated(Spark, "{pages}"), pages=table(spark, sf_dir, "pages"))


@query("SELECT page_id, CASE WHEN regexp_matches(p, '[.][^/]*$') THEN p ELSE p || '.html' END AS path FROM (SELECT page_id, trim(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '/') AS p FROM pages WHERE url NOT LIKE '%/')")
def local_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe file paths of the pages' URLs."""
    p = table(spark, sf_dir, "pages").filter(~F.col("url").endswith("/"))
    return sinks.with_local_path(p.select("page_id", F.regexp_extract("url", "://[^/]*(/.*)", 1).alias("url_path")), "url_path").select("page_id", F.col("local_path").alias("path"))


@query(f"""WITH RECURSIVE l AS (SELECT 'https://h' || page_id % 7 || '.test/' || page_id AS src, 'https://h' || d % 7 || '.test/' || d AS url, d FROM (SELECT page_id, unnest([2 * page_id + 1, 2 * page_id + 2, page_id // 3]) AS d FROM pages) WHERE d <= (SELECT max(page_id) FROM pages)),
c AS (SELECT 'https://h1.test/1' AS url, 0 AS depth UNION SELECT l.url, c.depth + 1 FROM c JOIN l ON l.src = c.url WHERE c.depth < 5 AND l.d % 11 <> 0) SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY url""")
def crawl_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breadth-first crawl over links of pages, gated by a pattern of the URL, to depth 5."""
    p = table(spark, sf_dir, "pages").select("page_id")
    last = p.agg(F.max("page_id")).first()[0]
    k = F.col("page_id")
    made = lambda c: F.concat(F.lit("https://h"), (c % 7).cast("string"), F.lit(".test/"), c.cast("string"))
    d = p.select(made(k).alias("src"), F.explode(F.array(2 * k + 1, 2 * k + 2, F.expr("page_id div 3"))).alias("d")).filter(F.col("d") <= last)
    links = d.select("src", made(F.col("d")).alias("url"), "d")
    return frontier.crawl(spark.createDataFrame([("https://h1.test/1",)], "url string"), links, 5, gate=F.col("d") % 11 != 0)


@query("SELECT doc_id, source AS topic FROM documents WHERE strlen(text) / 1000.0 >= 0.5")
def relevant_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages at or above a floor of relevance."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic"), (F.octet_length("text") / 1000.0).alias("relevance"))
    return frontier.relevant(d, 0.5).select("doc_id", "topic")


@query("""SELECT event_id, CASE WHEN event_id % 4 >= 3 THEN NULL WHEN event_type = 'error' THEN CAST(least(500.0, 100 * 2 ** (event_id % 4)) AS BIGINT) END AS retry_ms, event_type = 'error' AS retryable FROM events""")
def retry_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delay before the next attempt, by a strategy of status and attempt; null: no more."""
    from gleaner.functions import folds

    a = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"), (F.col("event_id") % 4).alias("attempt"))
    r = records.retried(a, lambda status, n: F.when((n < 3) & blocks.retryable(status), folds.backoff_cap(n, 100, 500)))
    return r.select("event_id", "retry_ms", blocks.retryable(F.col("status")).alias("retryable"))


@query("SELECT page_id, md5(url || '!') AS url_digest FROM pages")
def custom_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own transport and link callback: only the round trip is replaced."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    hooked = records.on_links(p, lambda links: links.withColumn("url", F.concat("url", F.lit("!"))))
    got = records.fetched(hooked, lambda u: u.withColumn("html", F.md5(F.col("url").cast("binary"))), p)
    return got.select("page_id", F.col("html").alias("url_digest"))


@query("SELECT page_id, html IS NOT NULL AS found FROM pages WHERE lower(CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'APPLICATION/XHTML+XML' WHEN 2 THEN 'image/png' ELSE 'application/pdf' END) LIKE '%html%'")
def html_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses whose content type is HTML; the bodies of others aren't read."""
    from gleaner.functions import html

    ct = F.when(F.col("page_id") % 4 == 0, "text/html; charset=utf-8").when(F.col("page_id") % 4 == 1, "APPLICATION/XHTML+XML").when(F.col("page_id") % 4 == 2, "image/png").otherwise("application/pdf")
    p = table(spark, sf_dir, "pages").withColumn("ct", F.lower(ct))
    return p.filter(F.expr(f"{html.content_class(Spark, 'ct')} = 'Html'")).select("page_id", F.col("html").isNotNull().alias("found"))
