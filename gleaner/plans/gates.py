"""Queries of gates: scopes, caps, bodies, block pages, search results, headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import gates, html, urls
from gleaner.functions.dialect import Duck, Spark
from gleaner.plans.registry import query
from gleaner.sources.tables import table

OWN = ["Example.com", "docs.example.org", "shop.test"]


def _scopes(d, t: str) -> str:
    h = urls.host(d, "url")
    columns = {
        "small_enough": gates.within_bytes(d, "html", 5000), "own_domain": gates.external(d, h, OWN), "any_domain": gates.external(d, h, ["*"]), "name": gates.name_of(d, h),
        "base_only": gates.in_scope(d, h, "example.com", False, False), "with_subdomains": gates.in_scope(d, h, "example.com", True, False), "with_tlds": gates.in_scope(d, h, "example.com", False, True),
        "with_both": gates.in_scope(d, h, "example.com", True, True), "skipped": gates.skip_backend(d, "url", ["PHP", "x", "html"]), "selector_key": gates.normal_key("concat('  ', url, ' ')"),
    }
    return "SELECT page_id, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {t}"


@query(_scopes(Duck, "pages"))
def page_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page cap, external domains, subdomain and TLD scope, endings that no backend is asked for, selector keys."""
    return spark.sql(_scopes(Spark, "{pages}"), pages=table(spark, sf_dir, "pages"))


_BODIES = """SELECT doc_id, CASE lang WHEN 'fr' THEN concat(' ', '%PDF-1.7 ', text) WHEN 'es' THEN concat('  <?xml version="1.0"?>', text) WHEN 'de' THEN concat({begin}, {nl}, text) ELSE concat(text, {nl}, {end}) END AS body FROM {t} WHERE text IS NOT NULL"""


def _bodies(d, t: str) -> str:
    nl = "'\\n'" if d is Spark else "chr(10)"
    lines = lambda xs: "concat_ws(" + nl + ", " + ", ".join(f"'{x}'" for x in xs) + ")"
    inner = _BODIES.format(nl=nl, begin=lines(gates.SERVER_BEGINS), end=lines(gates.SERVER_ENDS), t=t)
    return f"SELECT doc_id, {d.bytes('body')} AS n_bytes, {gates.binary_body(d, 'body')} AS is_binary, {gates.xml_body(d, 'body')} AS is_xml, {gates.hard_forbidden(d, 'body')} AS forbidden FROM ({inner}) AS b"


@query(_bodies(Duck, "documents"))
def body_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, binary, XML and hard-forbidden flags of response bodies."""
    return spark.sql(_bodies(Spark, "{docs}"), docs=table(spark, sf_dir, "documents"))


def body_read(rows: DataFrame, body: str, declared: str) -> DataFrame:
    """rows (binary body, declared length) with what reading it tells: n_bytes, valid_utf8, truncated, and the text where it is valid."""
    b = F.col(body)
    valid = F.is_valid_utf8(b.cast("string"))
    return rows.withColumns({"n_bytes": F.octet_length(b).cast("long"), "valid_utf8": valid, "truncated": F.octet_length(b) < F.col(declared), "text_read": F.when(valid, b.cast("string"))})


@query("""SELECT doc_id, n + CASE lang WHEN 'de' THEN 1 ELSE 0 END AS n_bytes, coalesce(lang, '') <> 'de' AS valid_utf8, n + CASE lang WHEN 'de' THEN 1 ELSE 0 END < n + 1 AS truncated,
CASE WHEN coalesce(lang, '') <> 'de' THEN md5(text) END AS digest FROM (SELECT doc_id, lang, text, strlen(text) AS n FROM documents WHERE text IS NOT NULL)""")
def body_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as bytes: German ones end in half a character; all are declared one byte longer than their text."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    raw = d.select("doc_id", F.concat(F.col("text").cast("binary"), F.when(F.col("lang") == "de", F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit("")))).alias("body"), (F.octet_length("text") + 1).alias("declared"))
    r = body_read(raw, "body", "declared")
    return r.select("doc_id", "n_bytes", "valid_utf8", "truncated", F.md5(F.col("text_read").cast("binary")).alias("digest"))


_HEADS = "SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN concat(html, 'verify you are human') WHEN page_id % 5 = 1 THEN concat(html, 'our own gate') ELSE html END AS body, CASE WHEN page_id % 7 = 0 THEN 'challenges.cloudflare.com' ELSE 'x.test' END AS subject, {map} AS headers FROM {t}"


def _vendors(d, t: str) -> str:
    name = "CASE WHEN page_id % 11 = 0 THEN 'x-datadome' ELSE 'server' END"
    inner = _HEADS.format(map=f"map({name}, 'x')" if d is Spark else f"MAP([{name}], ['x'])", t=t)
    both = gates.vendor(d, "subject", "headers", "url", "body")
    if d is Spark:  # the vendor once
        return f"SELECT page_id, vendor, {gates.vendor_or_custom(d, 'vendor', 'url', 'body', ['/never/'], ['our own gate'])} AS vendor_or_custom FROM (SELECT *, {both} AS vendor FROM ({inner}) AS h) AS v"
    return f"SELECT page_id, {both} AS vendor, {gates.vendor_or_custom(d, both, 'url', 'body', ['/never/'], ['our own gate'])} AS vendor_or_custom FROM ({inner}) AS h"


@query(_vendors(Duck, "pages"))
def block_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor of a block page by TLS subject, headers, URL and body, and with the caller's own marks."""
    return spark.sql(_vendors(Spark, "{pages}"), pages=table(spark, sf_dir, "pages"))


@query("""WITH m AS (SELECT page_id, ['zz-proxied-server', 'content-type', 'content-type', 'x-note'] AS ks, ['a', 'text/html', 'text/plain', CASE WHEN page_id % 2 = 0 THEN 'tab' || chr(9) ELSE 'ok' END] AS vs FROM pages)
SELECT page_id, CAST(3 - page_id % 2 * 0 - (CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_headers, 'text/plain' AS content_type, 'a' AS proxied_server, CAST(2 - (CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_plain FROM m""")
def header_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header pairs to a map (last value of a name, visible ASCII alone), split by a proxy's prefix."""
    from gleaner.functions import records

    pairs = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in (("zz-proxied-server", F.lit("a")), ("content-type", F.lit("text/html")), ("content-type", F.lit("text/plain")), ("x-note", F.when(F.col("page_id") % 2 == 0, F.lit("tab\t")).otherwise("ok")))])
    m = table(spark, sf_dir, "pages").select("page_id", records.header_map(pairs).alias("h"))
    proxied, plain = records.split_headers(F.col("h"), "zz-proxied-")
    return m.select("page_id", F.size("h").cast("long").alias("n_headers"), F.try_element_at("h", F.lit("content-type")).alias("content_type"), F.try_element_at(proxied, F.lit("server")).alias("proxied_server"), F.size(plain).cast("long").alias("n_plain"))


@query("""WITH r AS (SELECT source, text, doc_id, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en' AND source NOT IN ('forum') AND lower(text) LIKE '%the%')
SELECT source, list_reduce(list_transform(list(doc_id ORDER BY rank), lambda x: 'https://d/' || x), lambda a, b: a || ' ' || b) AS urls FROM r WHERE rank <= 5 GROUP BY source""")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each source under search options (language, sites left out, a keyword, a limit), and their URLs as a list."""
    from gleaner.functions import records

    d = table(spark, sf_dir, "documents").select(F.col("source").alias("site"), "lang", "text", F.concat(F.lit("https://d/"), F.col("doc_id").cast("string")).alias("url"), F.col("n_chars").alias("score"), "doc_id")
    r = records.searched(d, language="en", without_sites=["forum"], keywords=["the"], limit=5, per="site", ties="doc_id")
    g = r.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("rank", "url"))).alias("results"))
    return g.select(F.col("site").alias("source"), F.array_join(records.result_urls(F.col("results")), " ").alias("urls"))


@query(f"SELECT url, length(html) AS n_chars, {html.title(Duck, 'html')} AS title FROM pages WHERE url = (SELECT min(url) FROM pages)")
def scraped_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page by its URL, in the asked form."""
    p = table(spark, sf_dir, "pages")
    first = p.agg(F.min("url").alias("u"))
    one = p.join(F.broadcast(first), F.col("url") == F.col("u"), "left_semi")
    return one.select("url", F.length("html").alias("n_chars"), F.expr(html.title(Spark, "html")).alias("title"))


def _bases(d, t: str) -> str:
    made = "CASE WHEN page_id % 3 = 0 THEN concat('<head><BASE target=x href=\"https://b.test/', CAST(page_id AS {s}), '/\"></head>', html) ELSE html END".format(s="string" if d is Spark else "VARCHAR")
    return f"SELECT page_id, {gates.base_href(d, 'h')} AS base FROM (SELECT page_id, {made} AS h FROM {t}) AS m"


@query(_bases(Duck, "pages"))
def base_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base element of a page, a third of which get one."""
    return spark.sql(_bases(Spark, "{pages}"), pages=table(spark, sf_dir, "pages"))


_KINDS = ["text/html", "text/xml; charset=x", "image/png", "application/json", "application/xhtml+xml", "font/woff"]


@query("SELECT page_id, page_id % 6 IN (0, 1, 4) AS crawled, page_id % 6 IN (2, 5) AS is_binary FROM pages")
def crawlable_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which content types are crawled for links, and which are binary."""
    from gleaner.functions import blocks

    ct = F.get(F.array(*map(F.lit, _KINDS)), (F.col("page_id") % len(_KINDS)).cast("int"))
    p = table(spark, sf_dir, "pages").select("page_id", ct.alias("ct"))
    return p.selectExpr("page_id", gates.crawlable_class(html.content_class(Spark, "ct")) + " AS crawled", blocks.binary_type(Spark, "ct") + " AS is_binary")
