"""Queries over URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import html, urls
from gleaner.functions.dialect import Duck, Spark
from gleaner.plans.registry import query
from gleaner.sources.tables import table

PARTS = {
    "root_url": lambda d: urls.root(d, "url"), "flipped": lambda d: urls.flip_scheme(d, "url"), "without_www": lambda d: urls.strip_www(d, "url"),
    "last_segment": lambda d: urls.last_segment(d, urls.path(d, "url")), "path_query": lambda d: urls.path_with_query(d, "url"), "authority": lambda d: urls.authority(d, "url"),
    "host": lambda d: urls.host(d, "url"), "url_path": lambda d: urls.path(d, "url"), "robots_path": lambda d: urls.robots_path(d, "url"), "crawlable": lambda d: urls.crawlable(d, "url"),
    "forced_https": lambda d: urls.force_https(d, "url"), "media": lambda d: urls.media_url(d, "url"), "domain_pattern": lambda d: urls.domain_pattern(d, "url"), "trie_path": lambda d: urls.trie_path(d, "url"),
}


def _select(d, parts: dict) -> str:
    return "page_id, " + ", ".join(f"{f(d)} AS {k}" for k, f in parts.items())


@query(f"SELECT {_select(Duck, PARTS)} FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *(F.expr(f(Spark)).alias(k) for k, f in PARTS.items()))


MORE = {
    "url_score": lambda d: urls.score(d, "url", urls.depth(d, "url")), "n_segments": lambda d: urls.depth(d, "url"),
    "key_plain": lambda d: urls.cache_key(d, "url"), "key_full": lambda d: urls.cache_key(d, "url", "'POST'", "'user'", "'n'"), "key_space": lambda d: urls.cache_key(d, "url", namespace="'n'"),
    "in_en": lambda d: urls.glob(d, "url", "*/en/*"), "exact": lambda d: urls.glob(d, "url", "https://example.com/"),
}


@query(f"SELECT {_select(Duck, MORE)} FROM pages")
def url_scores_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *(F.expr(f(Spark)).alias(k) for k, f in MORE.items()))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, href, kind, target): one row an anchor with an href, resolved against the page's root."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(urls.root(Spark, "url")).alias("root_url"), F.expr(urls.host(Spark, "url")).alias("host"), F.explode(F.expr(html.hrefs(Spark, "html"))).alias("href"))
    return p.select("page_id", "host", "href", F.expr(urls.href_class(Spark, "href")).alias("kind"), F.expr(urls.resolve(Spark, "root_url", "href")).alias("target"))


LINKS = f"SELECT page_id, host, href, {urls.href_class(Duck, 'href')} AS kind, {urls.resolve(Duck, 'root_url', 'href')} AS target FROM (SELECT page_id, {urls.root(Duck, 'url')} AS root_url, {urls.host(Duck, 'url')} AS host, unnest({html.hrefs(Duck, 'html')}) AS href FROM pages)"


@query(f"SELECT page_id, href, kind, target FROM ({LINKS})")
def links_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).drop("host")


@query(f"SELECT host, count(*) AS n_links, count(DISTINCT target) AS n_targets FROM ({LINKS}) GROUP BY host")
def link_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).groupBy("host").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("target").alias("n_targets"))


def _summary(d) -> str:
    text = html.visible(d, "html")
    return f"lower({urls.host(d, 'url')}) AS host, {html.tags(d, 'html', 'a ')} AS links, {urls.score(d, 'url', urls.depth(d, 'url'))} AS score, {text} AS text_bytes, {d.bytes('html')} AS html_bytes"


_HOSTS = "SELECT host, count(*) AS n_pages, CAST(sum(links) AS BIGINT) AS n_links, round(avg(score), 6) AS mean_score, CAST(sum(text_bytes) AS BIGINT) AS text_bytes, CAST(sum(CASE WHEN text_bytes < 200 OR text_bytes < 0.05 * html_bytes THEN 1 ELSE 0 END) AS BIGINT) AS thin_pages FROM ({0}) AS p GROUP BY host"


@query(_HOSTS.format(f"SELECT {_summary(Duck)} FROM pages"))
def host_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").selectExpr(*_split(_summary(Spark)))
    thin = (F.col("text_bytes") < 200) | (F.col("text_bytes") < 0.05 * F.col("html_bytes"))
    return p.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("links").cast("long").alias("n_links"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.sum("text_bytes").cast("long").alias("text_bytes"), F.sum(F.when(thin, 1).otherwise(0)).cast("long").alias("thin_pages"))


def _split(select: str) -> list[str]:
    """Items of a select list: splits at `, ` that follows an alias."""
    import re

    return [x for x in re.split(r"(?<= AS host), |(?<= AS links), |(?<= AS score), |(?<= AS text_bytes), ", select) if x]
