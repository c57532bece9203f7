"""Queries of robots.txt, from the text of the files to a verdict of each request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import robots, urls
from gleaner.functions.dialect import Duck, Spark
from gleaner.plans.registry import query
from gleaner.sources.tables import table

#: A file for each of four kinds of hosts: by the length of the host's name. Line by line, with comments, odd case and an escape.
FILES = [
    "# all\nUser-agent: *\nDisallow: /fr/\nDisallow: /%64e/*\nAllow: /\nCrawl-delay: 2.5\n",
    "User-Agent: GleanBot\nuser-agent: other\nALLOW: /en/1\nDisallow: /en/*\nRequest-rate: 3/20\n\nUser-agent: *\nDisallow: /\n",
    "Disallow: /lost/\nUser-agent: gleanbot\nCrawl-delay: 7\n\nUser-agent: *\nDisallow: /es/ # no\nCrawl-delay: 1\n",
    "",
]
#: The same as rules: file, agent ('*' or a name), line, rule, allow.
RULES = [(0, "*", 1, "/fr/", False), (0, "*", 2, "/de/*", False), (0, "*", 3, "/", True), (1, "gleanbot", 1, "/en/1", True), (1, "gleanbot", 2, "/en/*", False), (1, "*", 3, "/", False), (2, "*", 1, "/es/", False)]
OWN = {1: (None, 3, 20), 2: (7.0, None, None)}
DELAYS = {0: 2.5, 1: None, 2: 1.0}

_PAGES = "SELECT page_id, lower({host}) AS host, {path} AS path, CASE WHEN page_id % 2 = 0 THEN 'GleanBot/2.1' ELSE 'Stray/1' END AS agent FROM {t}"


def _pages(d, t: str) -> str:
    return _PAGES.format(host=urls.host(d, "url"), path=urls.path(d, "url"), t=t)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_pages(Spark, "{pages}"), pages=table(spark, sf_dir, "pages"))


def files(pages: DataFrame) -> DataFrame:
    """A robots.txt for each host."""
    kind = F.length("host") % len(FILES)
    text = F.get(F.array(*[F.lit(x) for x in FILES]), kind)
    return robots.parsed(pages.select("host").distinct().select("host", text.alias("text")))


_MATCH = "(rule IN ('*', '/') OR (rule LIKE '%*' AND starts_with(path, rtrim(rule, '*'))) OR (rule LIKE '%/' AND starts_with(path, rule)) OR path = rule)"
_BASE = f"""WITH p AS ({_pages(Duck, 'pages')}), q AS (SELECT *, length(host) % {len(FILES)} AS f, page_id % 2 = 0 AS bot FROM p),
r(f, agent, line, rule, allow) AS (VALUES {', '.join(f"({f}, '{a}', {n}, '{p}', {str(ok).lower()})" for f, a, n, p, ok in RULES)}),
own AS (SELECT page_id, arg_min(allow, line) AS allow FROM q JOIN r ON q.f = r.f AND r.agent = 'gleanbot' AND bot WHERE {_MATCH} GROUP BY page_id), star AS (SELECT page_id, arg_min(allow, line) AS allow FROM q JOIN r ON q.f = r.f AND r.agent = '*' WHERE {_MATCH} GROUP BY page_id) """


@query(_BASE + f"""SELECT page_id, CASE WHEN bot AND f IN (1, 2) THEN coalesce(own.allow, true) ELSE coalesce(star.allow, true) END AS allowed,
CASE WHEN bot AND f IN (1, 2) THEN CASE f {' '.join(f'WHEN {f} THEN CAST({d if d is not None else "NULL"} AS DOUBLE)' for f, (d, _, _) in OWN.items())} END ELSE CASE f {' '.join(f'WHEN {f} THEN CAST({d if d is not None else "NULL"} AS DOUBLE)' for f, d in DELAYS.items())} END END AS delay,
CASE WHEN bot AND f = 1 THEN CAST(3 AS BIGINT) END AS requests, CASE WHEN bot AND f = 1 THEN CAST(20 AS BIGINT) END AS seconds FROM q LEFT JOIN own USING (page_id) LEFT JOIN star USING (page_id)""")
def robots_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page under two agents' names against the parsed file of its host: verdict, crawl delay, request rate."""
    r = requests(spark, sf_dir)
    v = robots.verdicts(r, files(r))
    return v.select("page_id", "allowed", F.col("delay").alias("delay"), "requests", "seconds")


@query(_BASE + "SELECT page_id, CASE WHEN bot AND f IN (1, 2) AND coalesce(own.allow, true) THEN true ELSE coalesce(star.allow, true) END AS allowed FROM q LEFT JOIN own USING (page_id) LEFT JOIN star USING (page_id)")
def robots_fall_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the original: what an agent's own entry refuses is asked of the default entry."""
    r = requests(spark, sf_dir)
    return robots.verdicts(r, files(r), strict=False).select("page_id", "allowed")


@query(f"""WITH p AS ({_pages(Duck, 'pages')}), q AS (SELECT *, length(host) % {len(FILES)} AS f FROM p), r(f, rule) AS (VALUES {', '.join(f"({f}, '{p}')" for f, _, _, p, ok in RULES if not ok)})
SELECT page_id, NOT coalesce(bool_or(regexp_matches(path, rule)), false) AS allowed FROM q LEFT JOIN r USING (f) GROUP BY page_id""")
def robots_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern variant of the rules: Disallow paths as patterns, Allow lines ignored."""
    r = requests(spark, sf_dir)
    return robots.allowed_by_patterns(r, files(r)).select("page_id", "allowed")
