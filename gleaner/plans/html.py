"""Queries over the HTML of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import html, htmltree, records, urls
from gleaner.functions.dialect import Duck, Spark
from gleaner.plans.registry import query
from gleaner.sources.tables import table


def _analysis(d, source: str, full: bool) -> str:
    """All columns of a content analysis, in three nested steps (each expression once)."""
    s = html.sizes(d, "html", full)
    counts = f"{html.tags(d, 'html', 'iframe')} AS iframes, {html.tags(d, 'html', 'video')} AS videos, {html.tags(d, 'html', 'canvas')} AS canvases, {html.tags(d, 'html', 'embed', 'object')} AS embeds, {html.tags(d, 'html', 'svg')} AS svgs"
    one = f"SELECT page_id, {d.bytes('html')} AS html_bytes, {html.visible(d, 'html')} AS text_bytes, {counts}, {html.dynamic(d, 'html')} AS is_dynamic, {html.visual(d, 'html')} AS has_visual, {s['svg']} AS svg_bytes, {s['script']} AS script_bytes, {s['style']} AS style_bytes, {s['data']} AS data_bytes FROM {source}"
    two = f"SELECT *, svg_bytes + script_bytes + style_bytes + data_bytes AS cleanable_bytes, {html.ratio('text_bytes', 'html_bytes')} AS text_ratio, {html.ratio('(svg_bytes + script_bytes + style_bytes + data_bytes)', 'html_bytes')} AS cleanable_ratio FROM ({one}) AS a"
    three = f"SELECT *, {html.thin('text_bytes', 'text_ratio')} AS is_thin FROM ({two}) AS b"
    shot = "(is_thin OR has_visual OR (is_dynamic AND text_ratio < CAST(0.1 AS FLOAT))) AS wants_screenshot"
    marks = ["CASE WHEN is_thin THEN 'thin_content' END", "CASE WHEN has_visual THEN 'visual_elements' END", "CASE WHEN is_dynamic THEN 'dynamic_content' END"]
    saved = ", ".join(f"CAST({html.savings(d, p)} AS BIGINT) AS saved_{p}" for p in html.SAVINGS)
    return f"SELECT *, {shot}, {html.RECOMMENDED} AS recommended, concat_ws(',', {', '.join(marks)}) AS indicators, {saved} FROM ({three}) AS c"


def analysis(spark: SparkSession, sf_dir: str, full: bool) -> DataFrame:
    return spark.sql(_analysis(Spark, "{pages}", full), pages=table(spark, sf_dir, "pages"))


@query(_analysis(Duck, "pages", False))
def content_analysis_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir, False)


@query(_analysis(Duck, "pages", True))
def content_analysis_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir, True)


PROFILE = {
    "extraction": "case when svg_bytes > 100000 or data_bytes > 100000 or cleanable_ratio > 0.6 or svg_bytes > 50000 then 'slim' when script_bytes > 100000 or html_bytes > 100000 then 'aggressive' when cleanable_ratio > 0.4 or canvases > 0 or videos > 1 or embeds > 0 then 'slim' when text_ratio < 0.1 and html_bytes > 30000 then 'aggressive' else 'slim' end",
    "action": "case when svg_bytes > 100000 or data_bytes > 100000 or cleanable_ratio > 0.6 or svg_bytes > 50000 then 'slim' when cleanable_ratio > 0.4 or html_bytes > 150000 then 'default' else 'minimal' end",
    "general": "case when svg_bytes > 100000 or data_bytes > 100000 or cleanable_ratio > 0.6 or svg_bytes > 50000 or cleanable_ratio > 0.4 or canvases > 0 or videos > 2 then 'slim' when text_ratio < 0.05 and html_bytes > 50000 then 'aggressive' when embeds > 0 then 'slim' when (html_bytes > 100000 and text_ratio < 0.15) or html_bytes > 30000 then 'default' else 'minimal' end",
}
_PROFILES = "SELECT page_id, " + ", ".join(f"{v} AS {k}" for k, v in PROFILE.items()) + " FROM ({0}) AS x"


@query(_PROFILES.format(_analysis(Duck, "pages", False)))
def cleaning_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir, False).selectExpr("page_id", *(f"{v} AS {k}" for k, v in PROFILE.items()))


def _flags(d) -> dict[str, str]:
    return {
        "is_html": html.sniff(d, "html"), "is_empty": html.empty_body(d, "html"), "asks_screenshot": html.needs_screenshot(d, "html", html.visible(d, "html")),
        "score": html.quality(d, "html", "200", urls.media_url(d, "url"), "CAST(NULL AS VARCHAR(9))" if d is Duck else "cast(null as string)"),
        "title": html.title(d, "html"), "est_tokens": d.div(d.bytes("html"), "4") + " + 1", "article_bytes": d.bytes(html.tag_span(d, "html", "article")),
    }


@query("SELECT page_id, " + ", ".join(f"{v} AS {k}" for k, v in _flags(Duck).items()) + " FROM pages")
def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", *(f"{v} AS {k}" for k, v in _flags(Spark).items()))


@query(f"SELECT sig, count(*) AS n_pages, min(page_id) AS first_page FROM (SELECT page_id, {html.signature(Duck, 'html')} AS sig FROM pages) WHERE sig IS NOT NULL GROUP BY sig")
def signature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(html.signature(Spark, "html")).alias("sig"))
    return p.filter("sig is not null").groupBy("sig").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"))


SECTIONS, OPENS = ("article", "body", "footer", "form", "header", "main", "nav", "section"), {"a": "link", "button": "btn", "div": "div", "input": "input", "p": "para"}


def element_hashes(pages: DataFrame) -> DataFrame:
    """(page_id, path, hash): whole sections, and opening tags by number (the first 101 of a kind), as prefixes of tag names."""
    sections = F.array(*[F.struct(F.lit(t).alias("path"), F.expr(html.tag_span(Spark, "html", t)).alias("part")) for t in SECTIONS])
    kinds = [_numbered(t, k) for t, k in OPENS.items()]
    parts = pages.select("page_id", F.explode(F.concat(F.filter(sections, lambda x: x["part"] != ""), *kinds)).alias("e"))
    return parts.select("page_id", F.col("e.path").alias("path"), F.md5(F.col("e.part").cast("binary")).alias("hash"))


def _numbered(tag: str, kind: str):
    def one(x, i):
        return F.struct(F.concat(F.lit(kind + "_"), i.cast("string")).alias("path"), x.alias("part"))

    return F.transform(F.slice(F.expr(Spark.every("html", f"<{tag}[^>]*>")), 1, 101), one)


_ELEMENTS = " UNION ALL ".join(
    [f"SELECT page_id, '{t}' AS path, md5({html.tag_span(Duck, 'html', t)}) AS hash FROM pages WHERE {html.tag_span(Duck, 'html', t)} <> ''" for t in SECTIONS]
    + [f"SELECT page_id, '{k}_' || (i - 1) AS path, md5(x[i]) AS hash FROM (SELECT page_id, x, unnest(range(1, least(len(x), 101) + 1)) AS i FROM (SELECT page_id, {Duck.every('html', f'<{t}[^>]*>')} AS x FROM pages))" for t, k in OPENS.items()]
)


@query(_ELEMENTS)
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return element_hashes(table(spark, sf_dir, "pages"))


_DIFF = f"""WITH e AS ({_ELEMENTS}), r AS (SELECT page_id, lag(page_id) OVER (PARTITION BY {urls.host(Duck, 'url')} ORDER BY page_id) AS before FROM pages),
j AS (SELECT r.page_id, coalesce(n.path, o.path) AS path, o.hash AS old, n.hash AS new FROM (SELECT r.page_id, e.* EXCLUDE (page_id) FROM r JOIN e ON e.page_id = r.page_id WHERE before IS NOT NULL) AS n FULL JOIN (SELECT r.page_id, e.* EXCLUDE (page_id) FROM r JOIN e ON e.page_id = r.before) AS o ON n.page_id = o.page_id AND n.path = o.path JOIN r ON r.page_id = coalesce(n.page_id, o.page_id))
SELECT page_id, count(*) FILTER (old IS NULL) AS n_added, count(*) FILTER (new IS NULL) AS n_removed, count(*) FILTER (old <> new) AS n_changed, count(*) FILTER (old = new) AS n_same FROM j GROUP BY page_id"""


def element_changes(pages: DataFrame) -> DataFrame:
    """(page_id, path, old, new): the elements of each page and of the one before it of its host. Elements are hashed once and meet their predecessors in one window by host and path."""
    by_host = Window.partitionBy("host").orderBy("page_id")
    order = pages.select("page_id", F.expr(urls.host(Spark, "url")).alias("host")).select("page_id", "host", F.row_number().over(by_host).alias("no"), F.lead("page_id").over(by_host).alias("next"))
    w = Window.partitionBy("host", "path").orderBy("no")
    e = element_hashes(pages).join(order, "page_id")
    e = e.select("page_id", "path", "hash", "no", "next", F.lag(F.struct("no", "hash")).over(w).alias("was"), F.lead("no").over(w).alias("then"))
    now = e.filter("no > 1").select("page_id", "path", F.when(F.col("was.no") == F.col("no") - 1, F.col("was.hash")).alias("old"), F.col("hash").alias("new"))
    gone = e.filter(F.col("next").isNotNull() & ~F.col("then").eqNullSafe(F.col("no") + 1)).select(F.col("next").alias("page_id"), "path", F.col("hash").alias("old"), F.lit(None).cast("string").alias("new"))
    return now.unionByName(gone)


@query(_DIFF)
def page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page against the one before it of its host: elements added, removed, changed and unchanged."""
    j = element_changes(table(spark, sf_dir, "pages"))
    return j.groupBy("page_id").agg(
        F.count_if(F.col("old").isNull()).alias("n_added"), F.count_if(F.col("new").isNull()).alias("n_removed"),
        F.count_if(F.col("old") != F.col("new")).alias("n_changed"), F.count_if(F.col("old") == F.col("new")).alias("n_same"))


_LISTS = " || ".join(f"CASE WHEN len({c}) > 0 THEN chr(10) || '{name}:' || chr(10) || array_to_string({c}, chr(10)) ELSE '' END" for c, name in (("changed", "CHANGED"), ("added", "NEW"), ("removed", "REMOVED")))


@query(_DIFF[: _DIFF.rindex("SELECT page_id, count(*)")] + f""", l AS (SELECT page_id, coalesce(list(path ORDER BY path) FILTER (old <> new), []) AS changed, coalesce(list(path ORDER BY path) FILTER (old IS NULL), []) AS added, coalesce(list(path ORDER BY path) FILTER (new IS NULL), []) AS removed, count(*) FILTER (old = new) AS same FROM j GROUP BY page_id),
t AS (SELECT l.*, html, 'URL: ' || url || chr(10) || 'TITLE: ' || {html.title(Duck, 'html')} || {_LISTS} || chr(10) || 'UNCHANGED: ' || same AS text FROM l JOIN pages USING (page_id))
SELECT page_id, md5(text) AS digest, round(CASE WHEN len(changed) + len(added) + len(removed) = 0 THEN 0.95 ELSE 1 - strlen(text) / strlen(html) END, 6) AS savings, CASE WHEN CASE WHEN len(changed) + len(added) + len(removed) = 0 THEN 0.95 ELSE 1 - strlen(text) / strlen(html) END < 0.5 THEN 'full' ELSE 'condensed' END AS sent FROM t""")
def page_diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condensed text of each page's diff, what it saves, and whether it or the page is sent on. Lists of paths have at most 8 + 5 x 101 elements a page."""
    pages = table(spark, sf_dir, "pages")
    paths = lambda test: F.collect_list(F.when(test, F.col("path")))
    old, new = F.col("old"), F.col("new")
    g = element_changes(pages).groupBy("page_id").agg(paths(old != new).alias("changed"), paths(old.isNull()).alias("added"), paths(new.isNull()).alias("removed"), F.count_if(old == new).alias("same"))
    t = g.join(pages.select("page_id", "url", F.expr(html.title(Spark, "html")).alias("title"), F.octet_length("html").alias("n")), "page_id")
    t = t.withColumn("text", records.diff_text(F.col("url"), F.col("title"), F.col("changed"), F.col("added"), F.col("removed"), F.col("same")))
    saved = records.savings(F.size("changed") + F.size("added") + F.size("removed"), F.octet_length("text"), F.col("n"))
    return t.select("page_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.round(saved, 6).alias("savings"), records.diff_or_full(F.lit(False), saved, 0.5, F.lit("full"), F.lit("condensed")).alias("sent"))


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def text_exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query(f"SELECT title, count(*) AS n_pages FROM (SELECT {html.title(Duck, 'html')} AS title FROM pages) GROUP BY title HAVING count(*) > 1")
def title_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.expr(html.title(Spark, "html")).alias("title")).agg(F.count(F.lit(1)).alias("n_pages")).filter("n_pages > 1")


@query()
def clean_html_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page cleaned by every mode: bytes and digest of what stays."""
    return htmltree.cleaned(table(spark, sf_dir, "pages"))


@query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown form of each page; the text form is forms.text_form."""
    return htmltree.transformed(table(spark, sf_dir, "pages"), markdown=True)
