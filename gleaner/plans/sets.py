"""Queries of seeds and visited sets, spooled bodies, batches, links and one-pass features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import html, htmltree, jsonx
from gleaner.functions.dialect import Duck, Spark
from gleaner.operators import sets
from gleaner.plans.forms import _decoded
from gleaner.plans.registry import query
from gleaner.sources import sinks
from gleaner.sources.tables import materialise, shared_dir, table


@query("""WITH s AS (SELECT min(url) AS url FROM pages GROUP BY lower(url)) SELECT 'seeded' AS stage, count(*) AS n, min(url) AS least FROM s UNION ALL SELECT 'again', count(*), min(url) FROM s
UNION ALL SELECT 'with_more', count(*), min(url) FROM (SELECT url FROM s UNION SELECT url || '/more' FROM pages) UNION ALL SELECT 'without', count(*), min(url) FROM (SELECT url FROM s EXCEPT SELECT url FROM pages WHERE url LIKE 'http://%') UNION ALL SELECT 'cleared', 0, NULL""")
def seeded_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of URLs: seeded, added to without repeats in any case of letters, and emptied; and a visited set with more and fewer links."""
    import uuid

    path = f"{shared_dir(spark)}/urls-{uuid.uuid4().hex}"
    p = table(spark, sf_dir, "pages").select("url")
    sets.seed(p, path)
    one = lambda stage, d: d.agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("least")).select(F.lit(stage).alias("stage"), "n", "least").collect()[0]
    out = [one("seeded", spark.read.parquet(path))]
    sinks.append_unseen(p.select(F.upper("url").alias("url")), path)
    stored = spark.read.parquet(path)
    out += [one("again", stored), one("with_more", sets.insert(stored, p.select(F.concat("url", F.lit("/more")).alias("url")))), one("without", sets.remove(stored, p.filter(F.col("url").startswith("http://"))))]
    sets.clear(spark, path)
    out.append(one("cleared", spark.read.parquet(path)))
    return spark.createDataFrame(out, "stage string, n long, least string")


@query("SELECT doc_id, CAST((strlen(text) + 999) // 1000 AS BIGINT) AS n_chunks, md5(text) AS digest, true AS valid_utf8 FROM documents WHERE text <> ''")
def spooled_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies in chunks of 1,000 bytes, read back and joined; characters lie across borders."""
    d = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", "text")
    c = sets.chunks(d, "text", 1000)
    n = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return sets.joined_chunks(c, "doc_id").join(n, "doc_id").select("doc_id", "n_chunks", F.md5("body").alias("digest"), "valid_utf8")


def _lengths(texts: list) -> list[int]:
    return [len(t) for t in texts]


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def batched_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work on batches of values: rows whose work fails (here: null texts) are dropped, the others keep their own result."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sets.processed(d, "text", _lengths, 64, "n", "long").select("doc_id", "n")


_LINKS = [("/root/x", "https://h.test/root/x"), ("../up", "https://h.test/d/up"), ("../../../top", "https://h.test/top"), ("a/b", "https://h.test/d/s/a/b"), ("?q=1", "https://h.test/d/s/{0}?q=1"), ("#frag", "https://h.test/d/s/{0}#frag"), ("//cdn.test/y", "https://cdn.test/y"), ("https://o.test/z", "https://o.test/z"), ("./here", "https://h.test/d/s/here")]


@query("WITH p AS (SELECT page_id, 'p' || page_id AS name FROM pages) " + " UNION ALL ".join(f"SELECT page_id, CAST({k} AS BIGINT) AS place, CASE WHEN page_id % 4 = 0 AND {k} IN (3, 8) THEN 'https://b.test/base/{'a/b' if k == 3 else 'here'}' WHEN page_id % 4 = 0 AND {k} = 0 THEN 'https://b.test/root/x' WHEN page_id % 4 = 0 AND {k} IN (1, 2) THEN 'https://b.test/{'up' if k == 1 else 'top'}' WHEN page_id % 4 = 0 AND {k} = 4 THEN 'https://b.test/base/?q=1' WHEN page_id % 4 = 0 AND {k} = 5 THEN 'https://b.test/base/#frag' ELSE replace('{want}', '{{0}}', name) END AS link FROM p" for k, (_, want) in enumerate(_LINKS)))
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all kinds on each page, resolved against the page or, on every fourth, its base element."""
    made = "".join(f'<p><a class="x" href="{href}">t</a></p>' for href, _ in _LINKS) + '<a href="/file.pdf">f</a><a href="/h" aria-hidden="true">g</a><a name="n">n</a>'
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://h.test/d/s/p"), F.col("page_id").cast("string")).alias("url"), F.concat(F.when(F.col("page_id") % 4 == 0, '<base href="//b.test/base/">').otherwise(""), F.lit(made)).alias("html"))
    return htmltree.links(p).select("page_id", "place", "link")


@query(f"""SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=')) AS n_links, len(regexp_extract_all(html, '<img[ >]')) AS n_images, len(regexp_extract_all(html, '<h1[ >]')) AS n_headings, trim({_decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title, strlen(html) AS n_bytes FROM pages""")
def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one pass over each body gives."""
    return htmltree.features(table(spark, sf_dir, "pages"))


@query(f"SELECT page_id, CASE WHEN strlen(html) <= 4000 THEN {html.signature(Duck, 'html')} END AS signature FROM pages")
def capped_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of bodies up to a cap of bytes."""
    return table(spark, sf_dir, "pages").select("page_id", sets.capped_signature(F.expr(html.signature(Spark, "html")), F.col("html"), 4000).alias("signature"))


@query("""SELECT event_type, '{"properties": {"k": {"type": "integer"}, "t": {"oneOf": [{"type": "integer"}, {"type": "string"}]}, "u": {"type": "boolean"}}, "required": ["k", "t"], "type": "object"}' AS schema, CAST(0.95 AS DOUBLE) AS confidence, count(*) AS examples FROM events GROUP BY event_type""")
def refined_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of each event type's props: one for each shape, refined by one after another."""
    k, n = F.get_json_object("props", "$.k"), F.col("event_id")
    shape = F.concat(F.lit('{"k": '), k, F.when(n % 2 == 0, ', "t": 1').otherwise(', "t": "x"'), F.when(n % 3 == 0, ', "u": true}').otherwise("}"))
    e = table(spark, sf_dir, "events").select("event_type", shape.alias("props"))

    def shapes(batches):
        import pandas as pd

        for b in batches:
            got = pd.DataFrame({"event_type": b["event_type"], "schema": [jsonx.dumps(jsonx.infer_schema(jsonx.parse_lenient(p))) for p in b["props"]]})
            yield got.groupby(["event_type", "schema"], as_index=False).size().rename(columns={"size": "n"})

    def merge(b):
        import pandas as pd

        b = b.sort_values("schema")
        schema = jsonx.merge_schemas([jsonx.loads(s) for s in b["schema"]])
        for p in schema.get("properties", {}).values():
            if "oneOf" in p:
                p["oneOf"] = [jsonx.loads(x) for x in sorted({jsonx.dumps(x) for x in p["oneOf"]})]
        n = int(b["n"].sum())
        return pd.DataFrame([(b["event_type"].iloc[0], jsonx.dumps(schema), jsonx.refine({"schema": {}, "examples": n}, [])["confidence"], n)], columns=["event_type", "schema", "confidence", "examples"])

    each = e.mapInPandas(shapes, "event_type string, schema string, n long").groupBy("event_type", "schema").agg(F.sum("n").alias("n"))  # few shapes
    return each.groupBy("event_type").applyInPandas(merge, "event_type string, schema string, confidence double, examples long")


@query("SELECT doc_id, length(text) * 2 AS twice FROM documents")
def scripted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caller's own code on each row; null where it raises."""
    return sets.scripted(table(spark, sf_dir, "documents").select("doc_id", "text"), "result = len(text) * 2", "twice", "long").select("doc_id", "twice")


@query(f"""WITH s AS (SELECT {html.signature(Duck, 'html')} AS signature FROM pages WHERE NOT {html.empty_body(Duck, 'html')}) SELECT 'signatures' AS what, count(DISTINCT signature) AS n FROM s UNION ALL SELECT 'after_repeats', count(DISTINCT signature) FROM s UNION ALL SELECT 'json_rows', count(*) FROM pages
UNION ALL SELECT 'json_bytes', CAST(sum(strlen(html)) AS BIGINT) FROM pages""")
def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures stored if absent (cacheable bodies alone, twice over), and pages written as JSON lines and read back."""
    import uuid

    at = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    p = table(spark, sf_dir, "pages")
    made = p.filter(f"not {html.empty_body(Spark, 'html')}").select(F.expr(html.signature(Spark, "html")).alias("signature"))
    new = materialise(made).filter("signature is not null")  # made once, for both inserts and the filter
    out = []
    for what in ("signatures", "after_repeats"):
        sinks.append_unseen(new, f"{at}/signatures", "signature")
        out.append((what, spark.read.parquet(f"{at}/signatures").count()))
    sinks.write_json(p, f"{at}/json")
    back = spark.read.schema(p.schema).json(f"{at}/json").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("b")).first()
    return spark.createDataFrame([*out, ("json_rows", back["n"]), ("json_bytes", back["b"])], "what string, n long")
