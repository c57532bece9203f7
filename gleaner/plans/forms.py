"""Queries of responses, lenient JSON, selectors, cleaning and text forms, each with SQL that finds the same by patterns or by how the input was made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import folds, htmltree, responses
from gleaner.functions.dialect import Duck, Spark
from gleaner.plans.fetches import LOG
from gleaner.plans.registry import query
from gleaner.sources.tables import fetch_log, table


@query("""SELECT conv_id, turn, text AS content, CASE WHEN turn % 3 = 1 THEN 'so ' || turn WHEN turn % 3 = 2 THEN 'thus' END AS thinking, strlen(text) AS prompt, turn AS completion,
CASE WHEN turn % 3 = 0 THEN 'find' WHEN turn % 3 = 1 THEN 'look' END AS tool, CASE WHEN turn % 3 = 0 THEN '{"n":' || turn || '}' WHEN turn % 3 = 1 THEN '{"m":' || turn || '}' END AS arguments FROM conversations WHERE text <> ''""")
def response_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content, thinking, usage and tool calls of responses in three layouts."""
    c = table(spark, sf_dir, "conversations").filter("text <> ''")
    t, n, size = F.col("text"), F.col("turn"), F.octet_length("text")
    args = lambda k: F.concat(F.lit(f'{{"{k}":'), n.cast("string"), F.lit("}"))
    choices = F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content"), F.array(F.struct(F.lit("t1").alias("id"), F.struct(F.lit("find").alias("name"), args("n").alias("arguments")).alias("function"))).alias("tool_calls")).alias("message"))).alias("choices"), F.struct(size.alias("prompt_tokens"), n.alias("completion_tokens")).alias("usage")))
    block = lambda kind, **more: F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in more.items()])
    no = F.lit(None).cast("string")
    blocks = F.to_json(F.struct(F.array(block("thinking", thinking=F.concat(F.lit("so "), n.cast("string")), text=no, name=no, input=no), block("text", thinking=no, text=t, name=no, input=no), block("tool_use", thinking=no, text=no, name=F.lit("look"), input=args("m"))).alias("content"), F.struct(size.alias("input_tokens"), n.alias("output_tokens")).alias("usage")))
    plain = F.to_json(F.struct(t.alias("output_text"), F.array(F.struct(F.struct(F.lit("thus").alias("reasoning_content")).alias("message"))).alias("choices"), F.struct(size.alias("prompt_tokens"), n.alias("output_tokens")).alias("usage")))
    r = c.select("conv_id", "turn", F.when(n % 3 == 0, choices).when(n % 3 == 1, blocks).otherwise(plain).alias("root"))
    root, calls = F.col("root"), responses.tool_calls(F.col("root"))
    return r.select("conv_id", "turn", responses.content(root).alias("content"), responses.thinking(root).alias("thinking"), responses.usage(root)["prompt"].alias("prompt"), responses.usage(root)["completion"].alias("completion"), F.get(calls, F.lit(0))["name"].alias("tool"), F.get(calls, F.lit(0))["arguments"].alias("arguments"))


@query("""SELECT event_id, '{"a": [1, 2], "k": ' || json_extract_string(props, '$.k') || '}' AS value, CASE WHEN event_id % 4 <> 1 THEN '{"k": ' || json_extract_string(props, '$.k') || ', "a": [1, 2]}' END AS last_object, '[1, 2]' AS last_array,
CASE event_id % 4 WHEN 1 THEN '{"k": ' || json_extract_string(props, '$.k') || ', "a": [1, 2]}' WHEN 0 THEN 'so: {"k": ' || json_extract_string(props, '$.k') || ', "a": [1, 2]} done'
 WHEN 2 THEN '{"k": ' || json_extract_string(props, '$.k') || ', "a": [1, 2]}' ELSE '```json' || chr(10) || '{"k": ' || json_extract_string(props, '$.k') || ', "a": [1, 2]}' || chr(10) || '```' END AS balanced,
CASE WHEN event_id % 4 = 3 THEN '{"k": ' || json_extract_string(props, '$.k') || ', "a": [1, 2]}' END AS code FROM events""")
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON out of texts around it, without its end, with braces too many, and in a fence."""
    body = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": [1, 2]'))
    kind = F.col("event_id") % 4
    text = F.when(kind == 1, body).when(kind == 0, F.concat(F.lit("so: "), body, F.lit("} done"))).when(kind == 2, F.concat(body, F.lit("}}]}"))).otherwise(F.concat(F.lit("```json\n"), body, F.lit("}\n```")))
    r = responses.repaired(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text")
    return r.select("event_id", "value", "last_object", "last_array", "balanced", responses.last_code_block(F.col("text")).alias("code"))


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 40 THEN text ELSE '...' || substr(text, length(text) - k + 1) END AS tail FROM (SELECT doc_id, text, (SELECT max(i) FROM range(0, 41) AS r(i) WHERE i <= length(text) AND strlen(substr(text, length(text) - CAST(i AS BIGINT) + 1)) <= 40) AS k FROM documents WHERE text IS NOT NULL)""")
def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 40 bytes of each text, on a character border."""
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", responses.tail(F.col("text"), 40).alias("tail"))


def _decoded(x: str) -> str:
    """The references that the pages use, decoded; & comes last."""
    for name, to in (("&copy;", "'©'"), ("&middot;", "'·'"), ("&quot;", "chr(34)"), ("&#x27;", "chr(39)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        x = f"replace({x}, '{name}', {to})"
    return x


_TEXT = "array_to_string(list_filter(list_transform(regexp_split_to_array({0}, '<[^>]*>'), lambda x: trim(" + _decoded("x") + ")), lambda x: x <> ''), ' ')"
_PARTS = f"""WITH a AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages)
SELECT page_id, 'title' AS name, [{_TEXT.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, {_TEXT.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}] AS texts FROM a
UNION ALL SELECT page_id, 'nav', list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1), lambda x: trim(x)) FROM a
UNION ALL SELECT page_id, 'ads', [{_TEXT.format("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")}] FROM a
UNION ALL SELECT page_id, 'paragraphs', list_filter(list_transform((string_split(body, '<p>'))[2:], lambda p: {_TEXT.format("string_split(p, '</p>')[1]")}), lambda x: x <> '') FROM a"""


@query(f"SELECT page_id, name, array_to_string(texts, chr(10)) AS texts FROM ({_PARTS})")
def selector_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that named CSS selectors find on each page, in page order."""
    found = htmltree.selected(table(spark, sf_dir, "pages"), {"title": ["title", "h1"], "paragraphs": ["article p"], "nav": ["nav a[href]"], "ads": ["div.ad"]})
    return found.select("page_id", "name", F.array_join("texts", "\n").alias("texts"))


_LINES = "regexp_split_to_array(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<![^>]*>', '', 'g'), '</?(?:html|head|body|title|nav|ul|li|div|article|h1|p|footer|br|meta)(?: [^>]*)?>')"


@query(f"SELECT page_id, array_to_string(list_filter(list_transform({_LINES}, lambda x: trim(regexp_replace({_decoded("regexp_replace(x, '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM pages")
def text_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text form of each page, a line a block."""
    return htmltree.transformed(table(spark, sf_dir, "pages"))


@query(LOG + """, x AS (SELECT host, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS n FROM f),
r AS (SELECT host, list_reduce(list({'t': CAST(t AS DOUBLE), 'tokens': 4.0::DOUBLE, 'wait': 0.0::DOUBLE, 'denied': 0::BIGINT} ORDER BY n), lambda a, b: CASE WHEN least(5.0, a.tokens + (b.t - a.t) / 1000.0 * 0.001) >= 1.0
 THEN {'t': b.t, 'tokens': least(5.0, a.tokens + (b.t - a.t) / 1000.0 * 0.001) - 1.0, 'wait': 0.0::DOUBLE, 'denied': a.denied}
 ELSE {'t': b.t, 'tokens': least(5.0, a.tokens + (b.t - a.t) / 1000.0 * 0.001), 'wait': (1.0 - least(5.0, a.tokens + (b.t - a.t) / 1000.0 * 0.001)) / 0.001 * 1000.0, 'denied': a.denied + 1} END) AS s FROM x GROUP BY host)
SELECT host, round(s.wait, 3) AS last_wait_ms, s.denied AS n_denied FROM r""")
def token_bucket_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wait of the last request of each host under a token bucket, and how many had to wait."""
    f = fetch_log(spark, sf_dir).groupBy("host").agg(folds.ordered(F.unix_millis("ts")).alias("t"))
    s = folds.token_bucket(F.col("t"), 0.001, 5)
    return f.select("host", s.alias("s")).select("host", F.round("s.wait", 3).alias("last_wait_ms"), F.col("s.denied").alias("n_denied"))


#: A page with every kind of element that a mode drops, around a text; and what each mode leaves.
_PIECES = ['<div id="x">', "<script>a</script>", "<style>b</style>", "<nav>n</nav>", "<svg>s</svg>", '<p class="ads">d</p>', '<p style="display:none">h</p>', "<canvas>c</canvas>", "<footer>f</footer>", '<p lang="en" data-k="1">', "{text}", "</p></div>"]
_LEFT = {"base": (3, 4, 7, 8), "base_words": (3, 4, 7, 8), "slim": (3, 8), "slim_agent": (3, 8), "full_crawler": (1, 2, 4, 5, 6, 7), "full_agent": (5, 6)}


def _kept(mode: str, text: str) -> list[str]:
    out = [p for i, p in enumerate(_PIECES) if i in (0, 9, 10, 11) or i in _LEFT[mode]]
    return [text if p == "{text}" else p.replace(' style="display:none"', "").replace(' lang="en"', "") if mode.startswith("full") else p for p in out]


def _concat(parts: list[str]) -> str:
    return "concat(" + ", ".join(p if p == "label" else "'" + p + "'" for p in parts) + ")"


@query("WITH t AS (SELECT doc_id, 'doc ' || doc_id || ' of ' || source AS label FROM documents) " + " UNION ALL ".join(f"SELECT doc_id AS page_id, '{m}' AS mode, md5({_concat(_kept(m, 'label'))}) AS digest FROM t" for m in _LEFT))
def cleaning_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cleaning mode leaves of a page with every kind of element."""
    label = F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(" of "), F.col("source"))
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.concat(*[label if p == "{text}" else F.lit(p) for p in _PIECES]).alias("html"))
    return htmltree.cleaned(pages).select("page_id", "mode", "digest")


_HREFS = "regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href=\"([^\"]*)\"', 1)"


@query(f"""SELECT page_id, 'heading' AS name, [{_TEXT.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}] AS texts FROM pages UNION ALL SELECT page_id, 'hrefs', list_transform({_HREFS}, lambda x: {_decoded('x')}) FROM pages
UNION ALL SELECT page_id, 'second', [{_HREFS}[2]] FROM pages UNION ALL SELECT page_id, 'ads', [{_TEXT.format("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")}] FROM pages UNION ALL SELECT page_id, 'charset', ['utf-8'] FROM pages""".replace("texts FROM", "texts FROM"))
def xpath_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What location paths select on each page."""
    paths = {"heading": "//article/h1", "hrefs": "//nav//a/@href", "second": "/html/body/nav/ul/li[2]/a/@href", "ads": "//div[@class='ad']", "charset": "//meta[@charset]/@charset"}
    return htmltree.xpath_selected(table(spark, sf_dir, "pages"), paths)


def _template(label: str, filler: str) -> str:
    """The page of _PIECES with a script of a size of its own, as SQL for either engine."""
    return "concat(" + ", ".join(label if p == "{text}" else f"concat('<script>', {filler}, '</script>')" if p == "<script>a</script>" else "'" + p + "'" for p in _PIECES) + ")"


_SMART = "SELECT doc_id AS page_id, url, {0} AS html FROM (SELECT doc_id, concat('https://h.test/', source) AS url, concat('doc ', source, repeat(' word', 40)) AS label, repeat('x', CAST(doc_id % 4 * 40 AS INT)) AS filler FROM {1}) AS d"


def _smart_oracle() -> str:
    from gleaner.plans import html as plans_html

    inner = _SMART.format(_template("label", "filler"), "documents")
    chosen = plans_html._PROFILES.format(plans_html._analysis(Duck, f"({inner}) AS p", False))
    left = {"slim": "slim_agent", "aggressive": "full_agent", "default": "base", "minimal": "base"}
    case = "CASE c.general " + " ".join(f"WHEN '{p}' THEN {_concat(_kept(m, 'label'))}" for p, m in left.items()) + " END"
    return f"SELECT d.doc_id AS page_id, c.general AS profile, md5({case}) AS digest FROM (SELECT doc_id, concat('doc ', source, repeat(' word', 40)) AS label FROM documents) AS d JOIN ({chosen}) AS c ON c.page_id = d.doc_id"


@query(_smart_oracle())
def smart_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cleaned by the profile that their own analysis chooses."""
    from gleaner.plans import html as plans_html

    d = table(spark, sf_dir, "documents")
    pages = spark.sql(_SMART.format(_template("label", "filler"), "{docs}"), docs=d)
    chosen = spark.sql(plans_html._PROFILES.format(plans_html._analysis(Spark, "{p}", False)), p=pages)
    both = pages.join(chosen.select("page_id", F.col("general").alias("profile")), "page_id")
    return htmltree.smart_cleaned(both).select("page_id", "profile", F.md5(F.col("cleaned").cast("binary")).alias("digest"))
