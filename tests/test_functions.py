"""Literal cases of the URL, HTML, robots, JSON, header and sink functions."""

from hashlib import md5

import pytest
from pyspark.sql import functions as F

from gleaner.functions import blocks, headers, html, htmltree, jsonx, robots, urls
from gleaner.functions.dialect import Spark, column
from gleaner.plans import gates as plans_gates
from gleaner.sources import sinks, tables


def one(spark, make, value, *args):
    return spark.createDataFrame([(value,)], "v string").select(F.expr(make(Spark, "v", *args)).alias("x")).first()[0]


@pytest.mark.parametrize(("make", "value", "want"), [
    (urls.flip_scheme, "http://a/b", "https://a/b"), (urls.flip_scheme, "ftp://a", None), (urls.strip_www, "https://www.docs.x/foo", "https://docs.x/foo"), (urls.strip_www, "https://x/", None),
    (urls.force_https, "ftp://a/b", "https://a/b"), (urls.force_https, "a/b", "https://a/b"), (urls.last_segment, "/a/b", "b"), (urls.last_segment, "/a/", ""), (urls.last_segment, "a", "a"),
    (urls.media_url, "https://x/foo.JPG", True), (urls.media_url, "https://x/index.html", False), (urls.media_url, "https://x", False), (urls.media_url, "https://x/a.mp4?t=1", True),
    (urls.root, "https://x.y:8/a?b#c", "https://x.y:8/"), (urls.root, "nothing", None), (urls.path, "https://x/a#b?c", "/a#b"), (urls.path, "https://x", "/"), (urls.path, "https://x/a#b", "/a"),
    (urls.host, "https://x.y:8/a", "x.y"), (urls.host, "x.y", ""), (urls.robots_path, "https://x/a?b#c", "/a"), (urls.crawlable, "HTTPS://x", False), (urls.crawlable, "ftp://x", True),
    (urls.href_class, "mailto:a@b", "skip"), (urls.href_class, "#", "skip"), (urls.href_class, "/x", "relative"), (urls.href_class, "https://x", "absolute"), (urls.trie_path, "https://x/a/b.html", "a"),
    (urls.domain_pattern, "https://x.y/a/b", "https://x.y/*"), (blocks.from_url, "https://x/cdn-cgi/challenge-platform/a", "Cloudflare"), (blocks.from_body, "prove you're not a robot", "generic"),
    (blocks.from_body, "plain", None), (html.empty_body, "<html></html>", True), (html.empty_body, "{}", False), (html.empty_body, " <html><body> \n</body></html>", True), (html.sniff, "  <!DOCTYPE HTML>", True),
    (html.sniff, "hello", False), (html.content_class, "text/html; charset=x", "Html"), (html.content_class, "audio/mpeg", "Unknown"), (html.visible, "<p>a b</p><script>x</script>c", 3),
    (html.signature, "", None), (headers.status, "HTTP/1.1 404 No", 404), (headers.status, "HTTP/2", None), (headers.content_length, "A: b\r\nContent-Length: 12", 12), (blocks.captcha, "<div class='g-recaptcha'>", True),
])
def test_expressions(spark, make, value, want):
    assert one(spark, make, value) == want


@pytest.mark.parametrize(("url", "level", "want"), [("https://x.test/product/1", 1, 950), ("https://x.test/legal", 0, 800), ("https://x.test/a", 30, 0)])
def test_score(spark, url, level, want):
    assert one(spark, urls.score, url, str(level)) == want


def test_resolve_and_keys(spark):
    row = spark.createDataFrame([("https://x.test/", "/p#f", "mailto:a@b", "b/c", "//y/z")], "r string, a string, b string, c string, d string").select(*(column(urls.resolve, "r", c) for c in "abcd"), column(urls.cache_key, "'u'", namespace="'n'")).first()
    assert tuple(row) == ("https://x.test/p", "https://x.test/", "https://x.test/b/c", "https://y/z", "GET:u::ns=n")


def test_quality(spark):
    none = "cast(null as string)"
    assert one(spark, html.quality, "", "200", "false", none) == 50
    full = "<html><body>" + "x" * 5000 + "</body></html>"
    assert one(spark, html.quality, full, "200", "false", none) == 100
    assert one(spark, html.quality, full, "503", "false", "'Cloudflare'") == 50


def test_glob_seeds():
    assert tables.expand_glob("h/[01-03]") == ["h/01", "h/02", "h/03"]
    assert tables.expand_glob("h/{a,b}/[1-5:2]") == ["h/a/1", "h/a/3", "h/a/5", "h/b/1", "h/b/3", "h/b/5"]
    assert tables.expand_glob("h/x") == []


ROBOTS = "User-agent: bot\nDisallow: /\n\nUser-agent: *\nAllow: /a\nDisallow: /dir\nDisallow: /d/\nCrawl-delay: 2\n"


def test_robots():
    only = robots.parse("User-agent: bot\nDisallow: /")
    assert robots.can_fetch(only, "bot/1.0", "/", strict=False) and not robots.can_fetch(only, "bot/1.0", "/")
    both = robots.parse(ROBOTS)
    assert len(both) == 2 and robots.crawl_delay(both, "other") == 2 and robots.crawl_delay(both, "bot") is None
    assert robots.can_fetch(both, "other", "/dir/x") and not robots.can_fetch(both, "other", "/dir") and not robots.can_fetch(both, "other", "/d/x")
    assert robots.can_fetch(both, "bot/2", "/a", strict=False) and not robots.can_fetch(both, "bot/2", "/a")
    assert robots.parse("Disallow: /x\n") == [] and robots.request_rate(robots.parse("User-agent: *\nRequest-rate: 1/5"), "x") is None


def test_robots_join(spark):
    pages = spark.createDataFrame([(1, "a", "/x/1"), (2, "a", "/x"), (3, "b", "/x/1"), (4, "a", "/q")], "page_id int, host string, path string")
    rules = spark.createDataFrame([("a", 1, "/x/1", True), ("a", 2, "/x/*", False), ("a", 3, "/q", False)], "rule_host string, line int, rule string, allow boolean")
    assert {r["page_id"]: r["allowed"] for r in robots.allowed(pages, rules).collect()} == {1: True, 2: True, 3: True, 4: False}


PAGE = "<head><title>T</title><script>x</script><style>y</style></head><body><nav><a href='/n'>n</a></nav><div class='header'>h</div><div class='ad'>buy</div><!-- c --><p id='a' style='color:red'>one <b>two<p>three</body>"


def test_cleaning():
    base, words, full, agent = (htmltree.MODES[m].clean(PAGE) for m in ("base", "base_words", "full_crawler", "full_agent"))
    assert "buy" not in base and ">h<" not in base and ">h<" in words and "buy" not in words
    assert "<script>" in full and "<nav>" not in full and "color" not in full and 'id="a"' in full and "<script>" not in agent
    assert "c" not in htmltree.render(htmltree.tree(agent)).split("<!--")[1:] and htmltree.clean(PAGE, "raw") == PAGE


def test_selectors():
    got = htmltree.select(PAGE, {"t": ["title"], "p": ["body p"], "d": ["div.ad, div.header"], "a": ["nav > a[href^='/']"], "n": ["div:not(.ad)"], "bad": ["::"]})
    assert got == {"t": ["T"], "p": ["one two", "three"], "d": ["h", "buy"], "a": ["n"], "n": ["h"]}
    assert htmltree.select("<p>a</p><p>a</p><p>b</p>", {"p": ["p"]}, consecutive=True) == {"p": ["a", "b"]}
    assert htmltree.link_list("<a href='/x'>1</a><a href='/y.pdf'>2</a><a href='/z' aria-hidden='true'>3</a><a href='/f.rss'>4</a>") == ["/x"]
    assert htmltree.link_list("<a href='/f.rss'>4</a>", xml=True) == ["/f.rss"]


def test_text_forms():
    h = "<h2>Head</h2><p>a <b>b</b> <a href='/u'>l</a></p><ul><li>x<li>y</ul>"
    assert htmltree.to_text(h) == "Head\na b l\nx\ny"
    assert htmltree.to_text(h, markdown=True) == "## Head\na **b** [l](/u)\n- x\n- y"


def test_json():
    assert jsonx.infer_schema({"a": 1, "b": []}) == {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {}}}, "required": ["a", "b"]}
    merged = jsonx.merge_schemas([jsonx.infer_schema({"a": 1, "b": 2}), jsonx.infer_schema({"a": "x"})])
    assert merged["required"] == ["a"] and len(merged["properties"]["a"]["oneOf"]) == 2
    assert jsonx.parse_lenient('say {"a": {"b": 1}}} end') == {"a": {"b": 1}}
    assert jsonx.parse_lenient("x ```json\n{\"a\": 1}\n``` y") == {"a": 1} and jsonx.parse_lenient("{\"a\": yes}") == {"a": "yes"} and jsonx.parse_lenient("no") is None
    assert jsonx.last_balanced('a {"x": "}"} b', "{") == '{"x": "}"}' and jsonx.tail("héé", 3) == "...é"
    assert jsonx.assistant_content({"choices": [{"message": {"content": "hi"}}]}) == "hi" and jsonx.usage({})["prompt"] == 0
    assert jsonx.tool_calls({"content": [{"type": "tool_use", "id": 1, "name": "f", "input": {}}]})[0]["name"] == "f"


def test_sinks(spark, tmp_path):
    assert sinks.local_path("/a/b%20c/") == "a/b c.html" and sinks.local_path("/") == "index.html" and sinks.local_path("/con.txt") == "con.txt_"
    pages = spark.createDataFrame([("https://x/", 200, "<p>é</p>", 86400), ("", 200, "x", 0)], "url string, status int, html string, epoch long")
    sinks.write_warc(pages, f"{tmp_path}/w")
    text = "".join(r[0] for r in spark.read.text(f"{tmp_path}/w", wholetext=True).collect())
    assert text.count("WARC-Type: response") == 1 and "WARC-Date: 1970-01-02T00:00:00Z" in text and "Content-Length: 9" in text
    new = spark.createDataFrame([("https://A/",), ("https://a/",), ("https://b/",)], "url string")
    sinks.append_unseen(new, f"{tmp_path}/v")
    sinks.append_unseen(new, f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").count() == 2


#: A reference cut off at the end of a text, as in titles of sf0.1.
CUT = "<title>a &amp; b&amp</title><article><h1>a &amp; b&amp</h1><p>&am &copy; &lt;x&gt; &#x27;</p></article><nav><a href='/?a=1&copy=2&amp;b'>n</a></nav><script>x&&amp;y&amp</script>"


def test_features_of_a_cut_reference(spark):
    row = htmltree.features(spark.createDataFrame([(1, CUT), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert row[0]["title"] == "a & b&amp" and row[0]["n_links"] == 1 and row[1]["title"] is None
    root = htmltree.tree(CUT.replace("a &amp", "﷐ &amp"), closed=True)
    assert next(e for e in root.walk() if e.name == "script").children == ["x&&amp;y&amp"]
    assert next(e for e in root.walk() if e.name == "title").children == ["﷐ & b&amp"]


def test_selected_cut_reference():
    assert htmltree.select(CUT, {"t": ["title", "article h1"], "p": ["p"]}) == {"t": ["a & b&amp", "a & b&amp"], "p": ["&am © <x> '"]}


def test_text_of_a_cut_reference():
    assert htmltree.to_text(CUT) == "a & b&amp\na & b&amp\n&am © <x> '\nn"
    assert htmltree.to_text(CUT, markdown=True).startswith("a & b&\n# a & b&\n")


def test_paths_to_a_cut_reference(spark):
    got = htmltree.xpath_selected(spark.createDataFrame([(1, CUT)], "page_id long, html string"), {"h": "//article/h1", "a": "//a/@href"})
    assert {r["name"]: r["texts"] for r in got.collect()} == {"h": ["a & b&amp"], "a": ["/?a=1&copy=2&b"]}


def test_block_marks_are_searched_once(spark):
    """Each mark alone and after another's beginning gives its vendor, and the query has one search of the body and one of the URL."""
    for make, marks in ((blocks.from_url, blocks.URL_MARKS), (blocks.from_body, blocks.BODY_MARKS)):
        rows = [(m, v) for v, ms in marks for m in ms]
        texts = spark.createDataFrame([(p + m + " challenges", v) for m, v in rows for p in ("", "cf-_DD", "a" * 90)] + [("cf-erro px-captch", None), (None, None)], "t string, v string")
        assert texts.select("t", "v", F.expr(make(Spark, "t")).alias("got")).filter("not (v <=> got)").collect() == []
    assert [blocks.any_mark(x) for x in (["ab", "a"], ["a", "ab"])] == ["(ab|a)", "(a|ab)"]
    assert plans_gates._vendors(Spark, "pages").count("regexp_extract(") == 2


def test_signatures_normalise_once(spark):
    """Nulls, empty and script-only pages have none; the text is normalised once, also below a filter, and white space at the ends is trimmed without a pattern."""
    rows = spark.createDataFrame([("<p src='x'>a",), ("<p>a",), ("<script>x</script>",), ("",), (None,)], "h string")
    assert [r[0] for r in rows.select(F.expr(html.signature(Spark, "h"))).collect()] == [md5(b"<p>a").hexdigest()] * 2 + [None] * 3
    assert html.signature(Spark, "h").count("regexp_replace") == 2 and "regexp_replace" not in html.empty_body(Spark, "h")
    for text, empty in ((" \t\r\n\f<html></html>\f \n", True), ("f<html></html>", False), ("<html></html>u0c", False), ("\x0b<html></html>", False), (" \f", True), ("f", False)):
        assert one(spark, html.empty_body, text) is empty


def test_pages_go_in_pieces(spark, monkeypatch):
    """A worker's batches are cut by size, rows keep their page, nulls and pages without rows are fine, and a tree leaves no cycles."""
    import gc

    monkeypatch.setattr(htmltree, "PIECE", 50)
    pages = spark.createDataFrame([(k, None if k % 7 == 0 else f"<h1>t{k}</h1>" + "<p>x</p>" * (k % 5)) for k in range(40)], "page_id long, html string").coalesce(1)
    got = {r["page_id"]: r["markdown"] for r in htmltree.transformed(pages, markdown=True).collect()}
    assert got == {k: "" if k % 7 == 0 else "\n".join([f"# t{k}"] + ["x"] * (k % 5)) for k in range(40)}
    odd = htmltree.by_page(pages, ["page_id", "html"], "page_id long", lambda i, _: [(i,)] if i % 2 else [])
    assert sorted(r[0] for r in odd.collect()) == list(range(1, 40, 2))
    gc.collect()
    gc.disable()
    try:
        before = sum(isinstance(x, htmltree.Element) for x in gc.get_objects())
        htmltree.to_text("<div><p>a<b>c</b></div>" * 50, markdown=True)
        htmltree.select("<div><p>a<b>c</b></div>" * 50, {"p": ["div p"]})
        assert sum(isinstance(x, htmltree.Element) for x in gc.get_objects()) == before
    finally:
        gc.enable()
