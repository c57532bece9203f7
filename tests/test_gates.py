"""Literal cases of gates, caches, model choice, robots, links, paths, responses and streaming helpers."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import folds, gates, htmltree, jsonx, records, responses, robots
from gleaner.functions.dialect import Spark
from gleaner.operators import caching, frontier, models, sets, steps
from gleaner.sources import sinks
from gleaner.streaming import events


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "v string").select(F.expr(make("v")).alias("x")).first()[0]


@pytest.mark.parametrize(("host", "plain", "subs", "tlds", "both"), [
    ("Example.com", True, True, True, True), ("a.example.com", False, True, False, True), ("example.org", False, False, True, True), ("a.example.org", False, False, False, True), ("notexample.com", False, False, False, False),
])
def test_scopes(spark, host, plain, subs, tlds, both):
    assert [one(spark, lambda v: gates.in_scope(Spark, v, "example.com", s, t), host) for s, t in ((False, False), (True, False), (False, True), (True, True))] == [plain, subs, tlds, both]


def test_bodies_and_backends(spark):
    assert [one(spark, lambda v: gates.binary_body(Spark, v), x) for x in ("  %PDF-1.4", "<html>", "", "\n\tGIF89a")] == [True, False, False, True]
    assert [one(spark, lambda v: gates.xml_body(Spark, v), x) for x in (" <?xml version='1.0'?>", "<html>")] == [True, False]
    assert [one(spark, lambda v: gates.skip_backend(Spark, v, ["PHP", "x"]), u) for u in ("https://x/a.php", "https://x/a.x", "https://x/a.jpg", "https://x/a")] == [True, False, True, False]
    assert one(spark, lambda v: gates.external(Spark, v, ["*"]), "any.test") and not one(spark, lambda v: gates.external(Spark, v, ["x.test"]), "any.test")
    assert gates.with_sitemap(None) == (None, False, False) and gates.with_sitemap([]) == ([], False, False)
    assert gates.with_sitemap(["/a"], "map.xml") == (["/a", "sitemap.xml", "map.xml"], True, True) and gates.with_sitemap(["sitemap.xml"])[1] is False


def test_caches(spark):
    now = spark.createDataFrame([("https://x/a", 90, "A"), ("https://x/b/", 10, "B"), ("https://x/c", 95, "")], "url string, stored_at int, body string")
    asked = spark.createDataFrame([("https://x/a",), ("https://x/a/",), ("https://x/b",), ("https://x/c",), ("https://x/a",)], "url string")
    got = caching.cached(asked, now, F.lit(100), F.lit(50), useless=F.col("body") == "").collect()
    assert sorted((r["url"], r["cached_body"]) for r in got if r["cached_body"]) == [("https://x/a", "A"), ("https://x/a", "A"), ("https://x/a/", "A")] and len(got) == 5
    stale = caching.cached(asked, now, F.lit(100), F.lit(50), allow_stale=True).filter("url = 'https://x/b'").first()
    assert stale["cached_body"] == "B"
    requests = spark.createDataFrame([("u", 1, 1, "a"), ("u", 5, 2, "b"), ("w", 5, 3, "c")], "url string, ts int, event_id int, x string")
    stored = spark.createDataFrame([("u", 3, 9, "e1", None), ("u", 5, 2, "e2", None)], "url string, ts int, event_id int, etag string, last_modified string")
    assert {(r["url"], r["ts"], r["etag"]) for r in caching.as_of(requests, stored, "url", ["etag", "last_modified"]).collect()} == {("u", 1, None), ("u", 5, "e1"), ("w", 5, None)}


def test_hedges_and_throttles(spark):
    def delay(*xs):
        return spark.range(1).select(folds.hedge_delay(*map(F.lit, xs))).first()[0]

    assert delay(200, 3, 1000, 1_000_000, 0, 0, 0) == 200  # warm-up
    assert delay(200, 20, 1000, 1_000_000, 0, 0, 0) == 1000 and delay(200, 20, 1000, 1_000_000, 3, 0, 0) == 500
    assert delay(200, 20, 1000, 1_000_000, 0, 5, 3) == 750 and delay(200, 20, 1000, 1_000_000, 0, 4, 4) == 1000 and delay(600, 20, 1000, 1_000_000, 3, 0, 0) == 600
    row = spark.range(1).select(folds.throttled_rate(F.lit(10.0)), folds.throttled_rate(F.lit(0.1)), folds.throttled_rate(F.lit(1e9)), folds.win_pct(F.lit(1), F.lit(0))).first()
    assert tuple(row) == (0.1, 1.0, 0.01, 0)


def test_models(spark):
    m = spark.createDataFrame([(0, "a", 90.0, 10.0, 8000, True), (1, "b", 80.0, 1.0, 16000, True), (2, "c", None, None, 32000, False)], "place int, name string, arena double, cost double, context int, vision boolean")
    assert models.selected(m, {}).first()["name"] == "a" and models.selected(m, {}, "cheapest").first()["name"] == "b" and models.selected(m, {}, "context").first()["name"] == "c"
    assert models.selected(m.filter("place < 2"), {}, "context").first()["name"] == "a"  # of two, the first that fits
    assert [r["name"] for r in models.selected_for_each(m, [{"vision": True}] * 3).orderBy("need").collect()] == ["a", "b", "a"]
    t = spark.createDataFrame([("high", 100), ("medium", 100), ("low", 100)], "tier string, n int")
    assert [r[0] for r in t.select(models.constrained(F.col("tier"), F.col("n"), "medium", 1000)).collect()] == ["low", "low", "low"]
    assert [r[0] for r in t.select(models.constrained(F.col("tier"), F.col("n"), allow_large=False)).collect()] == ["medium", "medium", "low"]


def test_robots_from_text(spark):
    text = "User-agent: a\nDisallow: /x/\n\nUser-agent: *\nAllow: /x/y\nDisallow: /x/*\nCrawl-delay: 3\n"
    files = robots.parsed(spark.createDataFrame([("h", text), ("empty", None)], "host string, text string"))
    asked = spark.createDataFrame([("h", "/x/y", "A/1"), ("h", "/x/y", "b"), ("h", "/x/z", "b"), ("h", "/x/z", "b"), ("none", "/x/", "a"), ("empty", "/x/", "a"), (None, None, None)], "host string, path string, agent string")
    got = robots.verdicts(asked, files).collect()
    assert len(got) == 7 and sorted((r["host"], r["path"], r["agent"], r["allowed"], r["delay"]) for r in got if r["host"] == "h") == [("h", "/x/y", "A/1", False, None), ("h", "/x/y", "b", True, 3.0), ("h", "/x/z", "b", False, 3.0), ("h", "/x/z", "b", False, 3.0)]
    assert all(r["allowed"] for r in got if r["host"] != "h")
    loose = {(r["path"], r["agent"]): r["allowed"] for r in robots.verdicts(asked, files, strict=False).collect()}
    assert loose["/x/y", "A/1"] is True
    rules = spark.createDataFrame([("h", 1, "/x/", False)], "rule_host string, line int, rule string, allow boolean")
    assert robots.allowed(asked, rules).count() == 7  # repeated rows stay


def test_links_and_paths(spark):
    page = '<base href="/b/"><p><a href="x">1</a> <a href="../y?q#f">2</a><a href="http://[">3</a>'
    got = {r["href"]: r["link"] for r in htmltree.links(spark.createDataFrame([(1, "https://h/d/p", page)], "page_id long, url string, html string")).collect()}
    assert got == {"x": "https://h/b/x", "../y?q#f": "https://h/y?q#f", "http://[": None}
    root = htmltree.tree('<div id="a"><p class="t big">one</p><p>two <b>x</b></p></div><div><p>three</p><a href="/q">l</a></div>')
    assert htmltree.xpath(root, "//div/p") == ["one", "two x", "three"] and htmltree.xpath(root, "//div[@id='a']/p[2]") == ["two x"] and htmltree.xpath(root, "//a/@href") == ["/q"]
    assert htmltree.xpath(root, "//p[contains(@class, 'big')]") == ["one"] and htmltree.xpath(root, "//p[2]/text()") == ["two"]
    for bad in ("p", "//p[last()]", "//@a/b", ""):
        with pytest.raises(ValueError, match="not understood"):
            htmltree.compile_xpath(bad)
    assert [r[0] for r in sinks.with_local_path(spark.createDataFrame([("/a/b?q",), (None,), ("/con/x.txt",)], "p string"), "p").select("local_path").collect()] == ["a/b.html", None, "con_/x.txt"]


def test_responses(spark):
    rows = spark.createDataFrame([("é" * 30,), ("short",), ("```json\n{}\n``` x ```json\n{\"a\":1}",), ("```\n\n```",)], "t string")
    assert [r[0] for r in rows.select(responses.tail(F.col("t"), 5)).collect()][:2] == ["...éé", "short"]
    assert [r[0] for r in rows.select(responses.last_code_block(F.col("t"))).collect()] == [None, None, '{"a":1}', None]
    got = responses.repaired(rows, "t").collect()
    assert [r["value"] for r in got] == [None, None, '{"a": 1}', None]
    assert jsonx.refine({"schema": {"type": "integer"}, "examples": 5, "name": "n"}, ["x"]) == {"schema": {"oneOf": [{"type": "integer"}, {"type": "string"}]}, "examples": 6, "name": "n", "confidence": 0.85}
    h = spark.range(1).select(records.header_map(F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("value")) for a, b in (("A", "1"), ("a", "2"), ("b", "é"))]))).first()[0]
    assert h == {"a": "2"}


def test_sets_and_steps(spark):
    pieces = sets.chunks(spark.createDataFrame([(1, "añb" * 10), (2, "")], "id int, body string"), "body", 3, most=4)
    assert [len(r["chunk"]) for r in pieces.orderBy("number").collect()] == [3, 3, 3, 3]
    whole = sets.joined_chunks(sets.chunks(spark.createDataFrame([(1, "añb" * 10)], "id int, body string"), "body", 2), "id").first()
    assert bytes(whole["body"]).decode() == "añb" * 10 and whole["valid_utf8"]
    done = sets.processed(spark.createDataFrame([(1, "4"), (2, "x"), (3, "6")], "id int, v string"), "v", lambda xs: [int(x) for x in xs], 2, "n", "long")
    assert sorted(map(tuple, done.collect())) == [(1, "4", 4), (3, "6", 6)]
    assert [r["r"] for r in sets.scripted(spark.createDataFrame([(2,), (None,)], "x int"), "result = 10 // int(x)", "r", "long").collect()] == [5, None]
    ties = spark.createDataFrame([(i, 0) for i in range(16)], "id int, used_at int")
    assert steps.evict_oldest(ties).count() == 14
    kept = caching.bounded(spark.createDataFrame([("a", 3, 10), ("b", 2, 10), ("c", 1, 10)], "key string, used_at int, n_bytes int"), 5, 20)
    assert {r["key"] for r in kept.collect()} == {"a", "b"}


def test_evicting_without_a_sort_of_all(spark, monkeypatch):
    monkeypatch.setattr(steps, "FEW", 50)
    cache = spark.range(4000).selectExpr("id", "id * 7919 % 1000 used_at")
    kept = [r["used_at"] for r in steps.evict_oldest(cache).collect()]
    assert len(kept) == 3500 and min(kept) == 125


def test_crawl_with_a_budget(spark):
    links = spark.createDataFrame([("h/0", f"h/{k}") for k in range(1, 6)] + [("h/1", "g/1"), ("h/2", "g/2"), ("g/1", "h/0")], "src string, url string")
    got = {(r["url"], r["depth"]) for r in frontier.crawl(spark.createDataFrame([("h/0",)], "url string"), links, 3, gate=F.col("url") != "h/1", host=F.substring_index("url", "/", 1), budget=3).collect()}
    assert got == {("h/0", 0), ("h/2", 1), ("h/3", 1), ("g/2", 2)}


def test_cron_and_sinks(spark, tmp_path):
    assert events.cron_trigger("*/10 * * * * *") == {"processingTime": "10 seconds"} and events.cron_trigger("0 */5 * * * *") == {"processingTime": "5 minutes"} and events.cron_trigger("0 0 3 1 1 0") == {"availableNow": True}
    with pytest.raises(ValueError, match="six"):
        events.cron_trigger("* * *")
    spark.createDataFrame([("https://x/a", 200, "<p>", 5)], "url string, status int, html string, epoch long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("url string, status int, html string, epoch long").parquet(f"{tmp_path}/in")
    events.fan_out(stream, [sinks.warc_sink(f"{tmp_path}/warc"), events.to_folder(f"{tmp_path}/rows")], f"{tmp_path}/at")
    text = "".join(r[0] for r in spark.read.text(f"{tmp_path}/warc", wholetext=True).select("value").collect())
    assert text.count("WARC-Type: response") == 1 and text.startswith("WARC/1.0\r\nWARC-Type: warcinfo") and spark.read.parquet(f"{tmp_path}/rows").count() == 1
