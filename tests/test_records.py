"""Record functions."""

import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import records as R


def test_elements_and_fields(spark):
    e = "array<struct<type:string,visible:boolean,enabled:boolean>>"
    f = "array<struct<required:boolean,value:string>>"
    df = spark.createDataFrame([([("button", True, True), ("link", False, True), ("input[text]", True, True)], [(True, ""), (True, "x"), (False, None), (True, None)])], f"e {e}, f {f}")
    row = df.select(F.size(R.clickable(F.col("e"))), F.size(R.inputs(F.col("e"))), F.size(R.of_type(F.col("e"), "link")), F.size(R.required(F.col("f"))), F.size(R.required(F.col("f"), empty=True))).first()
    assert tuple(row) == (1, 1, 1, 3, 2)


def test_scores_and_texts(spark):
    df = spark.createDataFrame([([(1, 0.2), (2, 0.9), (3, 0.9)], {"a": 2, "b": 3}, "x" * 10 + "<main>" + "y" * 100)], "xs array<struct<id:int,score:double>>, m map<string,int>, h string")
    row = df.select(F.transform(R.by_score(F.col("xs")), lambda x: x["id"]), R.first_alternative(F.col("xs"))["id"], R.map_total(F.col("m")), R.context_window(F.col("h"), 20), R.excerpt(F.col("h"), 3)).first()
    assert row[0] == [2, 3, 1] and row[1] == 1 and row[2] == 5 and "<main>yyy" in row[3] and row[4] == "xxx..."
    d = spark.range(1).select(R.diff_text(F.lit("u"), F.lit("t"), F.array(F.lit("b"), F.lit("a")), F.array(), F.array(F.lit("c")), F.lit(4))).first()[0]
    assert d == "URL: u\nTITLE: t\nCHANGED:\na\nb\nREMOVED:\nc\nUNCHANGED: 4"


def test_hash_validation_hooks(spark):
    assert [r["hash"] for r in R.fnv1a64(spark.createDataFrame([("",), ("a",), (None,)], "s string"), "s").collect()] == [0xCBF29CE484222325 - (1 << 64), 0xAF63DC4C8601EC8C - (1 << 64), None]
    row = spark.range(1).select(R.validated(F.lit(90), F.lit(False), F.lit(None).cast("int"), F.lit(20)), R.validated(F.lit(90), F.lit(True), F.lit(5), F.lit(0)), R.validated(F.lit(90), F.lit(False), F.lit(5), F.lit(0))).first()
    assert tuple(row) == (100, 0, 5)
    links = spark.createDataFrame([("u", "h")], "url string, html string")
    assert R.on_links(links, lambda d: d.withColumn("url", F.upper("url"))).first()["url"] == "U"
    with pytest.raises(ValueError, match="schema"):
        R.on_links(links, lambda d: d.drop("html"))
    assert R.fetched(links.select("url"), None, links).count() == 1
    got = R.retried(spark.createDataFrame([(503, 1), (404, 1)], "status int, attempt int"), lambda s, a: F.when(s >= 500, a * 100)).collect()
    assert [r["retry_ms"] for r in got] == [100, None]


def test_recall(spark):
    rows = spark.createDataFrame([(1, "log in to the shop"), (2, "shop checkout"), (3, "weather")], "id int, text string")
    got = R.recall(rows, "shop checkout", 2).collect()
    assert [r["id"] for r in got] == [2, 1] and got[0]["relevance"] == pytest.approx(1.0)
    context = R.context_string(spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, "c")], "rank int, text string"), 8).first()[0]
    assert context == "aaa\nbbb"


def test_recall_reckons_each_bag_once(spark, capsys):
    texts = ["The of the", "the THE of x", "other lathe", "of", "no", "", None, "of of of the the", "x " * 50 + "the", "the,of;the_of the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").filter("text is not null")

    def want(least):
        from collections import Counter

        q, out = Counter(["the", "of", "the"]), []
        for i, t in enumerate(texts):
            if t is not None:
                n = Counter(w for w in re.findall("[a-z0-9_]+", t.lower()))
                r = sum(n[w] * q[w] for w in q) / ((sum(x * x for x in n.values()) or 1) ** 0.5 * 5**0.5)
                out.append((-r, i))
        return [(i, pytest.approx(-r)) for r, i in sorted(out) if -r >= least][:6]

    for least in (0.0, 0.1, 0.5):
        assert [(r["id"], r["relevance"]) for r in R.recall(rows, "The of the", 6, least).collect()] == want(least)
    R.recall(rows, "The of the", 6, 0.1).explain(True)
    assert capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("regexp_extract_all") == 1


def test_contexts_reckon_each_bag_once(spark, capsys):
    from gleaner.plans import memory

    memory.memory_context(spark, "/root/testdata/sf0.001").explain(True)
    assert capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("regexp_extract_all") == 1
