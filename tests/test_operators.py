"""Folds, frontier, step graphs, streams and the registry."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.functions import folds
from gleaner.operators import frontier, steps
from gleaner.plans import registry
from gleaner.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def fold(spark, make, xs, kind="array<bigint>"):
    return spark.createDataFrame([(xs,)], f"x {kind}").select(make(F.col("x"))).first()[0]


def test_folds(spark):
    assert fold(spark, folds.ema, [1, 2, 3]) == pytest.approx(1.4275)
    assert fold(spark, folds.ema_fifths, [100, 200]) == 120
    assert fold(spark, lambda x: folds.aimd(x, 10, 1, 64, 5), [False], "array<boolean>") == 5
    assert fold(spark, lambda x: folds.aimd(x, 10, 1, 64, 2), [True, True, True], "array<boolean>") == 11
    row = spark.range(1).select(folds.guarded_timeout(8000, F.lit(6)), folds.guarded_timeout(400, F.lit(60)), folds.guarded_timeout(8000, F.lit(300)), folds.backoff_cap(F.lit(3), 100, 500)).first()
    assert tuple(row) == (2000, 400, 500, 500)
    assert fold(spark, lambda t: folds.token_bucket(t, 1.0, 2)["denied"], [0, 0, 0, 5000]) == 1


def test_frontier(spark):
    f = spark.createDataFrame([("a", 1, 0), ("b", 5, 1), ("a", 9, 2), ("c", 5, 3)], "url string, priority int, seq int")
    pushed = frontier.push(f)
    assert {(r["url"], r["priority"]) for r in pushed.collect()} == {("a", 1), ("b", 5), ("c", 5)}
    assert [r["url"] for r in frontier.top(pushed, 2).collect()] == ["c", "b"]
    assert {r["url"] for r in frontier.unvisited(f, f.filter("url = 'a'")).collect()} == {"b", "c"}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = frontier.expand(edges, spark.createDataFrame([("a",)], "node string"), 5)
    assert {(r["node"], r["depth"]) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_steps(spark):
    kind = "id string, depends_on array<string>"
    good = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["a", "b"])], kind)
    assert {(r["id"], r["level"]) for r in steps.levels(good).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(ValueError, match="cycle"):
        steps.levels(spark.createDataFrame([("a", ["b"]), ("b", ["a"])], kind))
    with pytest.raises(ValueError, match="unknown"):
        steps.levels(spark.createDataFrame([("a", ["z"])], kind))
    cache = spark.range(16).withColumnRenamed("id", "used_at")
    assert steps.evict_oldest(cache).count() == 14
    s = steps.stats(spark.createDataFrame([(0.2,), (0.8,)], "confidence double"), 0.5).first()
    assert s["mean"] == 0.5 and s["n_low"] == 1 and steps.stats(spark.createDataFrame([], "confidence double"), 0.5).first()["least"] == 0.0
    ages = spark.createDataFrame([(0, 10), (5, 10)], "at int, ttl int")
    assert steps.fresh(ages, "at", "ttl", F.lit(10)).count() == 1 and steps.fresh(ages, "at", "ttl", F.lit(10), inclusive=True).count() == 2


def test_streams(spark):
    rows = events.batch(spark, SF)
    assert events.finished(events.in_flight(events.read(spark, SF), "user_id"), "append").count() == rows.select("user_id").distinct().count()
    late = events.finished(events.late_counts(events.read(spark, SF), "1 hour", "1 day"), "append")
    assert 0 < late.count() < 40
    ema = {r["user_id"]: r["ema"] for r in events.last_ema(events.read(spark, SF)).collect()}
    one = [r["value"] for r in rows.filter("user_id = 1").orderBy("ts", "event_id").collect()]
    e = one[0]
    for x in one[1:]:
        e += 0.15 * (x - e)
    assert ema[1] == pytest.approx(e, abs=1e-5)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    order = sorted(columns)
    assert sorted(df.columns) == order
    want = sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in rows) == want


def test_thresholds_of_attempts_are_exact(spark):
    rows = spark.createDataFrame([(k, (8 - k) / 10) for k in range(7)] + [(9, 0.2), (1, 0.69), (None, 0.2)], "attempt long, c double")
    assert [r[0] for r in rows.select(steps.accepted(F.col("c"), F.col("attempt"))).collect()] == [True] * 8 + [False, True]
    assert [r[0] for r in rows.limit(7).select(steps.threshold_for(F.col("attempt"))).collect()] == [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]
