"""Frontier, visited set and iterative expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.sources.tables import materialise


def push(urls: DataFrame, url: str = "url", seq: str = "seq") -> DataFrame:
    """First insert of a URL wins, whatever the priority of later ones (exact text)."""
    first = urls.groupBy(url).agg(F.min_by(F.struct(*urls.columns), seq).alias("r"))
    return first.select("r.*")


def top(frontier: DataFrame, n: int, priority: str = "priority", url: str = "url") -> DataFrame:
    """The n of highest priority, ties to the larger URL: a distributed top-k."""
    return frontier.orderBy(F.desc(priority), F.desc(url)).limit(n)


def budget(frontier: DataFrame, key: Column, cap: int, order: list[Column]) -> DataFrame:
    """At most `cap` rows a key; ranks are pruned before the shuffle (window group limit)."""
    return frontier.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_rn") <= cap).drop("_rn")


def unvisited(found: DataFrame, visited: DataFrame, key: str = "url") -> DataFrame:
    return found.select(key).distinct().join(visited.select(key), key, "left_anti")


def expand(edges: DataFrame, seeds: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """(node, depth) of all nodes within `depth` steps of the seeds, breadth first.

    edges (src, dst) are written once, distinct, to the shared folder; each round writes there what it found, which cuts
    the lineage and survives lost executors. Stops when a round finds nothing (or at the limit).
    """
    edges = materialise(edges.select("src", "dst").distinct())
    found = materialise(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    last = found
    for k in range(1, depth + 1):
        step = last.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = materialise(step.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(k)))
        if new.isEmpty():
            break
        found, last = found.unionByName(new), new
        if limit is not None and found.count() >= limit:
            return found.orderBy("depth", "node").limit(limit)
    return found


def round_robin_parts(df: DataFrame, n: int) -> DataFrame:
    """n near-equal parts."""
    return df.repartition(n)


def fit_to_budget(pages: DataFrame, most_pages: int, tokens: int, most_each: int) -> DataFrame:
    """The most relevant pages of each topic, texts cut to an even share of the tokens (4 bytes each)."""
    w = Window.partitionBy("topic")
    ranked = pages.withColumn("rank", F.row_number().over(w.orderBy(F.desc("relevance"), "page_id"))).filter(F.col("rank") <= most_pages)
    share = F.least(F.floor(F.lit(tokens) / F.count(F.lit(1)).over(w)), F.lit(most_each)).cast("long")
    return ranked.withColumn("share", share).withColumn("text", F.expr("substring(text, 1, cast(share * 4 as int))"))


def relevant(pages: DataFrame, least: float, relevance: str = "relevance") -> DataFrame:
    """Pages at or above a relevance, for fit_to_budget()."""
    return pages.filter(F.col(relevance) >= least)


def crawl(seeds: DataFrame, links: DataFrame, depth: int, gate: Column | None = None, host: Column | None = None, budget: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """(url, depth) of a breadth-first crawl: in each round the links (src, url, ...) of the pages just visited that pass the gate, weren't visited, and fit what is left of their host's budget.

    Links are written once, distinct; each round writes what it visits to the shared folder. The seeds are always visited.
    """
    links = materialise(links.filter(gate) if gate is not None else links)
    seen = materialise(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    last = seen
    for k in range(1, depth + 1):
        found = links.join(last.select(F.col("url").alias("src")), "src", "left_semi").drop("src").dropDuplicates(["url"]).join(seen.select("url"), "url", "left_anti")
        if budget is not None:
            spent = seen.groupBy(host.alias("_host")).agg(F.count(F.lit(1)).alias("_spent"))
            w = Window.partitionBy("_host").orderBy(*(order or [F.asc("url")]))
            ranked = found.withColumn("_host", host).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= budget)  # pruned before the shuffle
            found = ranked.join(spent, "_host", "left").filter(F.col("_rn") + F.coalesce("_spent", F.lit(0)) <= budget)
        new = materialise(found.select("url", F.lit(k).alias("depth")))
        if new.isEmpty():
            break
        seen, last = seen.unionByName(new), new
    return seen
