"""Columns over records kept as arrays of structs or maps: page elements, form fields, plan steps, alternatives, usage, diffs."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clickable(elements: Column) -> Column:
    return F.filter(elements, lambda e: e["visible"] & e["enabled"] & e["type"].isin("button", "link"))


def inputs(elements: Column) -> Column:
    return F.filter(elements, lambda e: e["type"].startswith("input") | (e["type"] == "textarea"))


def of_type(elements: Column, kind: str) -> Column:
    return F.filter(elements, lambda e: e["type"] == kind)


def required(fields: Column, empty: bool = False) -> Column:
    """Required form fields; with `empty`, those without a value."""
    return F.filter(fields, lambda f: f["required"] & (F.coalesce(f["value"], F.lit("")) == "" if empty else F.lit(True)))


def in_category(urls: Column, category: str) -> Column:
    return F.filter(urls, lambda u: F.lower(u["category"]) == category.lower())


def flagged(rows: Column, flag: str) -> Column:
    """Recommended URLs, critical steps: rows whose flag is set."""
    return F.filter(rows, lambda r: F.coalesce(r[flag], F.lit(False)))


def with_value(rows: Column, field: str) -> Column:
    """Steps that have a checkpoint: rows whose field isn't null."""
    return F.filter(rows, lambda r: r[field].isNotNull())


def by_score(rows: Column, field: str = "score") -> Column:
    """Sorted, best first; equal ones keep their order."""
    keyed = F.transform(rows, lambda r, i: F.struct((-r[field]).alias("k"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda x: x["r"])


def first_alternative(rows: Column) -> Column:
    """The first as given, not the best."""
    return F.get(rows, F.lit(0))


def map_total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)


def merge_usage(rows: DataFrame, key: str, counts: list[str], tools: str) -> DataFrame:
    """Field-wise sums, and the tool maps summed by tool (at most as many rows a key as there are tools)."""
    sums = rows.groupBy(key).agg(*(F.sum(c).alias(c) for c in counts))
    per = rows.select(key, F.explode_outer(tools).alias("_t", "_n")).groupBy(key, "_t").agg(F.sum("_n").alias("_n"))
    maps = per.groupBy(key).agg(F.map_from_entries(F.filter(F.collect_list(F.struct("_t", "_n")), lambda x: x["_t"].isNotNull())).alias(tools))
    return sums.join(maps, key)


def excerpt(text: Column, most: int = 500, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def context_window(html: Column, most: int) -> Column:
    """A window that begins at <main, else <form, else <body, where the text is longer than that."""
    at = F.coalesce(*[F.when(F.instr(html, t) > 0, F.instr(html, t)) for t in ("<main", "<form", "<body")], F.lit(1))
    return F.when(F.octet_length(html) > most, F.concat(F.lit("[excerpt]\n"), F.substr(html, at, F.lit(most)), F.lit("\n[end of excerpt]"))).otherwise(html)


def diff_text(url: Column, title: Column, changed: Column, added: Column, removed: Column, same: Column) -> Column:
    """Condensed form of a page diff; the arrays are sorted, so the text is the same on every run."""

    def part(name: str, xs: Column) -> Column:
        return F.when(F.size(xs) > 0, F.concat(F.lit(name + ":\n"), F.array_join(F.array_sort(xs), "\n")))

    return F.concat_ws("\n", F.concat(F.lit("URL: "), url), F.concat(F.lit("TITLE: "), title), part("CHANGED", changed), part("NEW", added), part("REMOVED", removed), F.concat(F.lit("UNCHANGED: "), same.cast("string")))


def savings(n_changes: Column, condensed_bytes: Column, original_bytes: Column) -> Column:
    """Share of bytes that a condensed diff saves; 0.95 where nothing changed."""
    return F.when(n_changes == 0, 0.95).otherwise(1.0 - condensed_bytes / original_bytes)


def diff_or_full(initial: Column, savings: Column, least: float, full: Column, condensed: Column) -> Column:
    return F.when(initial | (savings < least), full).otherwise(condensed)


def should_diff(mode: str, n_bytes: Column, round_: Column) -> Column:
    if mode == "disabled":
        return F.lit(False)
    return (round_ > 0) & ((n_bytes > 10_000) if mode == "auto" else F.lit(True))


def condition(tree: dict) -> Column:
    """A condition tree over columns url, text, selectors (array), ok: {"all"|"any": [...]}, {"not": ...}, {"url_has"|"text_has"|"selector": s}, {"url_glob": p}, {"previous": bool}."""
    from gleaner.functions import urls
    from gleaner.functions.dialect import Spark

    (kind, v), *rest = tree.items()
    if rest:
        raise ValueError("one key a node")
    if kind in ("all", "any"):
        out = F.lit(kind == "all")
        for t in v:
            out = out & condition(t) if kind == "all" else out | condition(t)
        return out
    if kind == "not":
        return ~condition(v)
    if kind == "url_glob":
        return F.expr(urls.glob(Spark, "url", v))
    if kind == "previous":
        return F.col("ok") == v
    return F.array_contains("selectors", v) if kind == "selector" else F.contains(F.col("url" if kind == "url_has" else "text"), F.lit(v))


def fnv1a64(df: DataFrame, column: str, out: str = "hash") -> DataFrame:
    """64-bit FNV-1a of a string column, as a signed long."""
    def run(s: pd.Series) -> pd.Series:
        def one(text) -> int | None:
            if text is None:
                return None
            h = 0xCBF29CE484222325
            for b in text.encode():
                h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            return h - (1 << 64) if h >> 63 else h

        return pd.Series([one(t) for t in s], dtype="Int64")

    return df.withColumn(out, F.pandas_udf(run, "long")(F.col(column)))


def validated(base: Column, reject: Column, override: Column, adjustment: Column) -> Column:
    """A quality score after a user's check: 0 if rejected, the override if given, else adjusted and clamped."""
    return F.when(reject, 0).otherwise(F.coalesce(override, F.least(F.lit(100), F.greatest(F.lit(0), base + F.coalesce(adjustment, F.lit(0))))))


def on_links(links: DataFrame, callback: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Hook on found links (url, html): any DataFrame function; the schema must stay."""
    out = callback(links)
    if out.schema != links.schema:
        raise ValueError("a link callback keeps the schema")
    return out


def fetched(urls: DataFrame, fetcher: Callable[[DataFrame], DataFrame] | None, pages: DataFrame) -> DataFrame:
    """Pages of URLs, by a user's transport or by a join with a table of pages; only the round trip is replaced."""
    return fetcher(urls) if fetcher else urls.join(pages, "url")


def retried(attempts: DataFrame, strategy: Callable[[Column, Column], Column]) -> DataFrame:
    """attempts with the delay before the next one, by a strategy of (status, attempt); null: no more."""
    return attempts.withColumn("retry_ms", strategy(F.col("status"), F.col("attempt")))


def recall(records: DataFrame, query: str, k: int, least: float = 0.0, text: str = "text") -> DataFrame:
    """The k records nearest to a query by cosine of word counts, ties to the smaller id: a distributed top-k, no index."""
    words = re.findall(r"\w+", query.lower())
    if not words:
        return records.withColumn("relevance", F.lit(0.0)).limit(0)
    counts = {w: words.count(w) for w in set(words)}
    norm = sum(n * n for n in counts.values()) ** 0.5
    low = F.lower(text)
    if least > 0:  # rows without a word of the query have a relevance of 0
        records = records.filter(reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in sorted(counts))))
    bag = F.col("_bag")
    per = records.withColumn("_bag", F.sort_array(F.regexp_extract_all(low, F.lit(r"(\w+)"), F.lit(1))))
    dot = sum(((F.size(bag) - F.size(F.array_remove(bag, w))) * float(n) for w, n in sorted(counts.items())), F.lit(0.0))
    # Equal words lie together: a run that grows from n to n + 1 adds 2n + 1 to the sum of squares.
    zero = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(acc: Column, w: Column) -> Column:
        run = F.when(w == acc["word"], acc["run"]).otherwise(0.0)
        return F.struct(w.alias("word"), (run + 1.0).alias("run"), (acc["sum"] + 2.0 * run + 1.0).alias("sum"))

    squares = F.aggregate(bag, zero, step, lambda acc: acc["sum"])
    per = per.withColumn("relevance", F.coalesce(F.try_divide(dot, F.sqrt(squares) * norm), F.lit(0.0)))
    # Of the k best, those that pass: the k best of those that pass. Spark would push a filter before the limit below both columns and reckon them once for each use.
    return per.orderBy(F.desc("relevance"), "id").limit(k).filter(F.col("relevance") >= least).drop("_bag")


def context_string(entries: DataFrame, most: int) -> DataFrame:
    """Entries (rank, text) until their bytes are spent, as one text; rank is a top-k's, so the window is small."""
    from pyspark.sql.window import Window

    total = F.sum(F.octet_length("text") + 1).over(Window.orderBy("rank"))
    kept = entries.withColumn("_t", total).filter(F.col("_t") <= most)
    return kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"]), "\n").alias("context"))


def header_map(pairs: Column) -> Column:
    """A map of header pairs (name, value): a repeated name keeps its last value; values that aren't visible ASCII are left out."""
    fine = F.filter(pairs, lambda x: x["value"].rlike(r"^[\x20-\x7e]*$"))
    names = F.array_distinct(F.transform(fine, lambda x: F.lower(x["name"])))
    last = F.transform(names, lambda n: F.element_at(F.filter(fine, lambda x: F.lower(x["name"]) == n), -1)["value"])
    return F.map_from_arrays(names, last)


def split_headers(headers: Column, prefix: str) -> tuple[Column, Column]:
    """Headers that a proxy prefixed, without the prefix, and the others."""
    proxied = F.transform_keys(F.map_filter(headers, lambda k, _: k.startswith(prefix)), lambda k, _: F.substr(k, F.lit(len(prefix) + 1)))
    return proxied, F.map_filter(headers, lambda k, _: ~k.startswith(prefix))


def searched(results: DataFrame, language: str | None = None, country: str | None = None, sites: list[str] | None = None, without_sites: list[str] | None = None, keywords: list[str] | None = None, since: Column | None = None, limit: int = 10, per: str | None = None, ties: str = "url") -> DataFrame:
    """results (site, lang, text, score, ...) that meet the search options, with their rank, best first; at most `limit` in all, or for each `per`."""
    from pyspark.sql.window import Window

    tests = [F.col("lang") == language] if language else []
    tests += [F.col("country") == country] if country else []
    tests += [F.col("site").isin(*sites)] if sites else []
    tests += [~F.col("site").isin(*without_sites)] if without_sites else []
    tests += [F.contains(F.lower("text"), F.lit(k.lower())) for k in keywords or ()]
    tests += [F.col("ts") >= since] if since is not None else []
    for t in tests:
        results = results.filter(t)
    order = [F.desc("score"), F.asc(ties)]
    if per is None:
        results = results.orderBy(*order).limit(limit)
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(*([per] if per else [F.lit(1)])).orderBy(*order))).filter(F.col("rank") <= limit)


def result_urls(results: Column) -> Column:
    """URLs of an array of results, in order."""
    return F.transform(results, lambda r: r["url"])
