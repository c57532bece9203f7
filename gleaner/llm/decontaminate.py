"""Benchmark decontamination, with DataFrame functions only.

Method: a broadcast hash set of normalised test n-grams. Training texts are scanned window by window inside
one code-generated span (regexp -> explode of window positions -> hash -> broadcast hash probe), so that a
window is a few registers and never a shuffled row; only hits and one marker row per document are shuffled.
A probe that hits by hash is verified by comparing the words themselves. The set is broadcast in slices of at most
SLICE_WINDOWS windows and about SLICE_BYTES bytes, by hash; there is one for all but huge benchmarks, and each further
one scans the texts again. So what is broadcast is bounded, and no text is shuffled.

Defined results. Null text: no words, no hits. Null ids and repeated ids: each input row is reported by
itself (rows are told apart by id and by a digest of the text; equal rows come back as often as they came).
Empty benchmark: nothing is hit. An item without words has no window. Extra columns, of any name, are left aside by
`decontaminate` and `report` and kept by `remove`. Empty table: no rows. Overlapping windows count a word once.
Long texts cost time in proportion to their words; no row ever holds more than one text's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import fresh, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: What one broadcast slice of the benchmark's windows holds at most.
SLICE_WINDOWS, SLICE_BYTES = 1_000_000, 128_000_000
#: Documents to be removed are broadcast up to this many (an id and a digest each), and joined by a shuffle beyond.
FEW = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def window_hash(ws: Column, at: Column, length: int) -> Column:
    """64-bit hash of the words at..at+length-1 (0-based)."""
    return F.xxhash64(*[F.get(ws, at + i) for i in range(length)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[int]]:
    """Distinct windows (w_len, w_hash, w_text, items), and the lengths that occur (at most `window`)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws"))
    items = items.withColumn("n", F.size("ws")).filter("n > 0").withColumn("w_len", F.least("n", F.lit(window)))
    at = items.select("item", "ws", "w_len", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("w_len"))).alias("at"))
    at = at.select("item", "w_len", F.slice("ws", F.col("at") + 1, F.col("w_len")).alias("w"))
    lengths = sorted(r[0] for r in at.select("w_len").distinct().collect())  # at most `window` values
    hashed = F.lit(None).cast("long")
    for k in lengths:
        hashed = F.when(F.col("w_len") == k, window_hash(F.col("w"), F.lit(0), k)).otherwise(hashed)
    at = at.select("item", "w_len", hashed.alias("w_hash"), F.array_join("w", " ").alias("w_text"))
    # One row a distinct window, with the items that have it.
    return at.groupBy("w_len", "w_hash", "w_text").agg(F.collect_set("item").alias("items")), lengths


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, digest of the text, n_words, hit word positions (0-based), items whose windows occur."""
    wins, lengths = benchmark_windows(benchmark, window)
    n, size = wins.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("w_text") + F.size("items") * 24 + 64), F.lit(0))).first()
    slices = max(1, -(-n // SLICE_WINDOWS), -(-size // SLICE_BYTES))
    if slices > 1:
        wins = materialise(wins)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    base = base.select("_id", F.md5(F.coalesce(F.col("_text"), F.lit("\0null")).cast("binary")).alias("_digest"), words(F.col("_text")).alias("_ws"))
    base = base.withColumn("_n", F.size("_ws"))
    per = max(1, len(lengths))
    # Position -1 is the document's own marker row. explode_outer: no filter that would split the texts twice is inferred for it.
    step = base.select("_id", "_digest", "_n", "_ws", F.explode_outer(F.sequence(F.lit(-1), F.col("_n") * per - 1)).alias("_step"))
    pos = F.when(F.col("_step") < 0, F.lit(-1)).otherwise((F.col("_step") / per).cast("int"))
    h, k = F.lit(None).cast("long"), F.lit(0)
    for i, length in enumerate(lengths):
        this = (F.col("_step") >= 0) & (F.pmod(F.col("_step"), F.lit(per)) == i)
        h = F.when(this & (F.col("_pos") + length <= F.col("_n")), window_hash(F.col("_ws"), F.col("_pos"), length)).otherwise(h)
        k = F.when(this, F.lit(length)).otherwise(k)
    probe = step.withColumn("_pos", pos)
    probe = probe.select("_id", "_digest", "_n", "_pos", k.alias("_len"), h.alias("_hash"), "_ws")
    same = F.array_join(F.slice("_ws", F.col("_pos") + 1, F.greatest("_len", F.lit(1))), " ") == F.col("w_text")

    def hits(k: int) -> DataFrame:
        """Verified hits in slice k; with the documents' own marker rows in the first."""
        part = F.broadcast(wins if slices == 1 else wins.filter(F.pmod("w_hash", F.lit(slices)) == k))
        found = probe.join(part, (F.col("_hash") == F.col("w_hash")) & (F.col("_len") == F.col("w_len")), "left").filter("_pos < 0 or w_hash is not null" if k == 0 else "w_hash is not null")
        return found.select("_id", "_digest", "_n", "_pos", "_len", "items", F.when(F.col("_pos") < 0, F.lit(True)).otherwise(same).alias("_ok")).filter("_ok")

    hit = hits(0)
    for k in range(1, slices):
        hit = hit.unionByName(hits(k))
    grouped = hit.groupBy("_id", "_digest").agg(
        F.max("_n").alias("n_words"), F.count(F.when(F.col("_pos") < 0, 1)).alias("_rows"),
        F.collect_set(F.when(F.col("_pos") >= 0, F.struct("_pos", "_len"))).alias("_hits"), F.collect_set("items").alias("_items"))
    positions = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda x: F.sequence(x["_pos"], x["_pos"] + x["_len"] - 1)))))
    grouped = grouped.withColumn("hit_positions", positions)
    items = F.array_sort(F.array_distinct(F.flatten("_items")))
    out = grouped.select(F.col("_id").alias(id_col), F.col("_digest").alias("text_digest"), "n_words", "hit_positions", items.alias("items"), "_rows")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))).drop("_copy", "_rows")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    d = decontaminate(docs, benchmark)
    return d.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("hit_positions").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_positions") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents in which a benchmark window occurs."""
    bid, bdig = fresh(docs, "bid", "bdig")
    bad = decontaminate(docs, benchmark).filter(F.size("hit_positions") > 0).select(F.col("doc_id").alias(bid), F.col("text_digest").alias(bdig)).distinct()
    bad = materialise(bad)
    if bad.count() <= FEW:
        bad = F.broadcast(bad)
    digest = F.md5(F.coalesce(F.col("text"), F.lit("\0null")).cast("binary"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bid)) & (digest == F.col(bdig)), "left_anti")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w FROM b, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS u(i) WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, i, k, array_to_string(ws[i : i + k - 1], ' ') AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), ks WHERE i + k - 1 <= len(ws)),
h AS (SELECT rid, i, dw.k, item FROM dw JOIN bw ON dw.w = bw.w AND dw.k = bw.k),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
