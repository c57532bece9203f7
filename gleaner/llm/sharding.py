"""Sharding by a minimax contiguous partition, with DataFrame functions only. The law is `bytes`.

Documents of equal text form one atomic group. Groups are ordered by size, largest first, then by digest. The
smallest feasible shard capacity is found by binary search; each trial fills shards greedily, group after group
in that order. Because equal sizes are neighbours, the order is known from its run lengths (size, number of
groups), and a run is filled in one step: the driver gets the histogram of group sizes alone. It has at most
sqrt(2 * total bytes) rows, as distinct positive sizes add up to at most the total; real ones are far fewer.
The cuts are then (size, rank inside that size) pairs, at most one a shard. Ranks are needed only in the sizes
that a cut splits; they, and the gapless slots, are numbered in two levels (bucket counts, then a row number
inside a bucket), so that no task gets a whole size or shard. A group of copies that holds much of the rows
is met by a broadcast of the heavy groups (a bounded number), not by one task of a join.

Defined results. Null text: size 1 and crc32 0, all null texts in one group, apart from empty ones (size 1 too).
Repeated rows and null ids: each row has its own slot. Empty table: no rows. One group larger than an even
share: it has a shard to itself and sets the capacity. Extra columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import join_unique, materialise

SHARDS = 8
#: Rows that one numbering bucket should have.
BUCKET_ROWS = 50_000


def feasible(runs: list[tuple[int, int]], shards: int, capacity: int) -> list[tuple[int, int]] | None:
    """Greedy cuts for runs of (size, count): (run, rank) at which each new shard begins; None if there are too many shards."""
    cuts: list[tuple[int, int]] = []
    room = capacity
    for i, (size, n) in enumerate(runs):
        if size > capacity:
            return None
        done = min(n, room // size)
        room -= done * size
        while done < n:
            if len(cuts) == shards - 1:
                return None
            cuts.append((i, done))
            more = min(n - done, capacity // size)
            room = capacity - more * size
            done += more
    return cuts


def minimax_cuts(runs: list[tuple[int, int]], shards: int) -> tuple[int, list[tuple[int, int]]]:
    """Smallest capacity that is enough, and its cuts."""
    total = sum(s * n for s, n in runs)
    low, high = max([1, -(-total // shards), *(s for s, _ in runs)]), max(1, total)
    while low < high:
        middle = (low + high) // 2
        if feasible(runs, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low, feasible(runs, shards, low) or []


def numbered(df: DataFrame, part: list[str], order: list[Column], bucket: Column, buckets: int, out: str) -> DataFrame:
    """df with `out`: the row's place from 0 among the rows of equal `part`, by bucket, then order. No task gets more than a bucket."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most (values of part) x buckets rows.
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(p).alias(f"_p_{p}") for p in part], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*part, "_bucket").orderBy(*order)
    df = df.withColumn("_rn", F.row_number().over(inside))
    on = F.col("_bucket") == F.col("_b")
    for p in part:
        on = on & (F.col(p) == F.col(f"_p_{p}"))
    df = df.join(F.broadcast(starts) if buckets <= 100_000 else starts, on)
    return df.withColumn(out, F.col("_start") + F.col("_rn") - 1).drop("_bucket", "_rn", "_b", "_start", *[f"_p_{p}" for p in part])


def hex_bucket(digest: Column, buckets: int) -> Column:
    """Bucket of a hex digest: in proportion to its first 32 bits, so buckets follow the digests' order."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * buckets / F.lit(2.0**32)).cast("int")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null" + "0" * 28)).alias("digest"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    rows = materialise(measured(docs))
    total = rows.count()
    groups = rows.groupBy("digest").agg(F.sum("size").alias("gsize"), F.count(F.lit(1)).alias("n"))
    # A null text's digest isn't hexadecimal; it gets the place of the digest of all zeros.
    groups = materialise(groups.withColumn("place", F.when(F.col("digest").startswith("null"), F.lit("0" * 32)).otherwise(F.col("digest"))))
    runs = [(r["gsize"], r["n"]) for r in groups.groupBy("gsize").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("gsize")).collect()]
    _, cuts = minimax_cuts(runs, shards)
    buckets = max(1, total // BUCKET_ROWS)
    split = sorted({runs[i][0] for i, rank in cuts if rank > 0})
    whole, ranked = groups.filter(~F.col("gsize").isin(split)), groups.filter(F.col("gsize").isin(split))
    whole = whole.withColumn("rank", F.lit(0).cast("long"))
    ranked = numbered(ranked, ["gsize"], [F.col("place"), F.col("digest")], hex_bucket(F.col("place"), buckets), buckets, "rank") if split else whole.limit(0)
    placed = whole.unionByName(ranked.select(whole.columns))
    number = F.lit(0)
    for i, rank in cuts:
        at = runs[i][0]
        number = number + F.when((F.col("gsize") < at) | ((F.col("gsize") == at) & (F.col("rank") >= rank)), 1).otherwise(0)
    placed = placed.select("digest", "n", number.cast("int").alias("shard"))
    out = join_unique(rows, placed, "digest", "n", total)
    id_digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    order = [F.col("_idd"), F.col("doc_id"), F.col("digest")]
    out = numbered(out.withColumn("_idd", id_digest), ["shard"], order, hex_bucket(F.col("_idd"), buckets), buckets * shards, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


#: crc32 of a text in DuckDB, which has no such function: a fold over its bytes.
_CRC = f"CASE WHEN text IS NULL THEN 0 ELSE xor(list_reduce(list_transform(range(1, strlen(text) + 1), lambda i: CAST(('0x' || substr(hx, 2 * i - 1, 2)) AS BIGINT)), lambda a, x: xor(a >> 8, {_crc_table()}[(xor(a, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) END"

ORACLE = f"""
WITH RECURSIVE r AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, text, hex(encode(coalesce(text, ''))) AS hx, CASE WHEN text IS NULL THEN 'null0000000000000000000000000000' ELSE md5(text) END AS digest FROM documents),
g AS (SELECT digest, CAST(sum(size) AS BIGINT) AS gsize FROM r GROUP BY digest),
o AS (SELECT digest, gsize, row_number() OVER (ORDER BY gsize DESC, CASE WHEN digest LIKE 'null%' THEN repeat('0', 32) ELSE digest END, digest) AS i FROM g),
l AS (SELECT list(gsize ORDER BY i) AS sizes, CAST(sum(gsize) AS BIGINT) AS total, max(gsize) AS most FROM o),
s AS (SELECT greatest((total + 7) // 8, most) AS low, total AS high, sizes FROM l
  UNION ALL SELECT CASE WHEN used > 8 THEN middle + 1 ELSE low END, CASE WHEN used > 8 THEN high ELSE middle END, sizes FROM (
    SELECT *, list_reduce(sizes, lambda a, x: CASE WHEN (a % 1000000000000) + x <= middle THEN a + x ELSE (a // 1000000000000 + 1) * 1000000000000 + x END, CAST(0 AS BIGINT)) // 1000000000000 + 1 AS used
    FROM (SELECT *, (low + high) // 2 AS middle FROM s WHERE low < high))),
c AS (SELECT low AS capacity FROM s WHERE low = high LIMIT 1),
w AS (SELECT i, gsize AS room, 0 AS shard FROM o WHERE i = 1
  UNION ALL SELECT o.i, CASE WHEN w.room + o.gsize <= (SELECT capacity FROM c) THEN w.room + o.gsize ELSE o.gsize END, CASE WHEN w.room + o.gsize <= (SELECT capacity FROM c) THEN w.shard ELSE w.shard + 1 END FROM w JOIN o ON o.i = w.i + 1),
p AS (SELECT r.*, {_CRC} AS text_crc32, w.shard FROM r JOIN o USING (digest) JOIN w USING (i))
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, digest) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""
