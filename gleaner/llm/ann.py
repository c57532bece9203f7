"""Approximate nearest neighbours by additive quantisation; nearness is the inner product.

Codebooks: LEVELS books of up to WORDS full-dimensional words (16 bytes a vector). They begin as residual k-means and are then refitted
together (beam-search codes, joint least squares) on a bounded sample of SAMPLE vectors. Every valid vector is
encoded by beam search and stored with its codes and the ratio of its norm to that of its reconstruction.

The lookup tables decide which vectors of the whole table get an exact score: those whose score by table reaches the
query's threshold. A held-out sample of HELD vectors, encoded like all others, sets it: on queries of that sample the
depth is measured to which the ranking by table must be read to hold FOUND of the true nearest, and a query's threshold
is its score by table at that depth (and a margin) of the held-out vectors. So the share of vectors that is scored
exactly is about the same at every size, and small where the codes are good. Vectors are kept in lists (nearest coarse
centre, about LIST or more a list); how many lists a query looks into is measured on the same sample (SEEN of the true
nearest must lie in them). Vectors without clusters need many lists, clustered ones few; nothing else sets the number.
What reaches the threshold is reranked by the exact inner product of the original vectors, in double precision.

A list is cut into blocks of at most about BLOCK vectors and its queries likewise, so neither a hot list nor many
queries gather in one task; a task holds one block of either. Queries are a stated set; no pair of rows is shuffled.

Defined results. Vectors that are null, zero, of another dimension than most, or hold null or non-finite components,
and rows with null ids, take no part. "Own row" means: equal vec_id. Repeated rows: each is a candidate of its own.
Ties go to the smaller vec_id. Fewer candidates than TOP: all of them. Extra columns are left aside. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import materialise

LEVELS, WORDS, BEAM, ROUNDS = 16, 256, 4, 1
SAMPLE, HELD, LIST, BLOCK, QUERY_BLOCK, TOP = 8192, 4096, 2048, 8192, 2048, 20
#: Shares of the true nearest of held-out queries that must lie within the depth, and in the lists, that are looked at.
FOUND, SEEN = 0.97, 0.97


def one_hot(codes, k: int):
    import numpy as np

    out = np.zeros((len(codes), k))
    out[np.arange(len(codes)), codes] = 1.0
    return out


def kmeans(x, k: int, rng, steps: int = 8):
    import numpy as np

    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        n = np.bincount(near, minlength=k)
        s = one_hot(near, k).T @ x
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def encode(x, books, beam: int = BEAM):
    """Codes (n, levels) by beam search over full-dimensional books: the sums with the least squared error that the beam finds."""
    import numpy as np

    n, levels, k = len(x), len(books), books.shape[1]
    x, flat = x.astype(np.float32), books.reshape(levels * k, -1).astype(np.float32)
    gram = 2 * (flat @ flat.T)
    dots = 2 * (x @ flat.T).reshape(n, levels, k)
    norms = np.diag(gram).reshape(levels, k) / 2
    codes = np.zeros((n, 1, 0), np.int64)
    cost = np.zeros((n, 1), np.float32)
    for m in range(levels):
        total = cost[:, :, None] + (norms[m] - dots[:, m])[:, None, :]
        block = gram[:, m * k : (m + 1) * k]
        for j in range(m):
            total += block[j * k + codes[:, :, j]]
        total = total.reshape(n, -1)
        keep = min(beam, total.shape[1])
        best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
        cost = np.take_along_axis(total, best, 1)
        codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]], 2)
    return codes[np.arange(n), np.argmin(cost, axis=1)]


def decode(codes, books):
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def train(x, lists: int, seed: int = 3) -> dict:
    """Books and coarse centres from a sample."""
    import numpy as np

    rng = np.random.default_rng(seed)
    k = max(1, min(WORDS, len(x)))
    rest, books = x.copy(), []
    for _ in range(LEVELS):
        c = kmeans(rest, k, rng)
        books.append(c)
        rest = rest - c[np.argmin((c * c).sum(1) - 2 * (rest @ c.T), axis=1)]
    books = np.stack(books)
    for _ in range(ROUNDS):
        gram, right = 1e-3 * len(x) / k * np.eye(LEVELS * k), np.zeros((LEVELS * k, x.shape[1]))
        for at in range(0, len(x), 1024):  # in blocks: the driver's memory is bounded
            part = x[at : at + 1024]
            codes = encode(part, books)
            chosen = np.concatenate([one_hot(codes[:, a], k) for a in range(LEVELS)], axis=1)
            gram, right = gram + chosen.T @ chosen, right + chosen.T @ part
        books = np.linalg.solve(gram, right).reshape(books.shape)
    return {"books": books, "centres": kmeans(x, lists, rng)}


def list_count(n: int) -> int:
    return max(1, min(4096, n // LIST, round(math.sqrt(n) / 4)))


def rough(q, books, codes, ratio):
    """Scores by lookup table: one table of inner products a book and query, added up along the codes, times the norm ratio."""
    import numpy as np

    out = np.zeros((len(q), len(codes)), np.float32)
    for m, book in enumerate(books):
        out += (q @ book.T).astype(np.float32)[:, codes[:, m]]
    return out * ratio.astype(np.float32)


def norm_ratio(v, codes, books):
    import numpy as np

    norm = np.linalg.norm(decode(codes, books), axis=1)
    return np.linalg.norm(v, axis=1) / np.where(norm > 0, norm, 1.0)


def calibrate(model: dict, held, n: int, top: int, queries: int = 512) -> dict:
    """Adds the held-out codes, the depth among them and the number of lists, both measured, to the model."""
    import numpy as np

    books, c = model["books"], model["centres"]
    codes = np.concatenate([encode(held[at : at + 1024], books) for at in range(0, len(held), 1024)])
    ratio = norm_ratio(held, codes, books)
    near = np.argmin((c * c).sum(1) - 2 * (held @ c.T), axis=1)
    nearest = max(1, round(top * len(held) / n))  # as far out in the held-out sample as `top` is in the whole
    depths, places = [], []
    for at in range(0, min(queries, len(held)), 128):
        q = held[at : at + 128]
        exact, table = q @ held.T, rough(q, books, codes, ratio)
        own = np.arange(at, at + len(q))
        exact[np.arange(len(q)), own] = table[np.arange(len(q)), own] = -np.inf
        best = np.argpartition(-exact, min(nearest, len(held)) - 1, axis=1)[:, :nearest]
        order = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
        for k in range(len(q)):
            depths += [int((table[k] > table[k, i]).sum()) + 1 for i in best[k] if i != own[k]]
            places += [int(order[k, near[i]]) + 1 for i in best[k] if i != own[k]]
    deep = math.ceil(1.25 * float(np.quantile(depths, FOUND))) + 2 if depths else len(held)
    deep = max(deep, math.ceil(3 * top * len(held) / n) + 8)  # enough for `top` of them, with room for chance
    probes = math.ceil(float(np.quantile(places, SEEN))) if places else len(c)
    return model | {"held": codes.astype(np.uint8), "ratio": ratio, "depth": deep, "probes": min(len(c), probes)}


def threshold(q, model: dict):
    """The score by table that a vector needs, for each query: the best but `depth` of the held-out vectors (one more, as the query may be among them)."""
    import numpy as np

    if model["depth"] + 1 >= len(model["held"]):
        return np.full(len(q), -np.inf)
    return -np.partition(-rough(q, model["books"], model["held"], model["ratio"]), model["depth"], axis=1)[:, model["depth"]].astype(float)


def valid(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("v") == (dims["d"] if dims else 0))


def model_of(rows: DataFrame, n: int, top: int = TOP) -> dict:
    """Books, centres, depth and probes from a sample of about SAMPLE + HELD of the n rows, chosen by a hash."""
    import numpy as np

    spread = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1_000_000))
    sample = rows.filter(spread < math.ceil(1_000_000 * min(1.0, (SAMPLE + HELD) / n))).select("vec_id", "v", spread.alias("at")).orderBy(F.hash("at"), "vec_id").limit(2 * (SAMPLE + HELD)).collect()
    x = np.array([r["v"] for r in sample] or [rows.first()["v"]])
    held = min(len(x), HELD)  # what trains the books is apart from it where there is enough
    return calibrate(train(x[held:] if len(x) - held >= held else x, list_count(n)), x[:held], n, top)


def search(vectors: DataFrame, every: int = 20, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for the queries: rows whose vec_id is divisible by `every`."""
    import numpy as np

    spark = vectors.sparkSession
    rows = materialise(valid(vectors))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(model_of(rows, n, top))  # LEVELS * WORDS words, at most 4096 centres, HELD codes: bounded

    def encoded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        c = m["centres"]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v = np.stack(part.column("v").to_numpy(zero_copy_only=False))
                codes = encode(v, m["books"])
                near = np.argmin((c * c).sum(1) - 2 * (v @ c.T), axis=1)
                ratio = norm_ratio(v, codes, m["books"])
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), part.column("vec_id"), pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary()), pa.array(ratio), part.column("v")], names=["list", "vec_id", "codes", "ratio", "v"])

    def probed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        c, probes = m["centres"], m["probes"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                v = np.stack(part.column("v").to_numpy(zero_copy_only=False))
                best = np.argpartition(-(v @ c.T), probes - 1, axis=1)[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(threshold(v, m)), pa.array(list(best), pa.list_(pa.int32()))], names=["query_id", "q", "least", "lists"])

    index = materialise(rows.mapInArrow(encoded, "list int, vec_id long, codes binary, ratio double, v array<double>"))
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(probed, "query_id long, q array<double>, least double, lists array<int>")
    queries = materialise(queries.select("query_id", "q", "least", F.explode("lists").alias("list")))
    # Blocks of each list: at most 4096 lists, so these counts are small.
    sizes = index.groupBy("list").agg(F.count(F.lit(1)).alias("vn")).join(queries.groupBy("list").agg(F.count(F.lit(1)).alias("qn")), "list")
    sizes = F.broadcast(sizes.select("list", F.ceil(F.col("vn") / BLOCK).cast("int").alias("vb"), F.ceil(F.col("qn") / QUERY_BLOCK).cast("int").alias("qb")))
    left = index.join(sizes, "list").withColumn("vblock", F.pmod(F.xxhash64("vec_id", "codes"), F.col("vb")).cast("int")).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).drop("vb", "qb")
    right = queries.join(sizes, "list").withColumn("qblock", F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int")).withColumn("vblock", F.explode(F.sequence(F.lit(0), F.col("vb") - 1))).drop("vb", "qb")
    key = ["list", "vblock", "qblock"]

    def score(vs, qs):
        import pandas as pd

        if not len(vs) or not len(qs):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        books = shared.value["books"]
        v, q = np.stack(vs["v"].to_numpy()), np.stack(qs["q"].to_numpy())
        codes = np.frombuffer(b"".join(vs["codes"]), np.uint8).reshape(len(vs), -1)
        ids, ratio, qids, least = vs["vec_id"].to_numpy(), vs["ratio"].to_numpy(), qs["query_id"].to_numpy(), qs["least"].to_numpy()
        out = []
        for at in range(0, len(q), 128):
            part, own = q[at : at + 128], qids[at : at + 128]
            i, j = np.nonzero((rough(part, books, codes, ratio) >= least[at : at + 128, None]) & (own[:, None] != ids[None, :]))
            exact = np.zeros(len(i))
            for d in range(v.shape[1]):  # one dimension after another: the sum that a plain loop gives
                exact += part[i, d] * v[j, d]
            order = np.lexsort((ids[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "score": exact})[place < top])
        return pd.concat(out, ignore_index=True)

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(score, "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
