"""SimHash near-duplicates by random bit sampling.

1. Each text becomes its set of five-word shingles (lower-cased words; a shorter text is one shingle) and a SimHash of
   BITS bits over them. Texts of equal words have equal SimHashes; from here on each distinct SimHash goes once.
2. Each of several tables groups the SimHashes by `k` sampled coordinates. k grows with the logarithm of their number,
   so buckets of unrelated texts hold about BUCKET rows, and the tables follow k: a pair at the very threshold shares
   a bucket in one of them with probability RECALL.
3. A bucket beyond CAP rows is split by additional sampled bits, as often as RECALL asks for.
4. Distances are verified inside the bucket, on all bits: at most FAR of BITS places differ (a similarity of SIMILAR or
   more). Nothing else decides, and no pair is shuffled before it. A bucket gives a spanning forest of its links, so m
   near-copies cost m rows, not m * m / 2; texts already known to be of one class aren't compared again.
5. A group of near-copies may hold a third of all texts. A bounded sample finds such groups; a text near their leader
   is linked to it at once, and the group's rows in a bucket are spread over slices, each of which meets all other rows
   of the bucket. So no task holds a hot group, and no comparison is left out.
6. Classes are the connected components of the links (alternating stars, in the shared folder; nothing is collected).

The similarity is that of the method: the share of equal SimHash places, an estimate of 1 - angle / pi of the shingle
sets. 0.8 of it lies near a Jaccard similarity of 0.68, give or take 0.07 for the noise of BITS bits.

Defined results. Null text: alone. Texts without a word: copies where the text is equal. Repeated rows and null ids:
a row each; the class id is the least id of the class (null if all are). In `keep_one` the row of the least id stays
(of equal ids, the least text digest; of equal rows, one); rows of a class without ids: the least digest. Extra
columns, of any name, are kept by `keep_one`. A long text costs time and memory in proportion to its words. Ties of a
SimHash place (as many ones as zeros) are broken by a hash of the whole set. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import discard, fresh, join_unique, materialise

SHINGLE, SIMILAR, BITS, RECALL = 5, 0.8, 256, 0.99
FAR = int(BITS * (1 - SIMILAR) + 1e-9)
#: So many bits are compared first: unrelated rows differ in more than FAR of them, so all 256 are seldom looked at.
FIRST = 160
#: Keys that one task makes of its SimHashes: so many, about.
KEYS = 1_000_000
BUCKET, CAP, TILE, WIDE = 8192, 65_536, 256, 1024
#: Sample that tells hot groups: those of SHOWN or more of its members.
SAMPLE, SHOWN = 4096, 8
WORD = re.compile(r"[^\W_]+")
MASK = (1 << 64) - 1
SIMS = [f"s{j}" for j in range(BITS // 64)]


class WordHash(dict):
    """64-bit hashes of words, as bytes; a bounded table of those already met."""

    def __missing__(self, word: str) -> bytes:
        h = blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        if len(self) > 500_000:
            self.clear()
        self[word] = h
        return h


HASHES = WordHash()


def mixed(x, *seeds: int):
    """Hashes of x (64-bit words), a column for each seed."""
    import numpy as np

    x = x[:, None] + np.array([(seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & MASK for seed in seeds], np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(text: str):
    """(words, sorted distinct 64-bit shingle hashes)."""
    import numpy as np

    words = WORD.findall(text.lower())
    if not words:
        return words, np.zeros(0, np.uint64)
    a = np.frombuffer(b"".join(map(HASHES.__getitem__, words)), "<u8")
    n = min(SHINGLE, len(a))
    h = np.zeros(len(a) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + a[i : len(a) - n + 1 + i]
    h = mixed(h, n)[:, 0]
    h.sort()
    return words, h[np.append(True, h[1:] != h[:-1])]


def planes(sh):
    """BITS hash bits of each shingle, as BITS / 8 bytes."""
    import numpy as np

    return mixed(sh, *range(100, 100 + BITS // 64)).view(np.uint8).reshape(len(sh), BITS // 8)


def simhash(sh):
    """BITS bits as BITS / 8 bytes."""
    import numpy as np

    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(sh), 4080):  # in parts: a very long text takes no more memory
        part = np.unpackbits(planes(sh[at : at + 4080]), axis=1)
        for start in range(0, len(part), 255):  # as many as a byte can count
            ones += np.add.reduce(part[start : start + 255], axis=0, dtype=np.uint8)
    bits = 2 * ones > len(sh)
    if len(sh) % 2 == 0:
        ties = np.unpackbits(planes(np.bitwise_xor.reduce(sh)[None])[0]) == 1
        bits |= (2 * ones == len(sh)) & ties
    return np.packbits(bits.astype(np.uint8))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, raw (digest of the text) and key of every row: the SimHash; the digest for texts without words; null for null texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys = []
            for raw, t in zip(batch.column("raw"), batch.column("text"), strict=True):
                sh = shingles(t.as_py() or "")[1]
                keys.append(simhash(sh).tobytes() if len(sh) else raw.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("raw"), pa.array(keys, pa.binary())], names=["doc_id", "raw", "key"])

    return docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("raw"), "text").mapInArrow(run, f"doc_id {kind}, raw binary, key binary")


def design(n: int) -> tuple[int, int]:
    """Sampled coordinates a table, and tables, for n SimHashes."""
    k = max(1, math.ceil(math.log2(max(2, n) / BUCKET)))
    return k, repeats(k)


def repeats(k: int) -> int:
    """Tables of k sampled coordinates until a pair at distance FAR meets with probability RECALL."""
    together = math.comb(BITS - FAR, k) / math.comb(BITS, k)
    return math.ceil(math.log(1 - RECALL) / math.log(1 - together))


def distance(x, y):
    import numpy as np

    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def union(label, i, j):
    """Labels after joining i[n] with j[n] for all n, and which n did join two classes: a spanning forest. A label is the least in its class."""
    import numpy as np

    used, at = [], np.arange(len(i))
    while True:
        a, b = label[i[at]], label[j[at]]
        at, a, b = at[a != b], a[a != b], b[a != b]
        if not len(at):
            return label, np.concatenate(used) if used else at
        high, first = np.unique(np.maximum(a, b), return_index=True)
        used.append(at[first])
        parent = np.arange(int(label.max()) + 1)
        parent[high] = np.minimum(a, b)[first]
        while len(np.flatnonzero(parent != (up := parent[parent]))):
            parent = up
        label = parent[label]


def bucket_links(s, label=None, word: int = 0, seed: int = 1):
    """Spanning forest (positions i, j) of the pairs of s (rows of 64-bit words) within FAR, given that rows of equal labels are linked already."""
    import numpy as np

    m = len(s)
    label = np.arange(m) if label is None else np.unique(label, return_inverse=True)[1]
    out = []
    if m > CAP:
        # Additional bits: rows that agree in them form the smaller buckets, once for each of several choices of bits.
        bits = np.unpackbits(np.ascontiguousarray(s).view(np.uint8).reshape(m, -1), axis=1)
        rng, more = np.random.default_rng(seed), math.ceil(math.log2(m / CAP)) + 2
        for r in range(repeats(more)):
            key = bits[:, rng.choice(BITS, more, replace=False)] @ (1 << np.arange(more, dtype=np.int64))
            order = np.argsort(key, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                now = label[part]
                if now.min() < now.max():
                    i, j = tiles(s[part], now, (word + r) % s.shape[1])
                    label, used = union(label, part[i], part[j])
                    out.append(np.stack([part[i][used], part[j][used]]))
    else:
        out.append(np.stack(tiles(s, label, word)))
    found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return found[0], found[1]


def tiles(s, label, word: int):
    """The same, for a bucket of any size, by comparing tile by tile; tiles of one class are passed over.

    Of bits as +1 and -1 the inner product tells the distance; it is taken over FIRST bits, from `word` on. No pair is
    lost by that: what differs in more than FAR of them differs in more than FAR of all.
    """
    import numpy as np

    order = np.argsort(label, kind="stable")
    s, label, out = s[order], np.unique(label[order], return_inverse=True)[1], [np.zeros((2, 0), np.int64)]
    first = np.roll(s, -word, axis=1)[:, : -(-FIRST // 64)]
    signs = np.unpackbits(np.ascontiguousarray(first).view(np.uint8).reshape(len(s), -1), axis=1)[:, :FIRST].astype(np.float32)
    signs *= 2
    signs -= 1
    products = np.empty(min(TILE, len(s)) * min(WIDE, len(s)), np.float32)
    for at in range(0, len(s), TILE):
        for start in range(at, len(s), WIDE):
            a, b = label[at : at + TILE], label[start : start + WIDE]
            if a[0] == b[0] and (a == a[0]).all() and (b == b[0]).all():
                continue
            p = products[: len(a) * len(b)]
            np.dot(signs[at : at + TILE], signs[start : start + WIDE].T, out=p.reshape(len(a), len(b)))
            near = np.flatnonzero(p >= FIRST - 2 * FAR)
            if len(near):
                i, j = near // len(b) + at, near % len(b) + start
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                close = distance(s[i], s[j]) <= FAR
                label, used = union(label, i[close], j[close])
                out.append(np.stack([i[close][used], j[close][used]]))
    found = np.concatenate(out, axis=1)
    return order[found[0]], order[found[1]]


def longs(keys):
    """32-byte keys (an Arrow array) as rows of four 64-bit words."""
    import numpy as np

    return np.frombuffer(b"".join(k.as_py() for k in keys), np.uint64).reshape(-1, BITS // 64)


def blobs(s):
    """The other way."""
    import numpy as np
    import pyarrow as pa

    s = np.ascontiguousarray(s)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(s), [None, pa.py_buffer(s.tobytes())]).cast(pa.binary())


def hot_leaders(nodes: DataFrame, n: int, sample: int = SAMPLE, shown: int = SHOWN):
    """(words, group) of the leaders of groups that hold `shown` or more of a sample of about `sample` nodes; their balls cover those."""
    import numpy as np

    spread = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 40))
    few = nodes.filter(spread < math.ceil((1 << 40) * min(1.0, sample / max(1, n)))).select("key").orderBy("key").limit(2 * sample).collect()
    s = np.frombuffer(b"".join(bytes(r["key"]) for r in few), np.uint64).reshape(-1, BITS // 64)
    near = np.zeros((len(s), len(s)), bool)
    for i in range(len(s)):
        near[i] = distance(s[i], s) <= FAR
    left, chosen = np.ones(len(s), bool), []
    while len(s):
        degree = (near & left).sum(axis=1) * left
        best = int(np.argmax(degree))
        if degree[best] < shown:
            break
        chosen.append(best)
        left &= ~near[best]
    i, j = np.nonzero(near[np.ix_(chosen, chosen)])
    return s[chosen], union(np.arange(len(chosen)), i, j)[0]


def ball_of(s, leaders, group):
    """For each row of s: the position of a leader within FAR, or -1; and its group."""
    import numpy as np

    at = np.full(len(s), -1)
    for k in range(len(leaders) - 1, -1, -1):
        at[distance(s, leaders[k]) <= FAR] = k
    return at, np.where(at < 0, -1, np.append(group, -1)[at])


def links(nodes: DataFrame, n: int) -> DataFrame:
    """Verified links (a, b) of nodes (key: SimHashes, each once) that connect all classes."""
    k, tables = design(n)
    leaders, group = hot_leaders(nodes, n)

    def keys(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(17)
        sampled = [rng.choice(BITS, k, replace=False) for _ in range(tables)]
        weights = (1 << np.arange(k, dtype=np.int64))[::-1]
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                s = longs(batch.column("key").slice(at, 2000))
                ball = ball_of(s, leaders, group)[1].astype(np.int32)
                bits = np.unpackbits(s.view(np.uint8).reshape(len(s), -1), axis=1)
                key = np.stack([(bits[:, c] @ weights) | (t << 44) for t, c in enumerate(sampled)], 1)
                words = [pa.array(np.repeat(s[:, j].view(np.int64), tables)) for j in range(s.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(ball, tables)), *words], names=["bucket", "ball", *SIMS])

    def found(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def of(key, slot, ball, s):
            starts = np.flatnonzero((np.append(True, key[1:] != key[:-1])) | np.append(True, slot[1:] != slot[:-1]))
            a, b = [np.zeros((0, BITS // 64), np.uint64)], [np.zeros((0, BITS // 64), np.uint64)]
            for at, end in zip(starts, np.append(starts[1:], len(key)), strict=True):
                if end - at > 1:
                    part = s[at:end]
                    known = np.where(ball[at:end] >= 0, ball[at:end], np.arange(end - at) + len(leaders))
                    i, j = bucket_links(part, known, int(key[at] >> 44) % (BITS // 64))
                    a.append(part[i])
                    b.append(part[j])
            return pa.RecordBatch.from_arrays([blobs(np.concatenate(a)), blobs(np.concatenate(b))], names=["a", "b"])

        held: list = []  # (bucket, slot, ball, words) of the batches whose last bucket may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.stack([batch.column(c).to_numpy() for c in SIMS], 1).view(np.uint64)
            now = [batch.column("bucket").to_numpy(), batch.column("slot").to_numpy(), batch.column("ball").to_numpy(), s]
            held.append(now)
            if (now[0][-1], now[1][-1]) != (held[0][0][0], held[0][1][0]):
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = int(np.flatnonzero((whole[0] != now[0][-1]) | (whole[1] != now[1][-1]))[-1]) + 1
                yield of(*(x[:last] for x in whole))
                held = [[x[last:] for x in whole]]
        if held:
            yield of(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def to_leader(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            s = longs(batch.column("key"))
            at = ball_of(s, leaders, group)[0]
            yield pa.RecordBatch.from_arrays([blobs(s[at >= 0]), blobs(leaders[at[at >= 0]])], names=["a", "b"])

    def among(i: int, j: int) -> bool:
        return group[i] == group[j] and int(distance(leaders[i], leaders[j])) <= FAR

    # Enough tasks that none has to spill the many keys it makes.
    spread = nodes.select("key").repartition(max(nodes.sparkSession.sparkContext.defaultParallelism, math.ceil(n * tables / KEYS)), "key")
    keyed = spread.mapInArrow(keys, "bucket long, ball int, " + ", ".join(f"{c} long" for c in SIMS))
    slot = F.lit(0)
    if len(leaders):
        # Hot groups alone: their rows in a bucket beyond CAP are spread over slices, and all other rows of the bucket go to each.
        hot = keyed.filter("ball >= 0").groupBy("bucket", "ball").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CAP)
        hot = hot.groupBy("bucket").agg(F.max(F.struct("n", "ball")).alias("m")).select(F.col("bucket").alias("_b"), F.col("m.ball").alias("_ball"), F.ceil(F.col("m.n") / CAP).cast("int").alias("_slots"))
        if not (hot := materialise(hot)).isEmpty():
            keyed = keyed.join(hot, F.col("bucket") == F.col("_b"), "left")
            own = F.array(F.pmod(F.xxhash64(*SIMS), F.col("_slots")).cast("int"))
            slot = F.explode(F.when(F.col("_b").isNull(), F.array(F.lit(0))).when(F.col("ball") == F.col("_ball"), own).otherwise(F.sequence(F.lit(0), F.col("_slots") - 1)))
    keyed = keyed.select("bucket", slot.alias("slot"), "ball", *SIMS)
    out = keyed.repartition("bucket", "slot").sortWithinPartitions("bucket", "slot").mapInArrow(found, "a binary, b binary")
    if len(leaders):
        out = out.unionByName(nodes.select("key").mapInArrow(to_leader, "a binary, b binary"))
        near = [(bytearray(leaders[i].tobytes()), bytearray(leaders[j].tobytes())) for i in range(len(leaders)) for j in range(i) if among(i, j)]
        out = out.unionByName(nodes.sparkSession.createDataFrame(near, "a binary, b binary"))
    return out


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the links (a, b) but the roots; by alternating large and small stars.

    A root of many links is a hot key of the joins; the other side has one row for it, so adaptive execution splits it.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        old, edges = edges, materialise(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        discard(old)
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, raw (digest of the text), class_id and class_key of every row of docs; null texts have no class_key."""
    rows = materialise(sketched(docs))
    by_key = materialise(rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    nodes = by_key.filter(F.octet_length("key") == BITS // 8)
    found = materialise(links(nodes, nodes.count()))
    roots = components(found)
    discard(found)
    named = materialise(by_key.join(roots, F.col("key") == F.col("node"), "left").select("key", "least_id", "n", F.coalesce("root", "key").alias("class_key")))
    discard(by_key)
    ids = named.groupBy("class_key").agg(F.min("least_id").alias("class_id"), F.count(F.lit(1)).alias("keys"))
    named = join_unique(named, ids, "class_key", "keys", named.count())
    alone = rows.filter("key is null").select("doc_id", "raw", F.col("doc_id").alias("class_id"), F.lit(None).cast("binary").alias("class_key"))
    return join_unique(rows.filter("key is not null"), named, "key", "n", rows.count()).select("doc_id", "raw", "class_id", "class_key").unionByName(alone)


def report(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every row."""
    return classes(docs.select("doc_id", "text")).select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, and all rows whose text is null."""
    raw, kid, kraw, place = fresh(docs, "raw", "kid", "kraw", "place")
    c = materialise(classes(docs.select("doc_id", "text"))).filter("class_key is not null")
    first = c.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("raw"))).alias("k"))
    kept = materialise(first.select(F.col("k.doc_id").alias(kid), F.col("k.raw").alias(kraw)))
    marked = docs.withColumn(raw, F.unhex(F.md5(F.col("text").cast("binary"))))
    stay = marked.filter(F.col(raw).isNotNull()).join(kept, F.col("doc_id").eqNullSafe(F.col(kid)) & (F.col(raw) == F.col(kraw)), "left_semi")
    again = c.groupBy("doc_id", "raw").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(kept, F.col("doc_id").eqNullSafe(F.col(kid)) & (F.col("raw") == F.col(kraw)), "left_semi")
    if not again.isEmpty():  # equal rows: one of them
        stay = stay.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", raw).orderBy("doc_id"))).filter(F.col(place) == 1)
    return stay.select(docs.columns).unionByName(docs.filter(F.col("text").isNull()))
