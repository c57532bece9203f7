"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties (L1 keeps the weights sparse, L2 small), then
calibrated by one temperature on rows kept apart. n-grams of 1 to 3 letters, words framed by a space, are hashed
into DIMS places; letters are lower-cased, everything else is a space. Document frequencies are counted over all
rows that may be learned from; the weights are fitted on about SAMPLE of them a language (a documented bound of
the classifier), for all languages there are; the driver holds a few times DIMS x languages numbers. Whole texts are
read everywhere.

Defined results. Null texts and texts without a letter: `und`, score 0. No row to learn from: `und`, score 0 for
all. Ties go to the language that sorts first. Null lang: not learned from. Repeated rows and null ids: each row by
itself. A long text costs time and memory in proportion to its length. Extra columns, of any name, are left aside.
Empty table: no rows. A lang column of more than MOST_LANGS values is an error, as it can't name languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_sample, id_crc

BITS, ORDERS = 14, (1, 2, 3)
DIMS = 1 << BITS
SAMPLE, MOST_LANGS, EPOCHS = 400, 8192, 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.02
MOD, OUT = 5, 0


@lru_cache(maxsize=1)
def letters():
    """For each code point below 0x33500 (no letters beyond): whether it is a letter."""
    import numpy as np

    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x33500)])


def grams(text: str | None):
    """Counts of the hashed n-grams of a text: DIMS numbers; None without a letter."""
    import numpy as np

    if not text:
        return None
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = letters()
    is_letter = table[np.minimum(a, len(table) - 1)]
    if not is_letter.any():
        return None
    a = np.concatenate([[32], np.where(is_letter, a, 32), [32]]).astype(np.uint64)
    space = a == 32
    keep = ~(space[1:] & space[:-1])  # of several spaces one stays
    a = a[np.concatenate([[True], keep])]
    total = np.zeros(DIMS, np.int64)
    for n in ORDERS:
        if len(a) < n:
            continue
        h = np.zeros(len(a) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + a[i : len(a) - n + 1 + i] + np.uint64(n)
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        if n == 1:
            h = h[a != 32]
        total += np.bincount(h.astype(np.int64), minlength=DIMS)
    return total


def vector(counts, idf):
    """Places and unit-length TF-IDF values."""
    import numpy as np

    i = np.flatnonzero(counts)
    x = np.log1p(counts[i]) * idf[i]
    return i, x / (np.sqrt((x * x).sum()) or 1.0)


def softmax(z):
    import numpy as np

    e = np.exp(z - z.max())
    return e / e.sum()


def train(rows: list, langs: list[str], idf, epochs: int = EPOCHS) -> dict:
    """Weights and temperature from (places, values, language number); every fifth row calibrates."""
    import numpy as np

    k = len(langs)
    z, n = np.zeros((DIMS + 1, k)), np.zeros((DIMS + 1, k))
    l1 = np.full((DIMS + 1, 1), L1)
    l1[DIMS] = 0.0

    def weights(i):
        return np.where(np.abs(z[i]) <= l1[i], 0.0, -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rng = np.random.default_rng(5)
    order = rng.permutation(len(rows))
    apart = set(order[: len(rows) // 5].tolist()) if len(rows) >= 5 * k else set()
    learn = [j for j in order if j not in apart]
    for _ in range(epochs):
        for j in rng.permutation(learn):
            i, x, y = rows[j]
            i, x = np.append(i, DIMS), np.append(x, 1.0)
            w = weights(i)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(DIMS + 1))
    logits = [(np.append(x, 1.0) @ w[np.append(i, DIMS)], y) for i, x, y in (rows[j] for j in (apart or learn))]

    def loss(t: float) -> float:
        return -sum(float(np.log(softmax(s / t)[y] + 1e-300)) for s, y in logits)

    grid = [2.0 ** (e / 4) for e in range(-16, 17)]
    return {"langs": langs, "w": w, "idf": idf, "t": min(grid, key=loss)}


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    rows = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null").filter(F.pmod(id_crc(), F.lit(MOD)) != OUT)

    def frequencies(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        df, seen = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for t in batch.column("text"):
                c = grams(t.as_py())
                if c is not None:
                    df += c > 0
                    seen += 1
        i = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(df[i], seen))], names=["place", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # at most DIMS + 1 rows
    by_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()
    if len(by_lang) > MOST_LANGS:
        raise ValueError(f"lang has more than {MOST_LANGS} values")
    if not by_lang:
        return None
    import numpy as np

    seen = max(1, sum(r["n"] for r in counted if r["place"] < 0))
    df = np.zeros(DIMS)
    for r in counted:
        if r["place"] >= 0:
            df[r["place"]] = r["n"]
    idf = np.log((1 + seen) / (1 + df)) + 1
    langs = sorted(r["lang"] for r in by_lang)
    few = bounded_sample(rows, F.col("doc_id"), {r["lang"]: r["n"] for r in by_lang}, sample, "lang")

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [(c, lang.as_py()) for c, lang in ((grams(t.as_py()), lang) for t, lang in zip(batch.column("text"), batch.column("lang"), strict=True)) if c is not None]
            places = [np.flatnonzero(c).astype(np.int32) for c, _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.list_(pa.int32())), pa.array([c[i].astype(np.int32) for (c, _), i in zip(out, places, strict=True)], pa.list_(pa.int32())), pa.array([lang for _, lang in out], pa.string())], names=["i", "c", "lang"])

    got = few.select("text", "lang").mapInArrow(encode, "i array<int>, c array<int>, lang string").collect()  # about sample * languages rows at most
    got.sort(key=lambda r: (r["lang"], r["i"], r["c"]))
    vectors = []
    for r in got:
        c = np.zeros(DIMS)
        c[r["i"]] = r["c"]
        vectors.append((*vector(c, idf), langs.index(r["lang"])))
    return train(vectors, langs, idf) if vectors else None


def predict_text(text: str | None, model: dict | None) -> tuple[str, float]:
    import numpy as np

    c = grams(text) if model else None
    if c is None:
        return "und", 0.0
    i, x = vector(c, model["idf"])
    p = softmax((x @ model["w"][i] + model["w"][DIMS]) / model["t"])
    k = int(np.argmax(p))
    return model["langs"][k], float(p[k])


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x languages numbers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [predict_text(t.as_py(), shared.value) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    p = predict(docs, fit(docs))
    return p.select("doc_id", (F.pmod(id_crc(), F.lit(MOD)) == OUT).alias("held_out"), "lang_pred", "score")
