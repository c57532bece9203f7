"""Quality scores by compression: zstandard dictionaries from good and from bad labelled text.

A text is cut into blocks, each is compressed with either dictionary, and the difference of the summed sizes over
the text's length becomes a score through a logistic curve fitted on labelled texts that made no dictionary.
Every block of a text counts, so a long text is scored as a whole and in bounded memory.

Limit of what is learned from (documented parameters, for the classifier alone): about SAMPLE labelled texts a class; of
each, SEGMENTS segments of SEGMENT bytes, evenly spread from its first to its last (all, if it has no more), so that a few
very long texts don't fill the dictionaries. What is scored, and what calibrates, is read whole.

Defined results. Null and empty texts: the score at difference 0. Labels of one class or none: score 1 (only good),
0 (only bad) or 0.5. A score of exactly THRESHOLD counts as good. Repeated rows and null ids: each row by itself. A long
text costs time in proportion to its length. Extra columns, of any name, are left aside. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import fit_platt, id_crc, labelled_sample, logistic

SAMPLE = 2500
DICT_BYTES, SEGMENT, SEGMENTS, BLOCK, LEVEL = 112_640, 1024, 8, 2048, 3
THRESHOLD = 0.5


def make_dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; the samples themselves where there are too few to train."""
    import zstandard

    pieces = []
    for t in texts:
        e = t.encode("utf-8", "surrogatepass")
        n = -(-len(e) // SEGMENT)
        chosen = range(n) if n <= SEGMENTS else [k * (n - 1) // (SEGMENTS - 1) for k in range(SEGMENTS)]
        pieces += [e[i * SEGMENT : (i + 1) * SEGMENT] for i in chosen]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, pieces)) // 2)), pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICT_BYTES:] or b"\0" * 8


@lru_cache(maxsize=4)
def compressor(data: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False)


def difference(text: str | None, good: bytes, bad: bytes) -> float:
    e = (text or "").encode("utf-8", "surrogatepass")
    if not e:
        return 0.0
    g, b = compressor(good), compressor(bad)
    return sum(len(b.compress(e[i : i + BLOCK])) - len(g.compress(e[i : i + BLOCK])) for i in range(0, len(e), BLOCK)) / len(e)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict:
    rows = labelled_sample(docs, labels, label, sample)
    got = sorted((int(r["label"]), r["text"]) for r in rows.select("text", "label").distinct().collect())  # at most about 2 * sample texts, whole
    both = {k: [t for y, t in got if y == k] for k in (0, 1)}
    if not both[0] or not both[1]:
        return {"fixed": 1.0 if both[1] else 0.0 if both[0] else 0.5}
    # Two of three texts make the dictionaries, the third calibrates; with too few, all do both.
    take = lambda ts, third: [t for i, t in enumerate(ts) if (i % 3 == 2) == third] if len(ts) >= 6 else ts
    good, bad = make_dictionary(take(both[1], False)), make_dictionary(take(both[0], False))
    held = [(t, y) for y in (0, 1) for t in take(both[y], True)]
    a, b = fit_platt([difference(t, good, bad) for t, _ in held], [y for _, y in held], balanced=True)
    return {"good": good, "bad": bad, "a": a, "b": b}


def score(docs: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            texts = batch.column("text")
            if "fixed" in m:
                s = [m["fixed"]] * len(texts)
            else:
                s = [float(logistic(m["a"] * difference(t.as_py(), m["good"], m["bad"]) + m["b"])) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {out} double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, fit(docs, labels))
    return s.select("doc_id", (F.pmod(id_crc(), F.lit(3)) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
