"""Toxicity: a counterfactual-regularised linear classifier.

Features are the distinct lower-case words of a whole text, and for each first 4 and 6 letters of longer words the
logarithm of how many distinct words begin with them (inflected and compound insults share their stem). A logistic
model is trained by follow-the-regularised-leader (its L1 part leaves a short list of words). Each labelled text that
names an identity group is also taken with the terms swapped for others of their kind: the swapped text counts with
the same label, and the squared change of the score between the two is penalised, with its full gradient. So a word
that is toxic only by the company its group was labelled in gets no weight of its own, and neutral mentions of any
group score alike. Terms of no kind, and texts that name no group, are trained as in a plain logistic model.

The terms are a parameter (`identity`: kinds of words that may stand for each other; IDENTITY has some of four
languages). They count as themselves alone, not by their stems, so that a swap can level them.

Limits of what is learned from (documented parameters, for the classifier alone): about SAMPLE labelled texts a
class, of at most MAX_WORDS distinct words each, words in at least MIN_DF of them. The scale of the scores (Platt) is
fitted on one in APART of them under weights that the others gave; then all give the weights. Of fewer than 200 * APART
texts, all do both. All rows are scored, whole.

Defined results. Null and empty texts: the score of the intercept. Labels of one class or none: a fixed score
(1, 0, or 0 without any). Repeated rows and null ids: each row by itself. A score of exactly THRESHOLD counts as toxic.
A long text costs time and memory in proportion to its words. Extra columns, of any name, are kept by `keep_clean` and
left aside by `report`. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gleaner.llm.common import fit_platt, fresh, id_crc, labelled_sample, logistic

SAMPLE, MAX_WORDS, MIN_DF, EPOCHS = 2500, 20_000, 3, 4
ALPHA, BETA, L1, L2, SWAP, APART = 0.3, 1.0, 4.0, 1.0, 16.0, 5
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
#: Terms that name groups of people, by kind; one is swapped for another of its kind.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "arab", "european", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("woman", "man", "girl", "boy"), ("women", "men", "girls", "boys"), ("female", "male"),
    ("immigrant", "refugee", "foreigner", "migrant"), ("immigrants", "refugees", "foreigners", "migrants"),
    ("disabled", "blind", "deaf", "autistic"), ("elderly", "young"),
    ("mexican", "chinese", "indian", "russian", "german", "french", "spanish", "american", "nigerian", "turkish"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "catholique", "athée"), ("femme", "homme"), ("femmes", "hommes"), ("immigré", "réfugié", "étranger", "migrant"), ("noir", "blanc", "arabe", "asiatique"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "católico", "ateo"), ("mujer", "hombre"), ("mujeres", "hombres"), ("inmigrante", "refugiado", "extranjero", "migrante"), ("negro", "blanco", "árabe", "asiático"),
    ("muslim", "christ", "jude", "buddhist", "katholik", "atheist"), ("frau", "mann"), ("frauen", "männer"), ("einwanderer", "flüchtling", "ausländer"), ("schwarzer", "weißer", "araber", "asiate"),
)


PREFIXES = (4, 6)
TERMS = frozenset(t for kind in IDENTITY for t in kind)


def features(words, known=None, terms=TERMS) -> dict[str, float]:
    """Feature values of a set of words; only the `known` features, if given."""
    out = {w: 1.0 for w in words if known is None or w in known}
    n: Counter = Counter()
    longer = [w for w in words if w not in terms]  # a group's name counts as itself alone, so swaps can level it
    for k in PREFIXES:
        for w in longer:
            if len(w) > k and (known is None or w[:k] + "*" in known):
                n[w[:k] + "*"] += 1
    out.update((p, math.log2(1 + c)) for p, c in n.items())
    return out


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def swapped(words: set[str], others: dict[str, list[str]], rng) -> set[str]:
    """The words with every identity term swapped for another of its kind."""
    return {others[w][rng.integers(len(others[w]))] if others.get(w) else w for w in words}


def penalty(w, x, y, strength: float = SWAP):
    """strength * (score of x - score of y)^2 and its gradient by the weights w; x and y are rows of feature values."""
    p, q = logistic(w @ x), logistic(w @ y)
    return strength * (p - q) ** 2, 2 * strength * (p - q) * (p * (1 - p) * x - q * (1 - q) * y)


def row_of(words, vocab: dict[str, int], terms) -> tuple:
    """Places and values of a text's features, the intercept first."""
    import numpy as np

    pairs = sorted((vocab[w], u) for w, u in features(words, None, terms).items() if w in vocab)
    return np.array([0, *(i for i, _ in pairs)], np.int32), np.array([1.0, *(u for _, u in pairs)], np.float32)


def learn(rows: list[tuple[str, int]], identity, swap: float, epochs: int, rng) -> tuple:
    """(places of the features, weights) by follow-the-regularised-leader with the counterfactual penalty."""
    import numpy as np

    labels = [y for _, y in rows]
    terms = frozenset(t for kind in identity for t in kind)
    others: dict[str, list[str]] = {}
    for kind in identity:
        for t in kind:
            others[t] = sorted({*others.get(t, ()), *(u for u in kind if u != t)})
    df: Counter = Counter()
    for ws, _ in rows:
        df.update(features(ws.split(), None, terms).keys())
    vocab = {w: i + 1 for i, w in enumerate(sorted({w for w, n in df.items() if n >= min(MIN_DF, max(1, len(rows) // 4))} | terms))}
    x = [row_of(ws.split(), vocab, terms) for ws, _ in rows]  # compact arrays: the driver holds the sample's features
    named = {k: set(ws.split()) for k, (ws, _) in enumerate(rows) if swap and not terms.isdisjoint(ws.split())}
    z, n = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    l1 = np.full(len(vocab) + 1, L1)
    l1[0] = 0.0

    def weights(i):
        return np.where(np.abs(z[i]) <= l1[i], 0.0, -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    def update(i, g):
        w = weights(i)
        sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
        z[i] += g - sigma * w
        n[i] += g * g

    share = np.mean(labels)
    cost = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    for _ in range(epochs):
        for k in rng.permutation(len(x)):
            i, v = x[k]
            update(i, v * (cost[labels[k]] * (logistic(weights(i) @ v) - labels[k])))
            if k in named:
                j, u = row_of(swapped(named[k], others, rng), vocab, terms)
                update(j, u * (cost[labels[k]] * (logistic(weights(j) @ u) - labels[k])))
                both = np.union1d(i, j)
                a, b = np.zeros(len(both)), np.zeros(len(both))
                a[np.searchsorted(both, i)], b[np.searchsorted(both, j)] = v, u
                update(both, penalty(weights(both), a, b, swap)[1])
    return vocab, weights(np.arange(len(z)))


def train(rows: list[tuple[str, int]], identity=IDENTITY, swap: float = SWAP, epochs: int = EPOCHS) -> dict:
    """Word weights and intercept from (distinct words joined by blanks, label). swap: strength of the penalty; 0 leaves the swapped copies out too."""
    import numpy as np

    if len({y for _, y in rows}) < 2:
        return {"fixed": float(rows[0][1]) if rows else 0.0}
    rng = np.random.default_rng(11)
    terms = frozenset(t for kind in identity for t in kind)
    order = rng.permutation(len(rows))
    apart, most = [rows[k] for k in order[::APART]], [rows[k] for i, k in enumerate(order) if i % APART]
    enough = len(rows) >= 200 * APART and len({y for _, y in apart}) == len({y for _, y in most}) == 2
    vocab, w = learn(most if enough else rows, identity, swap, epochs, rng)
    held = apart if enough else rows
    raw = [float(w[i] @ u) for i, u in (row_of(ws.split(), vocab, terms) for ws, _ in held)]
    a, b = fit_platt(raw, [y for _, y in held], balanced=True)
    if enough:
        vocab, w = learn(rows, identity, swap, epochs, rng)
    return {"w": {t: float(a * w[i]) for t, i in vocab.items() if w[i]}, "b": float(a * w[0] + b), "terms": terms}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> dict:
    rows = labelled_sample(docs, labels, label, sample)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ws = [sorted(words_of(t.as_py())) for t in batch.column("text")]
            keep = [i for i, w in enumerate(ws) if len(w) <= MAX_WORDS]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(ws[i]) for i in keep], pa.string()), pa.array([batch.column("label")[i].as_py() for i in keep], pa.int32())], names=["words", "label"])

    got = rows.select("text", "label").mapInArrow(run, "words string, label int").distinct().collect()  # at most about 2 * sample rows
    return train(sorted((r["words"], r["label"]) for r in got))


def score_text(text: str | None, model: dict) -> float:
    if "fixed" in model:
        return model["fixed"]
    w = model["w"]
    return float(logistic(model["b"] + sum(w[t] * v for t, v in sorted(features(words_of(text), w, model["terms"]).items()))))


def score(docs: DataFrame, model: dict, columns: list[str] | None = None, out: str = "_score") -> DataFrame:
    """`columns` of every row (doc_id alone, if none are given) and its score as `out`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words that kept a weight; their number is bounded by the sample
    columns = columns or ["doc_id"]
    chosen = docs.select(*columns, *(["text"] if "text" not in columns else []))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            s = pa.array([score_text(t.as_py(), m) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), s], names=[*columns, out])

    return chosen.mapInArrow(run, StructType([*(chosen.schema[c] for c in columns), StructField(out, DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, fit(docs, labels))
    return s.select("doc_id", (F.pmod(id_crc(), F.lit(3)) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the model rejects."""
    (mark,) = fresh(docs, "score")
    return score(docs, fit(docs, labels), docs.columns, mark).filter(F.col(mark) < THRESHOLD).drop(mark)
