"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def findable(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it (on a cluster: the shared install, or --py-files)."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    now = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in now.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (here, now) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    findable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names of helper columns that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"_{name}".lower() in taken:
            name += "_"
        taken.add(f"_{name}".lower())
        out.append(f"_{name}")
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (only where that is unset and all runs on one machine, as in tests) one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = os.path.join(tempfile.gettempdir(), f"gleaner-{os.getpid()}")
        os.makedirs(found, exist_ok=True)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_crc(col: str | Column = "doc_id") -> Column:
    """crc32 of the id written as text; null ids count as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def bounded_sample(rows: DataFrame, key: Column, counts: dict, bound: int, class_col: str) -> DataFrame:
    """About `bound` rows of each class at most, chosen by a hash of the key: the same ones however the rows lie."""
    keep = F.lit(False)
    spread = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_000))
    for value, n in counts.items():
        keep = keep | ((F.col(class_col) == F.lit(value)) & (spread < int(1_000_000 * min(1.0, bound / max(1, n)))))
    return rows.filter(keep)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, mod: int = 3, out: int = 1) -> DataFrame:
    """(doc_id, text, label) of labelled documents whose id_crc mod `mod` is not `out`, about `bound` a class at most.

    Labels other than 0 and 1 and null ids don't count; the sampled labels (at most about 2 * bound) are broadcast.
    """
    marked = labels.select(F.col("doc_id").alias("_lid"), F.col(label).cast("int").alias("label")).filter("_lid is not null and label in (0, 1)")
    marked = marked.filter(F.pmod(id_crc("_lid"), F.lit(mod)) != out).distinct()
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = bounded_sample(marked, F.col("_lid"), counts, bound, "label")
    return docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_lid")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")


def logistic(x):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_platt(x, y, balanced: bool = False, steps: int = 200) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (x, y), by Newton's method with a slight ridge."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) if balanced and 0 < y.mean() < 1 else np.ones_like(y)
    for _ in range(steps):
        p = logistic(a @ w)
        g = a.T @ (weight * (p - y)) + 1e-3 * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        d = np.linalg.solve(h, g)
        w = w - d * min(1.0, 5.0 / (np.abs(d).max() + 1e-12))
        if np.abs(d).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def discard(df: DataFrame) -> None:
    """Delete a table of materialise() that nothing depends on any more."""
    jvm, path = df.sparkSession.sparkContext._jvm, df.inputFiles()
    if path:
        folder = jvm.org.apache.hadoop.fs.Path(path[0]).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: A key with more than 1/HEAVY of all rows is heavy.
HEAVY = 1000


def join_unique(rows: DataFrame, unique: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of rows with one row a key. Keys with more than 1/HEAVY of all rows (so fewer than HEAVY) are broadcast, the others shuffled."""
    columns = [c for c in unique.columns if c not in (key, count)]
    heavy = unique.filter(F.col(count) * HEAVY > total).select(F.col(key).alias("_hk"), F.struct(*columns).alias("_hv"))
    first = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    hot = first.filter("_hk is not null").select(*rows.columns, *[F.col(f"_hv.{c}").alias(c) for c in columns])
    cold = first.filter("_hk is null").drop("_hk", "_hv").join(unique.filter(F.col(count) * HEAVY <= total), key)
    return hot.unionByName(cold.select(*rows.columns, *columns))
