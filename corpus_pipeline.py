"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

Defined results, stage by stage. Null texts: not toxic (the score of the intercept), each alone among near-duplicates,
without a hit, without a secret, packed as an end mark. Empty texts: as any text; equal ones are copies, so one stays.
Repeated rows: one of them stays after the second stage. Null ids: rows like any other. Ties: a score of exactly the
threshold is toxic; of a class the row of the least id stays, then the least digest. Very long texts are read whole.
All stages but the last return the columns of documents, whatever further columns there are and however they are named.
An empty table stays empty. What a stage returns may still read tables in the shared folder, so write it before that
folder is cleared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontaminate, neardup, packing, secrets, toxicity
from gleaner.llm.common import findable, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model scores below its threshold. The model learns from the labelled rows of docs."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates."""
    findable(spark)
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark window occurs."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences."""
    findable(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: A trained model, hashed candidates and a tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
