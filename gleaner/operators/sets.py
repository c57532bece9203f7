"""Visited sets, seeds, spooled bodies and batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def seed(urls: DataFrame, path: str, key: str = "url") -> None:
    """Writes all seeds, one of each in any case of letters (the least text stays)."""
    urls.groupBy(F.lower(key).alias("_k")).agg(F.min(key).alias(key)).select(key).write.mode("overwrite").parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    """Leaves the table without rows."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def links(visited: DataFrame, key: str = "url") -> DataFrame:
    return visited.select(key).distinct()


def insert(visited: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    return links(visited.select(key).unionByName(new.select(key)), key)


def remove(visited: DataFrame, gone: DataFrame, key: str = "url") -> DataFrame:
    return links(visited, key).join(gone.select(key), key, "left_anti")


def chunks(rows: DataFrame, body: str, size: int, most: int | None = None) -> DataFrame:
    """rows without the body, with its chunks of `size` bytes: (number, chunk); the first `most` chunks alone, if given. An empty body has none."""
    b = F.col(body).cast("binary")
    n = F.ceil(F.octet_length(b) / size).cast("int")
    n = n if most is None else F.least(n, F.lit(most))
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    cut = rows.withColumn("number", F.explode(numbers)).withColumn("chunk", F.substr(b, F.col("number") * size + 1, F.lit(size)))
    return cut.drop(body)


def joined_chunks(pieces: DataFrame, key: str) -> DataFrame:
    """(key, body) of chunks, joined in order, and whether the whole is valid UTF-8: characters may lie across borders."""
    xs = F.array_sort(F.collect_list(F.struct("number", F.hex("chunk").alias("h"))))
    body = F.unhex(F.array_join(F.transform(xs, lambda x: x["h"]), ""))
    return pieces.groupBy(key).agg(body.alias("body")).withColumn("valid_utf8", F.is_valid_utf8(F.col("body").cast("string")))


def processed(rows: DataFrame, column: str, work: Callable, size: int = 100, out: str = "result", kind: str = "string") -> DataFrame:
    """rows with `out`: work(list of values) for batches of at most `size` values, in order within a task; a value whose work raises is dropped, as are its rows."""
    from collections.abc import Iterator

    from pyspark.sql.types import StructType, _parse_datatype_string

    names = rows.columns

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size].copy()
                try:
                    part[out] = work(list(part[column]))
                except Exception:  # one of them: each by itself
                    got = []
                    for v in part[column]:
                        try:
                            got.append((True, work([v])[0]))
                        except Exception:
                            got.append((False, None))
                    part = part[[ok for ok, _ in got]].copy()
                    part[out] = pd.Series([r for ok, r in got if ok], index=part.index, dtype=object)
                yield part[[*names, out]]

    return rows.mapInPandas(run, StructType([*rows.schema.fields, *_parse_datatype_string(f"{out} {kind}").fields]))


def capped_signature(signature: Column, body: Column, most: int = 16 * 1024 * 1024) -> Column:
    """The signature of a body of at most that many bytes; null beyond."""
    return F.when(F.octet_length(body) <= most, signature)


def prefetched(rows: DataFrame) -> DataFrame:
    """rows, kept by the executors (memory, then disk) from now on."""
    kept = rows.persist()
    kept.count()
    return kept


def scripted(rows: DataFrame, code: str, out: str = "result", kind: str = "string") -> DataFrame:
    """rows with `out`: what the caller's own Python code leaves in `result`, given a row's columns as names; null where it raises.

    There is no sandbox: the code runs in the Python workers with their rights, so it must be the caller's own. Each row
    has fresh names.
    """
    from collections.abc import Iterator

    from pyspark.sql.types import StructType, _parse_datatype_string

    names = rows.columns

    def run(batches: Iterator) -> Iterator:
        program = compile(code, "script", "exec")
        for b in batches:
            got = []
            for row in b.to_dict("records"):
                try:
                    exec(program, row)
                    got.append(row.get("result"))
                except Exception:
                    got.append(None)
            b = b.copy()
            b[out] = got
            yield b[[*names, out]]

    return rows.mapInPandas(run, StructType([*rows.schema.fields, *_parse_datatype_string(f"{out} {kind}").fields]))
