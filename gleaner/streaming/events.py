"""Streaming forms: windows, deduplication in flight, and per-key state with a bounded size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.tables import shared_dir, table

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream; timestamps without zone are read as the session's, as watermarks need."""
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    files = spark.readStream.schema(schema).parquet(path) if _is_dir(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def place(spark: SparkSession) -> str:
    """A new folder in the one that executors share, for a sink and its checkpoint."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def finished(stream: DataFrame, mode: str, at: str | None = None) -> DataFrame:
    """Runs a stream to the end of what is there and gives its result: Parquet files beside a checkpoint, never rows in the driver.

    append: a file sink. complete: each batch replaces what the one before wrote. update: each batch adds its rows with
    its number, in `batch`, so that a reader may take the last of each key; a batch that runs again replaces its own.
    Started again at the same place, a stream goes on where it ended.
    """
    spark = stream.sparkSession
    at = at or place(spark)
    out = f"{at}/rows"

    def whole(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(out)

    def part(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    w = w.format("parquet").option("path", out) if mode == "append" else w.foreachBatch(whole if mode == "complete" else part)
    w.start().awaitTermination()
    if mode == "update":
        return spark.read.parquet(out)
    return spark.read.schema(stream.schema).parquet(out)


def last_of_each(updates: DataFrame, key: str) -> DataFrame:
    """The last update of each key, of all batches."""
    names = [c for c in updates.columns if c not in (key, "batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("_r")).select(key, "_r.*")


def tumbling(events: DataFrame, size: str) -> DataFrame:
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("most")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "most")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def in_flight(requests: DataFrame, key: str = "url", stale: str = "120 seconds") -> DataFrame:
    """One request a key while another is in flight: state is dropped when stale."""
    return requests.withWatermark("ts", stale).dropDuplicatesWithinWatermark([key])


def late_counts(events: DataFrame, late: str, size: str) -> DataFrame:
    """Windowed counts with a watermark, for append mode: each window once, when no later row can belong to it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "n")


def last_ema(events: DataFrame, alpha: float = 0.15) -> DataFrame:
    """(user_id, ema, n) from streaming state of two numbers a user."""

    def update(key, batches, state):
        import pandas as pd

        ema, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for x in rows["value"]:
            ema, n = (float(x) if n == 0 else ema + alpha * (float(x) - ema)), n + 1
        state.update((ema, n))
        yield pd.DataFrame({"user_id": [key[0]], "ema": [round(ema, 6)], "n": [n]})

    s = events.groupBy("user_id").applyInPandasWithState(update, "user_id long, ema double, n long", "ema double, n long", "update", "NoTimeout")
    return last_of_each(finished(s, "update"), "user_id")


def fan_out(stream: DataFrame, sinks: list, at: str | None = None) -> None:
    """Delivers each batch to all subscribers: functions (rows, batch number). The batch is read once; a batch that runs again comes with its number again."""

    def each(rows: DataFrame, number: int) -> None:
        rows.persist()
        for sink in sinks:
            sink(rows, number)
        rows.unpersist()

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{at or place(stream.sparkSession)}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def to_folder(path: str, make=lambda rows: rows):
    """A sink for fan_out: what `make` makes of a batch, in a folder of its own, so that running a batch again adds nothing."""

    def sink(rows: DataFrame, number: int) -> None:
        make(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def ttl_cache(requests: DataFrame, ttl_ms: int, key: str = "key") -> DataFrame:
    """(event_id, hit) of requests (key, ts, event_id): a hit if the entry is strictly younger than the time to live; a miss stores anew.

    State: one time a key, dropped by the event-time timeout once it can't be a hit any more. Requests of a batch are
    taken in the order of time.
    """
    kind = requests.schema[key].dataType.simpleString()

    def update(k, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        (stored,) = state.get if state.exists else (None,)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        hits = []
        for t in rows["ts"].astype("int64") // (1000 if rows["ts"].dt.unit == "us" else 1_000_000):
            hit = stored is not None and t - stored < ttl_ms
            stored = stored if hit else int(t)
            hits.append(hit)
        state.update((stored,))
        until = stored + ttl_ms
        if until > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(until)
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), key: k[0], "hit": hits})

    return requests.select(key, "ts", "event_id").withWatermark("ts", "1 hour").groupBy(key).applyInPandasWithState(update, f"event_id long, {key} {kind}, hit boolean", "stored long", "append", "EventTimeTimeout")


def stop_and_resume(spark: SparkSession, make, at: str | None = None) -> DataFrame:
    """Starts the stream that make() gives, stops it once a batch is through (pause, shutdown), and starts it again at its checkpoint (resume): each row comes once."""
    at = at or place(spark)
    stream = make()

    def start(trigger: dict):
        return stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(**trigger).start()

    running = start({"processingTime": "100 milliseconds"})
    running.processAllAvailable()
    running.stop()
    start({"availableNow": True}).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def cron_trigger(expression: str) -> dict:
    """The trigger of a cron expression of six fields (seconds first): `*/n` steps and stars become an interval; a fixed time is a run of what is there, for the scheduler that starts it."""
    fields = expression.split()
    if len(fields) != 6:
        raise ValueError("six fields are needed: second minute hour day month weekday")
    for field, unit in zip(fields, ("seconds", "minutes", "hours", "days"), strict=False):
        if field.startswith("*/") and field[2:].isdigit() and int(field[2:]):
            return {"processingTime": f"{int(field[2:])} {unit}"}
        if field == "*":
            return {"processingTime": f"1 {unit}"}
    return {"availableNow": True}
