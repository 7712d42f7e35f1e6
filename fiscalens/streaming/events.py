"""Streams of events: hourly usage with late data, sessions, first sight of a key, keyed first and last sights, and upserts by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.storage import shared_dir
from ..sources import files

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(38,10)")).cast("double").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A user's events without a pause of ``gap``: user_id, started, ended (the last event plus the gap), events."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return grouped.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each key once, within the watermark: the state does not grow without bound."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sights(events: DataFrame, late: str = "2 hours", forget_days: int = 90) -> DataFrame:
    """By user the first and the last time and how many events so far, in update mode: a row for each batch that has events of the user.
    A user's state goes once the watermark is ``forget_days`` behind the last event."""
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last, n = state.get if state.exists else (None, None, 0)
        for f in frames:
            lo, hi = f["ts"].min(), f["ts"].max()
            first, last, n = (lo if first is None else min(first, lo)), (hi if last is None else max(last, hi)), n + len(f)
        state.update((first, last, n))
        state.setTimeoutTimestamp(int(last.timestamp() * 1000) + forget_days * 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "first_seen": [first], "last_seen": [last], "events": [n]})

    rows = "user_id long, first_seen timestamp, last_seen timestamp, events long"
    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(update, rows, "first timestamp, last timestamp, n long", "update", GroupStateTimeout.EventTimeTimeout)


def upsert_batches(stream: DataFrame, path: str, key: str, order: str, checkpoint: str):
    """A stream into the table at ``path`` by key: each batch's latest row of a key replaces the table's. Batches that come again change
    nothing."""
    rest = [c for c in stream.columns if c not in (key, order)]

    def put(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_r")).select(key, "_r.*")
        files.upsert(batch.sparkSession, latest, path, key)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a stream, be it one file or a folder of files, its times as instants of the session's zone."""
    one = spark.read.parquet(f"{sf_dir}/events.parquet").inputFiles()[0].endswith("/events.parquet")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reading = spark.readStream.schema(schema)
    stream = reading.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if one else reading.parquet(f"{sf_dir}/events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives for what is there now, as a table: of a complete result the last state, else the rows of all batches."""
    name = f"stream-{id(stream)}"
    folder = f"{shared_dir(spark)}/streams/{pd.Timestamp.now().value}-{name}"

    def put(batch: DataFrame, number: int) -> None:  # a batch that is tried again replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


def finished_table(spark: SparkSession, start: Callable[[str, str], object]) -> DataFrame:
    """The table that a stream's writer (of path and checkpoint folder) leaves by upserts."""
    folder = f"{shared_dir(spark)}/streams/{pd.Timestamp.now().value}-table"
    start(f"{folder}/out", f"{folder}/state").awaitTermination()
    return files.current(spark, f"{folder}/out")
