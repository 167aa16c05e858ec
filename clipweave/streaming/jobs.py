"""Structured Streaming forms of the stateful operators: job state with heartbeats, sessions and windows over events."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key, closed by a gap: the streaming form of joining intervals across gaps."""
    g = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("s"))
    return g.agg(F.count(F.lit(1)).alias("events")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def windowed(stream: DataFrame, keys: list[str], ts: str, value: str, size: str, slide: str, late: str) -> DataFrame:
    """Counts and sums over sliding windows, with late rows up to the watermark."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide).alias("w"), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def chunks_once(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Idempotent writes: each key once within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def job_states(stream: DataFrame, stale_after_ms: int, late: str = "10 minutes") -> DataFrame:
    """The state of each job after its messages: job_id, status, beats, last_ms.

    Messages: job_id, ts, kind (claim, heartbeat, done). A running job that event time leaves without a sign of life for
    ``stale_after_ms`` fails by timeout. State per job is one small tuple.
    """

    def update(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, beats, last = state.get if state.exists else ("pending", 0, 0)
        if state.hasTimedOut:
            if status == "running":
                status = "failed"
            state.update((status, beats, last))
        else:
            for pdf in batches:
                for ts, kind in pdf.sort_values("ts")[["ts", "kind"]].itertuples(index=False):
                    ms = int(ts.timestamp() * 1000)
                    if kind == "claim" and status == "pending":
                        status = "running"
                    elif kind == "heartbeat" and status == "running":
                        if ms - last >= stale_after_ms:
                            status = "failed"
                        else:
                            beats += 1
                    elif kind == "done" and status == "running":
                        status = "done"
                    last = max(last, ms)
            state.update((status, beats, last))
            if status == "running" and last + stale_after_ms > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(last + stale_after_ms)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "beats": [beats], "last_ms": [last]})

    return (
        stream.withWatermark("ts", late).groupBy("job_id")
        .applyInPandasWithState(update, "job_id long, status string, beats long, last_ms long", "status string, beats long, last_ms long", "update", GroupStateTimeout.EventTimeTimeout)
    )


def run_to_table(stream: DataFrame, checkpoint: str, table_path: str, mode: str = "append") -> DataFrame:
    """Drains a stream into a Parquet table and reads it: each micro-batch is written under its number, so a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table_path)
