"""Debounced file events and the syncs they start.

An event is (path, op, ts). A file source never emits a changed file again and sees no deletes, so events come from an
append-only change log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.globs import markdown_event
from ..operators import diff

EVENT = "path string, op string, ts timestamp"


def read_log(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """Events of an append-only log of parquet files, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def wanted(events: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    return events.where(markdown_event(F.col("path"), ignore or []))


def debounce(events: DataFrame, idle: str = "5 seconds", key: str = "path", ts: str = "ts") -> DataFrame:
    """A row per burst of a key's events: first and last time, count, and the last operation. Bursts are apart by more than
    ``idle``; events exactly so far apart are one burst. Batch or stream; a stream needs a watermark."""
    s = F.session_window(F.col(ts), idle)
    return events.groupBy(key, s.alias("burst")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("events"), F.max_by("op", ts).alias("op")).drop("burst")


def debounce_stream(events: DataFrame, idle: str = "5 seconds", late: str = "5 seconds", key: str = "path", ts: str = "ts") -> DataFrame:
    """As ``debounce``, with a watermark: a burst comes out once no event can join it."""
    return debounce(events.withWatermark(ts, late), idle, key, ts)


def sync_files(current: DataFrame, state: DataFrame, bursts: DataFrame) -> DataFrame:
    """(path, action) for the files of a batch of bursts: push if any hash changed, delete if the file is gone, nothing if all is as
    it was. ``current``: hashes of the notes as they are."""
    touched = bursts.select(F.col("path").alias("note_path")).distinct()
    changes = diff.local_changes(current.join(touched, "note_path", "left_semi"), state.join(touched, "note_path", "left_semi"))
    return changes.select("path", F.when(F.col("type") == "deleted", "delete").when(F.col("type") == "conflict", "conflict").otherwise("push").alias("action"))


def run_syncs(bursts: DataFrame, read_notes: Callable[[], DataFrame], read_state: Callable[[], DataFrame], act: Callable[[DataFrame, int], None], trigger: str = "500 milliseconds") -> DataStreamWriter:
    """A stream writer that plans each micro-batch and hands the plan to ``act``, which should be idempotent by batch id."""

    def step(batch: DataFrame, batch_id: int) -> None:
        act(sync_files(read_notes(), read_state(), batch), batch_id)

    return bursts.writeStream.outputMode("append").trigger(processingTime=trigger).foreachBatch(step)


def polls(spark: SparkSession, interval_seconds: float) -> DataFrame | None:
    """A stream of poll ticks; no stream if the interval is 0."""
    if interval_seconds <= 0:
        return None
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", int(interval_seconds * 1000)).load()
    return rate.select(F.col("timestamp").alias("tick"))


def poll_writer(ticks: DataFrame, plan: Callable[[], DataFrame], act: Callable[[DataFrame, int], None], interval: str = "5 minutes") -> DataStreamWriter:
    return ticks.writeStream.trigger(processingTime=interval).foreachBatch(lambda _, n: act(plan(), n))


def pull_files(plan: DataFrame, rendered: DataFrame, at: Column) -> DataFrame:
    """(path, content, page_id, last_sync) of the pages a plan pulls: what a sink writes and the state then holds."""
    pulls = plan.where("action = 'pull'").select("path", "page_id")
    return pulls.join(rendered.select(F.col("page_key").alias("page_id"), F.col("markdown").alias("content")), "page_id").select("path", "content", "page_id", at.alias("last_sync"))
