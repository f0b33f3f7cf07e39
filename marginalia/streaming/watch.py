"""Watching a folder of notes: snapshots compared tick by tick, a change log of events, and the running watch by its name.

A file source never gives a changed file again and sees no deletes, so a tick lists the folder, as Spark lists input files, and
compares the list with the one before. Events go to a log, which ``events.read_log`` streams on to debouncing and syncing.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..plans.runtime import progress
from .events import polls

SNAPSHOT = "path string, modified timestamp, size long"


def snapshot(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """(path below ``root``, modified, size) of the files there now; contents are not read. Names that begin with ``.`` or ``_`` are left
    out, as Spark's listing has it. A folder that is gone is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return spark.createDataFrame([], SNAPSHOT)
    below = len(system.makeQualified(path).toString().rstrip("/")) + 2
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select(F.substr("path", F.lit(below)).alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def snapshot_events(before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """(path, op, ts): create, write and remove events between two snapshots, one a path. A file is written if its time or size changed
    (an edit that keeps both isn't seen); removals bear the time of the later snapshot."""
    old = before.select("path", F.struct("modified", "size").alias("old"))
    both = old.join(after.select("path", F.struct("modified", "size").alias("new")), "path", "full_outer")
    op = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "remove").when(F.col("old") != F.col("new"), "write")
    return both.select("path", op.alias("op"), F.coalesce("new.modified", now).alias("ts")).where("op is not null")


class ChangeLog:
    """Snapshots and events by number below ``path``. Tick ``n`` compares snapshot n with the last one before it; a tick that runs again
    writes the same folders anew, so its events are there once. Older snapshots go when a later one is through."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _whole(self) -> list[int]:
        """Numbers of snapshots that were written to their end."""
        if not self._fs.exists(self._folder):
            return []
        numbers = [int(f.getPath().getName()) for f in self._fs.listStatus(self._folder)]
        return sorted(n for n in numbers if self._fs.exists(self._named(n, "_SUCCESS")))

    def _named(self, number: int, file: str = "") -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots/{number}" + (f"/{file}" if file else ""))

    def tick(self, after: DataFrame, number: int, now: Column) -> None:
        earlier = [n for n in self._whole() if n < number]
        read = lambda n: self.spark.read.schema(SNAPSHOT).parquet(f"{self.path}/snapshots/{n}")
        after.write.mode("overwrite").parquet(f"{self.path}/snapshots/{number}")
        before = read(earlier[-1]) if earlier else self.spark.createDataFrame([], SNAPSHOT)
        snapshot_events(before, read(number), now).write.mode("overwrite").parquet(f"{self.path}/events/tick={number}")
        for n in earlier[:-1]:
            self._fs.delete(self._named(n), True)

    def events(self) -> str:
        """Where the events are; a stream that starts before the first tick needs the folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/events")
        self._fs.mkdirs(path)
        return f"{self.path}/events"


def watch(spark: SparkSession, root: str, log: str, name: str, interval_seconds: float = 5, ignore: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """The writer of a stream, called ``name``, that logs what changes below ``root`` at each tick. ``ignore`` filters snapshots."""
    changes = ChangeLog(spark, log)

    def step(_: DataFrame, number: int) -> None:
        after = snapshot(spark, root)
        changes.tick(ignore(after) if ignore else after, number, F.current_timestamp())

    ticks = polls(spark, interval_seconds)
    if ticks is None:
        raise ValueError("a watch needs an interval above 0")
    return ticks.writeStream.queryName(name).option("checkpointLocation", f"{log.rstrip('/')}/checkpoint").trigger(processingTime=f"{interval_seconds} seconds").foreachBatch(step)


# the running watch


def _running(spark: SparkSession, name: str) -> StreamingQuery | None:
    return next((q for q in spark.streams.active if q.name == name), None)


def status(spark: SparkSession, name: str) -> dict[str, object]:
    """What the query of this name does: running, its message, last batch and rows in it."""
    q = _running(spark, name)
    last = q.lastProgress if q else None
    return {"name": name, "running": q is not None, "message": q.status["message"] if q else None, "batch": last.batchId if last else None, "rows": last.numInputRows if last else None}


def stop(spark: SparkSession, name: str) -> bool:
    """Stops the query of this name at once; whether there was one. Its next start goes on where it was."""
    q = _running(spark, name)
    if q:
        q.stop()
    return q is not None


class ProgressRows(StreamingQueryListener):
    """Keeps the last progress reports of all queries, or of those named; ``spark.streams.addListener`` starts it."""

    def __init__(self, names: set[str] | None = None, most: int = 1000):
        self._names, self._rows, self._lock, self._done = names, deque(maxlen=most), threading.Lock(), {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self._names is None or p.name in self._names:
            with self._lock:
                done, seconds = self._done.get(p.id, (0, 0.0))
                self._done[p.id] = done, seconds = done + p.numInputRows, seconds + p.batchDuration / 1000
                self._rows.append((p.name, p.batchId, p.timestamp, done, seconds))

    def table(self, spark: SparkSession, total: int = 0) -> DataFrame:
        """(name, batch, at, done, percent, rate, eta_seconds) of each report; percent and estimate against ``total`` rows."""
        with self._lock:
            rows = list(self._rows)
        seen = spark.createDataFrame(rows, "name string, batch long, at string, done long, seconds double")
        return seen.select("name", "batch", F.to_timestamp("at").alias("at"), "done", progress(F.col("done"), F.lit(total), F.col("seconds")).alias("p")).select("name", "batch", "at", "done", "p.*")
