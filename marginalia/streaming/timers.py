"""Debounced bursts by timer: a burst comes out once its key has been quiet, whether or not other keys go on.

``events.debounce_stream`` waits for the watermark, which moves with the events of all keys, so the last burst before a silence stays
in. Here each key holds its open burst and one processing-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import share_package

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Bursts(StatefulProcessor):
    """State of a key: first and last time, count and last operation of its open burst, and when its timer is due; times in microseconds.

    An event later than the burst's last one by more than ``idle_us`` ends the burst at once, and the timer ends it after ``quiet_ms``
    without events, so a replayed log gives the bursts of its own times. An event that comes too late, more than ``idle_us`` before the
    open burst, is a burst of its own.
    """

    def __init__(self, key: str, idle_us: int, quiet_ms: int):
        self.key, self.idle, self.quiet = key, idle_us, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "first long, last long, n long, op string, due long")

    def _row(self, key: object, first: int, last: int, n: int, op: str | None) -> Row:
        return Row(**{self.key: key, "first_us": first, "last_us": last, "events": n, "op": op})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.burst.get() if self.burst.exists() else None
        first, last, n, op = held[:4] if held else (None, None, 0, None)
        for at, what in sorted(((r["us"], r["op"]) for r in rows), key=lambda x: (x[0], x[1] is not None, x[1])):
            if n and at < first - self.idle:
                yield self._row(key[0], at, at, 1, what)
                continue
            if n and at > last + self.idle:
                yield self._row(key[0], first, last, n, op)
                n = 0
            if not n:
                first = last = at
            op = what if not n or at >= last else op
            first, last, n = min(first, at), max(last, at), n + 1
        if held:
            self.handle.deleteTimer(held[4])
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet
        self.handle.registerTimer(due)
        self.burst.update((first, last, n, op, due))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.burst.get() if self.burst.exists() else None
        if held and held[4] == expiredTimerInfo.getExpiryTimeInMs():
            self.burst.clear()
            yield self._row(key[0], *held[:4])

    def close(self) -> None:
        pass


def debounce_timers(events: DataFrame, idle_seconds: float = 5, quiet_seconds: float | None = None, key: str = "path", ts: str = "ts") -> DataFrame:
    """(key, first_ts, last_ts, events, op) per burst of a stream, out ``quiet_seconds`` (as long as ``idle_seconds`` if not said) after
    its last event arrived. Append mode; a key's state goes with its burst. Of operations at one time the greatest counts as last.
    The events of one key and micro-batch are sorted in memory.
    """
    spark = events.sparkSession
    share_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), "op")
    processor = Bursts(key, round(idle_seconds * 1e6), round((idle_seconds if quiet_seconds is None else quiet_seconds) * 1e3))
    out = rows.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=f"{key} {kind}, first_us long, last_us long, events long, op string", outputMode="Append", timeMode="ProcessingTime")
    return out.select(key, F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"), "events", "op")
