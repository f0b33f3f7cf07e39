"""Bursts by timer, on a live stream and on a replayed log."""

import datetime
import time

import pytest

from marginalia.streaming import events, timers

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


class Live:
    """A stream over a folder of events, into a table; files are added by hand."""

    def __init__(self, spark, tmp_path, name, **more):
        self.spark, self.source, self.name = spark, str(tmp_path / "in"), name
        self.add([])
        bursts = timers.debounce_timers(events.read_log(spark, self.source), **more)
        self.query = bursts.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").start()

    def add(self, rows):
        self.spark.createDataFrame(rows, events.EVENT).coalesce(1).write.mode("append").parquet(self.source)

    def rows(self):
        return sorted((r["path"], r["first_ts"], r["last_ts"], r["events"], r["op"]) for r in self.spark.table(self.name).collect())

    def wait_for(self, n, seconds=60):
        until = time.time() + seconds
        while len(self.rows()) < n and time.time() < until:
            time.sleep(0.3)
        return self.rows()


@pytest.fixture
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def test_a_burst_comes_out_when_its_key_is_quiet(spark, tmp_path, few_partitions):
    """The last events of all: no later event moves a watermark, and both bursts come out all the same, once."""
    live = Live(spark, tmp_path, "quiet_bursts", idle_seconds=5, quiet_seconds=1)
    try:
        live.add([("a.md", "write", at(0)), ("a.md", "create", at(3)), ("b.md", "write", at(1)), ("a.md", "write", at(1))])
        want = [("a.md", at(0), at(3), 3, "create"), ("b.md", at(1), at(1), 1, "write")]
        assert live.wait_for(2) == want
        live.add([("b.md", "remove", at(100)), ("b.md", "write", at(99))])
        assert live.wait_for(3) == [*want, ("b.md", at(99), at(100), 2, "remove")]
        time.sleep(2)
        assert len(live.rows()) == 3
        # Nothing is held any more.
        assert sum(s.numRowsTotal for s in live.query.lastProgress.stateOperators) == 0
    finally:
        live.query.stop()


def test_a_replayed_log_gives_the_bursts_of_its_own_times(spark, tmp_path, few_partitions):
    rows = [(f"{k}.md", op, at(s)) for k, times in {"a": [0, 2, 7, 12.5, 30, 31], "b": [5], "c": [1, 6, 11, 16.1]}.items() for s, op in zip(times, ["create", "write", "write", "remove", "write", "write"], strict=False)]
    live = Live(spark, tmp_path, "replayed_bursts", idle_seconds=5, quiet_seconds=1)
    try:
        live.add(rows)
        batch = events.debounce(spark.createDataFrame(rows, events.EVENT), "5 seconds").collect()
        want = sorted((r["path"], r["first_ts"], r["last_ts"], r["events"], r["op"]) for r in batch)
        assert live.wait_for(len(want)) == want
    finally:
        live.query.stop()
