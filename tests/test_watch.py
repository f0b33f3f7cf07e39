"""Snapshots, the change log and the running watch."""

import os
import time

from pyspark.sql import functions as F

from marginalia.streaming import events, watch


def put(root, path, text):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text)
    return file


def test_edits_deletes_and_later_folders_appear_once_each(spark, tmp_path):
    root, log = tmp_path / "vault", watch.ChangeLog(spark, str(tmp_path / "log"))
    tick = lambda n: log.tick(watch.snapshot(spark, str(root)), n, F.lit("2030-01-01").cast("timestamp"))
    found = lambda: sorted((r["tick"], r["path"], r["op"]) for r in spark.read.parquet(log.events()).collect())
    tick(0)
    put(root, "a.md", "one")
    put(root, "b c.md", "two")
    put(root, "pic.png", "no note")
    tick(1)
    edited = put(root, "a.md", "one more")
    (root / "b c.md").unlink()
    put(root, "later/deep/é.md", "three")
    tick(2)
    want = [(1, "a.md", "create"), (1, "b c.md", "create"), (2, "a.md", "write"), (2, "b c.md", "remove"), (2, "later/deep/é.md", "create")]
    assert found() == want
    tick(2)  # runs again
    tick(3)  # nothing changed
    os.utime(edited, (1_700_000_000, 1_700_000_000))
    tick(4)
    assert found() == [*want, (4, "a.md", "write")]
    times = {(r["tick"], r["path"]): r["ts"] for r in spark.read.parquet(log.events()).collect()}
    assert times[2, "b c.md"].year == 2030 and times[4, "a.md"].year == 2023
    assert sorted(os.listdir(tmp_path / "log" / "snapshots"))[-2:] == ["3", "4"]


def test_a_watch_by_name_with_progress_and_a_restart(spark, tmp_path):
    root, log = tmp_path / "vault", str(tmp_path / "log")
    root.mkdir()
    reports = watch.ProgressRows({"watch-test"})
    spark.streams.addListener(reports)

    def until(check, seconds=60):
        end = time.time() + seconds
        while not check() and time.time() < end:
            time.sleep(0.3)
        assert check()

    def seen():
        folder = tmp_path / "log" / "events"
        return sorted((r["path"], r["op"]) for r in spark.read.schema(events.EVENT).parquet(watch.ChangeLog(spark, log).events()).collect()) if folder.exists() else []

    try:
        assert watch.status(spark, "watch-test")["running"] is False and watch.stop(spark, "watch-test") is False
        watch.watch(spark, str(root), log, "watch-test", 1).start()
        put(root, "a.md", "one")
        until(lambda: seen() == [("a.md", "create")])
        until(lambda: watch.status(spark, "watch-test")["batch"] is not None)
        assert watch.status(spark, "watch-test")["running"] and watch.stop(spark, "watch-test")
        assert not watch.status(spark, "watch-test")["running"]
        (root / "a.md").unlink()
        put(root, "b.md", "two")
        watch.watch(spark, str(root), log, "watch-test", 1).start()
        until(lambda: seen() == [("a.md", "create"), ("a.md", "remove"), ("b.md", "create")])
        until(lambda: reports.table(spark, 10).count() > 1)
        rows = reports.table(spark, 10).orderBy("at").collect()
        assert {r["name"] for r in rows} == {"watch-test"} and all(r["rate"] is None or r["rate"] > 0 for r in rows) and all(r["percent"] >= 0 for r in rows)
    finally:
        watch.stop(spark, "watch-test")
        spark.streams.removeListener(reports)
