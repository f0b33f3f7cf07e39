"""The sink: each request once, whatever fails, at one rate for all writers."""

import json
import time

import pytest
from pyspark.sql import Row

from marginalia.sources import sink


class Clock:
    def __init__(self):
        self.now = 100.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


@pytest.mark.parametrize(("rate", "writers"), [(3, 2), (3, 1), (10, 4), (0.5, 3)])
def test_all_writers_together_hold_the_rate(rate, writers):
    """Each writer goes at its own pace; of all sends together no more than the rate fall into a second."""
    sends = []
    for i in range(writers):
        clock = Clock()
        slots = sink.Slots(rate, i, writers, 100.0, clock, clock.sleep)
        for k in range(30):
            clock.now += 0.4 * (k % 5 == i)  # time that the service takes
            slots.wait()
            sends.append(clock.now)
    sends.sort()
    apart = [b - a for a, b in zip(sends, sends[1:], strict=False)]
    assert min(apart) >= 1 / rate - 1e-6
    with pytest.raises(ValueError, match="writers"):
        sink.Slots(rate, writers, writers, 0.0)


def requests(n, kind="page"):
    return [(f"id{i}", kind, json.dumps({"n": i})) for i in range(n)]


def options(tmp_path, **more):
    return {"service": "tests.services:Flaky", "path": f"{tmp_path}/out", "ledger": f"{tmp_path}/ledger", "perSecond": "1000", "writers": "2"} | more


def write(spark, rows, tmp_path, **more):
    sink.register(spark)
    spark.createDataFrame(rows, sink.REQUEST).repartition(2).write.format("workspace_requests").mode("append").options(**options(tmp_path, **more)).save()


def sent(tmp_path):
    return sorted(json.loads(f.read_text())["request_id"] for f in (tmp_path / "out").iterdir())


def test_a_second_run_sends_only_what_is_new(spark, tmp_path):
    write(spark, requests(7), tmp_path)
    write(spark, requests(9), tmp_path)
    assert sent(tmp_path) == sorted(f"id{i}" for i in range(9))
    assert {r["state"] for r in sink.ledger(spark, f"{tmp_path}/ledger").collect()} == {"done"}


class Timed(sink.Outbox):
    """Notes when each request left."""

    def send(self, request_id, kind, body):
        name = super().send(request_id, kind, body)
        return f"{time.time()} {name}"


def test_the_rate_is_the_one_asked_for(spark, tmp_path):
    """Not the default of three a second, whatever Spark does to the case of an option's name."""
    for rate, least, most in (("1000", 0, 3), ("10", 1.7, 5)):
        folder = tmp_path / rate
        folder.mkdir()
        write(spark, requests(20), folder, service="tests.test_sink:Timed", perSecond=rate)
        at = [float(r["answer"].split()[0]) for r in sink.ledger(spark, f"{folder}/ledger").collect()]
        assert len(at) == 20 and least <= max(at) - min(at) < most


def test_refusals_are_tried_again_and_then_fail_the_batch(spark, tmp_path):
    write(spark, requests(4, "refuse"), tmp_path)
    assert sent(tmp_path) == ["id0", "id1", "id2", "id3"]
    with pytest.raises(Exception, match="refused 1"):
        write(spark, [("never", "always", "{}")], tmp_path)
    assert sink.Ledger(f"{tmp_path}/ledger").state("never") == "new"


def test_what_broke_off_is_listed_and_not_sent_again_unasked(spark, tmp_path):
    (tmp_path / "out-broken").touch()
    rows = [*requests(3), ("odd", "break", "{}")]
    with pytest.raises(Exception, match="line went dead"):
        write(spark, rows, tmp_path)
    (tmp_path / "out-broken").unlink()
    write(spark, rows, tmp_path)
    assert sent(tmp_path) == ["id0", "id1", "id2"]
    assert {r["request_id"]: r["state"] for r in sink.ledger(spark, f"{tmp_path}/ledger").collect()}["odd"] == "begun"
    write(spark, rows, tmp_path, resend="true")
    assert sent(tmp_path) == ["id0", "id1", "id2", "odd"]


def test_a_replayed_micro_batch_sends_nothing_twice(spark, tmp_path):
    sink.register(spark)
    source = str(tmp_path / "in")

    def run(checkpoint):
        q = spark.readStream.schema(sink.REQUEST).parquet(source).coalesce(2).writeStream.format("workspace_requests").options(**options(tmp_path)).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
        q.awaitTermination()

    spark.createDataFrame(requests(5), sink.REQUEST).write.parquet(source)
    run("first")
    batches = [json.loads(f.read_text()) for f in (tmp_path / "ledger" / "batches").iterdir()]
    assert batches == [{"batch": 0, "sent": 5, "skipped": 0, "unsure": 0, "failed": 0}]
    spark.createDataFrame(requests(8), sink.REQUEST).write.mode("append").parquet(source)
    run("first")  # goes on with its second batch
    run("second")  # knows of no batch, and begins anew
    assert sent(tmp_path) == sorted(f"id{i}" for i in range(8))


def test_send_all_counts():
    class Memory:
        def __init__(self):
            self.states, self.log = {"old": "done", "odd": "begun"}, []

        def state(self, r):
            return self.states.get(r, "new")

        def begin(self, r):
            self.states[r] = "begun"

        def end(self, r, answer):
            self.states[r] = "done"

        def forget(self, r):
            del self.states[r]

        def send(self, r, kind, body):
            self.log.append(r)
            if kind == "refuse":
                raise sink.Refused
            return r

    both = Memory()
    rows = [Row(request_id=r, kind=k, body="") for r, k in (("old", "p"), ("odd", "p"), ("new", "p"), ("no", "refuse"), ("new", "p"))]
    assert sink.send_all(iter(rows), both, both, lambda: None) == {"sent": 1, "skipped": 2, "unsure": 1, "failed": 1}
    assert both.log == ["new", "no", "no", "no"]


def test_missing_options(spark):
    sink.register(spark)
    with pytest.raises(Exception, match="ledger is missing"):
        spark.createDataFrame(requests(1), sink.REQUEST).write.format("workspace_requests").mode("append").option("service", "x:y").save()
