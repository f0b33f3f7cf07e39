import hashlib

import pytest

from marginalia.llm import warc
from marginalia.llm.common import Scratch

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
SCHEMA = "page_id long, url string, html string, digest string, record_type string"


def pages():
    same = "<p>copy</p>" * 20
    payloads = [None, "", "x", FAKE, "a" + FAKE * 3 + "b", "WARC/1.0", "WARC/1.0\r\n", "WARC/1.0\r\nWARC-Type", "tail WARC/1.0\r", same, same, same, "y" * 99, "y" * 99, "é" * 50, "é" * 50, "long " * 60000 + FAKE, "\r\n\r\n", "\n", "WWARC/1.0\r\nW"]
    payloads += [f"<html>{i}</html>" * (i % 40) for i in range(200)]
    rows = [(i, f"http://e/{i}\r\nX: {i}" if i % 7 == 0 else f"http://e/{i}", p, "c", "d") for i, p in enumerate(payloads)]
    return rows + [(9, None, same, None, None), (None, None, same, None, None), (None, None, "lone " * 50, None, None)]


def expected(rows):
    first = {}
    for i, _, p, *_ in rows:
        if i is not None:
            first[p or ""] = min(i, first.get(p or "", i))
    want = []
    for i, _, p, *_ in rows:
        data = (p or "").encode()
        lead = first.get(p or "")
        revisit = len(data) >= 100 and lead is not None and i != lead
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", str(lead) if revisit else None, b"" if revisit else data))
    return sorted(want, key=str)


@pytest.mark.parametrize(("compression", "split"), [("gzip", "128m"), ("none", "128m"), ("none", "3000b"), ("none", "311b")])
def test_round_trip(spark, compression, split):
    scratch = Scratch(spark, "warc-test")
    rows = pages()
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        path = scratch.path("archive")
        parts = 2 if split == "311b" else 3
        warc.write_warc(spark.createDataFrame(rows if split != "311b" else rows[:16] + rows[17:60], SCHEMA).coalesce(parts), path, scratch, compression=compression)
        got = warc.read_warc(spark, path, scratch).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    mine = sorted([(str(r["record_id"]), r["stated_bytes"], r["digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got], key=str)
    assert mine == expected(rows if split != "311b" else rows[:16] + rows[17:60])
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["digest"] for r in got if r["record_type"] == "response")


def test_chain_stops_at_damage(spark):
    scratch = Scratch(spark, "warc-test")
    good = "WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    path = scratch.path("made")
    spark.createDataFrame([(good * 2 + "WARC/1.0\r\nno length\r\n\r\n" + good,)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    assert [bytes(r["payload"]) for r in warc.read_warc(spark, path, scratch).collect()] == [b"hi", b"hi"]


def test_empty_table(spark):
    scratch = Scratch(spark, "warc-test")
    path = scratch.path("none")
    warc.write_warc(spark.createDataFrame([], SCHEMA), path, scratch)
    assert warc.read_warc(spark, path, scratch).count() == 0


def payloads(records):
    return sorted((str(r["record_id"]), r["record_type"], bytes(r["payload"])) for r in records.collect())


@pytest.mark.parametrize("odd", [False, True])
def test_payloads_are_not_shuffled_by_the_reader(spark, odd, monkeypatch):
    """Whether or not some payload holds a version line; and sorting both sides, for tables too large to send, gives the same."""
    scratch = Scratch(spark, "warc-test")
    rows = [r for r in pages() if odd or "WARC/1.0" not in (r[2] or "")]
    path = scratch.path("archive")
    warc.write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(3), path, scratch)
    read = warc.read_warc(spark, path, scratch)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" not in plan and plan.count("strategy=broadcast") == 2 + odd
    got = payloads(read)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert payloads(warc.read_warc(spark, path, scratch)) == got and len(got) == len(rows)
