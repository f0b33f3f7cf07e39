"""Paged reads: cursors, trees level by level, filters that go with the requests."""

import os
import re

import pyarrow as pa
import pytest

from marginalia.scratch import Scratch
from marginalia.sources import paged

from . import services


def pages(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "page_id string")


def test_cursor_loop():
    asked = []

    def ask(cursor):
        asked.append(cursor)
        return pa.table({"x": [cursor]}), {None: 5, 5: 7, 7: None}[cursor]

    waits = []
    assert [n for n, _ in paged.cursor_loop(ask, lambda: waits.append(1))] == [1, 2, 3]
    assert asked == [None, 5, 7] and len(waits) == 3
    with pytest.raises(ValueError, match="again"):
        list(paged.cursor_loop(lambda _: (pa.table({"x": [1]}), 3)))


def test_trees_level_by_level(spark):
    trees = paged.fetch_trees(pages(spark, "r", "even", "none", "r"), services.Tree)
    rows = trees.where("block_id is not null").collect()
    assert len(rows) == 250 + 2 * 3 + 6 + 200 + 3 + 3 and len({r["block_id"] for r in rows}) == len(rows)
    at = {r["block_id"]: r for r in rows}
    deep = at["r.200.1.0"]
    assert deep["block_path"] == [200, 1, 0] and deep["depth"] == 2 and deep["page_id"] == "r" and deep["request"] == 1
    assert [at[f"r.{i}"]["request"] for i in (0, 99, 100, 199, 200, 249)] == [1, 1, 2, 2, 3, 3]
    counts = {r["page_id"]: (r["blocks"], r["requests"]) for r in paged.request_counts(trees).collect()}
    # A parent takes a request for each hundred children, one at least; a full last page is known to be the last.
    assert counts == {"r": (262, 3 + 3 + 6), "even": (206, 2 + 2 + 3), "none": (0, 1)}


def test_no_pages_and_a_block_within_itself(spark):
    assert paged.fetch_trees(pages(spark), services.Tree).count() == 0
    with pytest.raises(ValueError, match="deep"):
        paged.fetch_trees(pages(spark, "x"), services.Loop, deepest=4)


def test_each_request_waits(spark, tmp_path):
    class Limit:
        def wait(self):
            with open(f"{tmp_path}/waits-{os.getpid()}", "a") as out:
                out.write("w")

    paged.fetch_trees(pages(spark, "even"), services.Tree, size=50, limiter=Limit).count()
    assert sum(f.stat().st_size for f in tmp_path.iterdir()) == 4 + 2 + 3


def test_filters_go_with_the_request(spark, tmp_path):
    ask = lambda **more: paged.query_pages(spark, str(tmp_path), service="tests.services:Databases", **more)
    got = ask(database="b", wanted={"tag": "t1", "title": "T0"}).where("page_id <> 'b3'").collect()
    assert {r["page_id"] for r in got} == {f"b{i}" for i in range(130) if i % 2 == 1 and i % 3 == 0 and i != 3} and {r["request"] for r in got} == {1}
    asked = [(f.name, f.read_text()) for f in tmp_path.iterdir()]
    assert len(asked) == 1 and re.search("None-b$", asked[0][0]) and "('tag', 't1')" in asked[0][1] and "('title', 'T0')" in asked[0][1]


def test_one_loaded_table_in_several_queries(spark, tmp_path):
    """Filters of one query don't reach another one of the same table."""
    a = paged.query_pages(spark, str(tmp_path), "a", service="tests.services:Databases")
    assert a.where("tag = 't1'").count() == 65 and a.count() == 130
    assert [tuple(r) for r in a.groupBy("request").count().orderBy("request").collect()] == [(1, 100), (2, 30)]
    with pytest.raises(Exception, match="asked about closed"):
        paged.query_pages(spark, str(tmp_path), service="tests.services:Databases").count()


@pytest.mark.parametrize("size", [1, 7, 100])
def test_an_export_gives_back_its_rows(spark, size):
    scratch = Scratch(spark, "export-test")
    rows = [(f"b{p}-{i}", f"p{p}", "x", None, False, i) for p in range(5) for i in range(p * 11)]
    blocks = spark.createDataFrame(rows, "block_id string, parent_id string, type string, text string, has_children boolean, at int").repartition(3)
    paged.export_rows(blocks, f"{scratch.base}/blocks", "parent_id", "at", scratch)
    service = paged.Export(scratch.base)
    for p in range(5):
        got = [(n, x) for n, page in paged.cursor_loop(lambda at, p=p: service.children(f"p{p}", at, size)) for x in page.column("block_id").to_pylist()]
        assert got == [(i // size + 1, f"b{p}-{i}") for i in range(p * 11)]


def test_a_request_reads_the_row_groups_of_its_rows(spark, monkeypatch):
    """Parents asked in order read each row group about once, however many there are; a page may begin in one and end in the next."""
    monkeypatch.setattr(paged, "ROW_GROUP", 2000)
    scratch = Scratch(spark, "export-groups")
    spark.range(6000).selectExpr("concat('b', id) AS block_id", "concat('p', lpad(cast(pow(id / 6000, 2) * 400 AS int), 3, '0')) AS parent_id", "'x' AS type", "sha2(cast(id AS string), 256) AS text", "false AS has_children", "id AS at").createOrReplaceTempView("made")
    rows = spark.table("made")
    paged.export_rows(rows, f"{scratch.base}/blocks", "parent_id", "at", scratch)
    service = paged.Export(scratch.base)
    want = {}
    for r in rows.orderBy("at").collect():
        want.setdefault(r["parent_id"], []).append(r["block_id"])
    for p in sorted(want):
        assert [x for _, page in paged.cursor_loop(lambda at, p=p: service.children(p, at, 7)) for x in page.column("block_id").to_pylist()] == want[p]
    groups = len(service._groups("blocks", "parent_id"))
    assert groups > 10 and service.reads <= 2 * groups
    for p in ("a", "p2000", "q"):
        assert service.children(p, None, 7)[1] is None and not len(service.children(p, None, 7)[0])
