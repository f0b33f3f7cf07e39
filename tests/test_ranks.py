"""Ranks and pairs within groups of any size."""

import random

from pyspark.sql import functions as F

from marginalia import schema
from marginalia.operators import diff, ranks
from marginalia.scratch import Scratch


def rows_of(n, seed):
    """Names in groups of which one has a third of all rows."""
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"g{rng.randint(0, n // 4)}", f"{rng.random():.12f}-{i}") for i in range(n)]


def brute_ranks(rows):
    out, at = set(), {}
    for g, p in sorted(rows):
        at[g] = at.get(g, 0) + 1
        out.add((g, p, at[g]))
    return out


def test_ranks_equal_brute_force_and_a_hot_group_is_spread(spark):
    rows = rows_of(6000, 1)
    table = spark.createDataFrame(rows, "g string, path string").repartition(5)
    got = ranks.ranked(table, ["g"], "path", Scratch(spark, "ranks-test"), cells=24)
    assert {tuple(r) for r in got.select("g", "path", "rank").collect()} == brute_ranks(rows)
    cells = table.repartitionByRange(24, "g", "path").withColumn("cell", F.spark_partition_id()).groupBy("g", "cell").count().where("g = 'hot'").collect()
    assert len(cells) >= 7 and max(r["count"] for r in cells) < 2000 / 4


def test_aligned_pairs_first_with_first(spark):
    left = [("h", f"n{i:03}") for i in range(200)] + [("x", "only left"), ("y", "b"), ("y", "a")]
    right = [("h", f"o{i:03}", i) for i in range(150)] + [("y", "q", 7), ("z", "only right", 8)]
    scratch = Scratch(spark, "ranks-test")
    got = ranks.aligned(spark.createDataFrame(left, "h string, new string").repartition(3), spark.createDataFrame(right, "h string, old string, v int").repartition(2), "h", "new", "old", scratch, cells=8)
    assert {(r["new"], r["old"]) for r in got.collect()} == {(f"n{i:03}", f"o{i:03}") for i in range(150)} | {("a", "q")}


def test_a_third_of_all_notes_renamed_with_one_hash(spark):
    """Template notes: 400 vanish, 300 appear, all of one hash; the others are unique."""
    new = [(f"new/{i:04}.md", "same" if i < 300 else f"h{i}", "", "same" if i < 300 else f"h{i}", None) for i in range(900)]
    old = [(f"old/{i:04}.md", f"p{i}", None, "same" if i < 400 else f"h{i}", "", None, None, None, None, "synced") for i in range(1000)]
    notes = spark.createDataFrame(new, "note_path string, content_hash string, frontmatter_hash string, full_hash string, mtime timestamp").repartition(3)
    state = spark.createDataFrame(old, schema.SYNC_STATE).repartition(2)
    want = {(f"new/{i:04}.md", f"old/{i:04}.md", f"p{i}") for i in [*range(300), *range(400, 900)]}
    assert {(r["path"], r["old_path"], r["page_id"]) for r in diff.renames(notes, state).collect()} == want
    changes = diff.local_changes(notes, state).collect()
    assert {(r["path"], r["old_path"], r["page_id"]) for r in changes if r["type"] == "renamed"} == want
    assert {r["path"] for r in changes if r["type"] == "deleted"} == {f"old/{i:04}.md" for i in [*range(300, 400), *range(900, 1000)]}
    assert {r["path"] for r in changes if r["type"] == "created"} == {f"new/{i:04}.md" for i in range(300, 400)}
    assert len(changes) == len({r["path"] for r in changes})
