"""Fuzzy matching: which pairs meet, and that none is lost."""

import random

import pytest

from marginalia import registry, views
from marginalia.operators import fuzzy, links

from .test_links import links_of, python_match, state_of


def names_over(letters, low, high, n, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(low, high))).strip() for _ in range(n)} - {""})


@pytest.mark.parametrize(("low", "high"), [(1, 5), (8, 17), (13, 24)])
def test_no_match_is_lost_around_the_longest_short_name(spark, low, high):
    """Names on both sides of SHORT, some of them up to three edits apart."""
    rng = random.Random(low)
    names = names_over("abcd", low, high, 30, low)
    targets = list(names)
    for name in names:
        for edits in (1, 2, 3):
            chars = list(name)
            for _ in range(edits):
                at = rng.randrange(len(chars) + 1)
                chars[at : at + rng.randint(0, 1)] = rng.choice(["", "b", "x"])
            targets.append("".join(chars) or "a")
    pages = {f"d/{n}.md": n for n in names}
    got = {(r["target"], r["note_path"]): (r["score"], r["distance"]) for r in fuzzy.fuzzy_matches(links_of(spark, [("s", t) for t in targets]), state_of(spark, pages)).collect()}
    want = {(t, p): python_match(t, p) for t in set(targets) for p in pages}
    assert got == {k: m for k, m in want.items() if m[0]}


@pytest.mark.parametrize("distance", [1, 2])
def test_smaller_distances(spark, distance):
    names = names_over("abc", 1, 14, 60, distance)
    table, state = links_of(spark, [("s", n[::-1]) for n in names] + [("s", n) for n in names]), state_of(spark, {f"{n}.md": n for n in names})
    got = {(r["target"], r["note_path"]): (r["score"], r["distance"]) for r in fuzzy.fuzzy_matches(table, state, distance).collect()}
    want = {(t, f"{n}.md"): python_match(t, n, distance) for t in {*names, *(n[::-1] for n in names)} for n in names}
    assert got == {k: m for k, m in want.items() if m[0]}


def test_few_pairs_are_compared(spark):
    """Under a twentieth of all pairs of keys, over all documents; brute force agrees by the query's SQL."""
    d = "/root/testdata/sf0.01"
    table, state, compared = registry._links(spark, d), views.sync_state(spark, d), []
    assert fuzzy.fuzzy_topk(table, state, 3, compared=compared).count() > 1000
    every = fuzzy.keyed(table, "target_name").select("t_key").distinct().count() * fuzzy.candidates(state).select("c_key").distinct().count()
    assert len(compared) == 3 and sum(compared) < 0.05 * every


def test_a_common_prefix_gives_k_rows(spark):
    """A key that all names begin with meets no more of them than are asked for, in order of length and path."""
    names = [f"meeting {i}" for i in range(300)]
    state = state_of(spark, {f"x/{n}.md": n for n in names})
    compared = []
    got = links.fuzzy_topk(links_of(spark, [("s", "Meeting"), ("s", "")]), state, 3, compared=compared).collect()
    assert {(r["target"], r["rank"], r["note_path"]) for r in got} == {(t, i + 1, f"x/meeting {i}.md") for t in ("Meeting", "") for i in range(3)}
    assert compared == []


def test_empty_sides(spark):
    some, none = links_of(spark, [("s", "a")]), links_of(spark, [])
    assert links.fuzzy_topk(none, state_of(spark, {"a.md": "1"})).count() == 0
    assert links.fuzzy_topk(some, state_of(spark, {"a.md": None})).count() == 0
    assert fuzzy.fuzzy_matches(some, state_of(spark, {"a.md": ""})).count() == 0


def test_neighbourhoods_are_never_broadcast(spark):
    """What names explode to is hundreds of times what the plan takes it for, so it must not go through the driver."""
    names = spark.createDataFrame([(f"name {i}",) for i in range(50)], "t_key string")
    held = names.withColumnRenamed("t_key", "c_key")
    for distance in (1, 3):
        plan = fuzzy.near_pairs(names, held, distance)._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    cands = held.selectExpr("c_key", "c_key AS note_path", "c_key AS page_id")
    assert "Broadcast" not in fuzzy.first_of_prefix(names, cands, 3)._jdf.queryExecution().sparkPlan().toString()
