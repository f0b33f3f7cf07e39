"""Embeds within embeds: reach, cycles and depth without listing every way."""

import random

import pytest

from marginalia.operators import embeds

SCHEMA = "source string, target string, media boolean"


def ways(edges, longest):
    """Every way from every source: (notes, comes back)."""
    out = {}
    for s, t, m in edges:
        out.setdefault(s, set()).add((t, m))
    found, todo = [], [([s, t], m) for s, ts in out.items() for t, m in ts]
    while todo:
        trail, media = todo.pop()
        back = trail[-1] in trail[:-1]
        found.append((trail, back))
        if not back and not media and len(trail) <= longest:
            todo += [([*trail, t], m) for t, m in out.get(trail[-1], ())]
    return found


def graph(seed, n=12, m=18):
    rng = random.Random(seed)
    rows = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", False) for _ in range(m)}
    return sorted(rows | {(f"n{rng.randrange(n)}", f"pic{i}.png", True) for i in range(3)})


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("depth", [4])
def test_equals_every_way_listed(spark, seed, depth):
    edges = graph(seed)
    table = spark.createDataFrame(edges, SCHEMA).repartition(3)
    every = [(t, back) for t, back in ways(edges, depth + 1)]
    least, repeats = {}, {}
    for trail, back in every:
        d = len(trail) - 1
        if d <= depth:
            least[trail[0], trail[-1]] = min(d, least.get((trail[0], trail[-1]), 99))
            if back:
                repeats[trail[0]] = min(d, repeats.get(trail[0], 99))
    assert {(r["root"], r["target"]): r["depth"] for r in embeds.embed_reach(table, depth).collect()} == least
    assert {r["root"]: r["depth"] for r in embeds.first_repeats(table, depth).collect()} == repeats
    assert {r["root"] for r in embeds.too_deep(table, depth).collect()} == {t[0] for t, back in every if len(t) - 1 > depth and not back}
    assert {(r["root"], tuple(r["trail"])) for r in embeds.cycles(table, depth).collect()} == {(t[0], tuple(t)) for t, back in every if back and len(t) - 1 <= depth}


def test_many_ways_make_few_rows(spark):
    """Ten layers of eight notes, each embedding the whole next layer: a thousand million ways."""
    edges = [(f"l{i}-{a}", f"l{i + 1}-{b}", False) for i in range(11) for a in range(8) for b in range(8)]
    table = spark.createDataFrame(edges, SCHEMA)
    reach = embeds.embed_reach(table)
    assert reach.where("root = 'l0-0'").count() == 80 and reach.count() == sum(8 * 8 * min(10, 11 - i) for i in range(11))
    assert embeds.first_repeats(table).count() == 0
    assert {r["root"] for r in embeds.too_deep(table).collect()} == {f"l0-{a}" for a in range(8)}


def test_nothing_embedded(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [f(none).count() for f in (embeds.embed_reach, embeds.first_repeats, embeds.too_deep, embeds.cycles)] == [0, 0, 0, 0]
