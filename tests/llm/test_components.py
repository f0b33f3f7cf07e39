import numpy as np
import pytest

from marginalia.llm.common import Scratch
from marginalia.llm.components import components, stars


def roots_of(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


EDGES = {
    "random": np.random.default_rng(1).integers(0, 400, (300, 2)).tolist(),
    "path": [(i, i + 1) for i in range(300)],
    "star": [(7, i) for i in range(200)],
    "two trees and a loop": [(5, 1), (5, 2), (2, 9), (20, 30), (30, 40), (3, 3)],
    "empty": [],
}


@pytest.mark.parametrize("fold", [40, 1 << 18])
@pytest.mark.parametrize("name", EDGES)
def test_components_equal_union_find(spark, name, fold):
    edges = [tuple(map(int, e)) for e in EDGES[name]]
    table = spark.createDataFrame(edges, "u long, v long").repartition(5)
    found = components(table, Scratch(spark, "components-test"), fold).collect()
    want = roots_of([e for e in edges if e[0] != e[1]])
    got = {r["node"]: r["root"] for r in found}
    assert len(found) == len(got)
    assert got.keys() == want.keys()
    assert len({(got[n], want[n]) for n in got}) == len(set(got.values())) == len(set(want.values()))


def test_stars_keep_what_is_connected():
    u, v = stars(np.array([4, 4, 9, 8, 8]), np.array([2, 9, 9, 7, 8]))
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == [(4, 2), (8, 7), (9, 2)]
