import numpy as np
import pytest

from marginalia.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, v string, keys string, kept string"


def brute(rows, threshold=0.9):
    """(id, n_links, component) per row over all pairs of rows."""

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(float)
        v /= np.abs(v).max()
        return v / np.linalg.norm(v)

    vs = [unit(r[1]) for r in rows]
    linked = [[j for j in range(len(rows)) if j != i and vs[i] is not None and vs[j] is not None and len(vs[i]) == len(vs[j]) and vs[i] @ vs[j] >= threshold] for i in range(len(rows))]
    seen, out = {}, []
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in linked[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            seen |= dict.fromkeys(group, min(ids, default=None))
        out.append((rows[i][0], len(linked[i]), seen[i], rows[i][0] == seen[i]))
    return out


def run(spark, rows, **more):
    found = ed.near_vectors(spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in rows], SCHEMA).repartition(3), **more)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def planted(n, dims, cosines, seed):
    """Random vectors, and for some of them a chain of partners at the cosines given."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = [ed.partners(base[k : k + 1], c, rng)[0] for k, c in enumerate(cosines)]
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate([*base, *near])]


def test_equals_brute_force_with_every_awkward_row(spark):
    rows = planted(300, 24, [0.97, 0.95, 0.99, 0.93, 0.999] * 8, 1)
    good = rows[0][1]
    odd = [(None, good), (None, [-x for x in good]), (None, [-x for x in good]), (900, None), (901, []), (902, [0.0] * 24), (903, [float("nan"), *good[1:]]), (904, [float("inf"), *good[1:]]), (905, [None, *good[1:]]), (906, good[:23]), (907, good[:23]), (5, rows[1][1]), (908, [x * 1e-30 for x in good]), (909, [x * 1e30 for x in good]), (910, [1.0]), (911, [-1.0]), (912, [3.0])]
    rows += odd + rows[:5] + [(20, rows[300][1])] * 3
    assert run(spark, rows, recall=0.9999) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None)], [(4, [1.0, 2.0])], [(4, [1.0, 2.0]), (3, [1.0, 2.0])]])
def test_tiny_tables(spark, rows):
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_no_pair_below_the_threshold_and_recall_just_at_it(spark):
    rows = planted(3000, 64, np.r_[np.full(700, 0.9005), np.full(700, 0.8995)], 2)
    got = {r[0]: r[1] for r in run(spark, rows)}
    assert sum(got[3000 + k] for k in range(700, 1400)) == 0
    assert np.mean([got[3000 + k] > 0 for k in range(700)]) >= 0.94
    assert all(got[k] == got[3000 + k] for k in range(700))


def test_a_third_of_all_rows_near_each_other_is_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(ed, "TILE", 40)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=32)
    family = [(i, (centre + 0.1 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(250)]
    rows = family + [(1000 + i, rng.normal(size=32).astype(np.float32).tolist()) for i in range(400)] + [(5000 + i, family[7][1]) for i in range(60)]
    for most in (ed.BROADCAST_BUCKETS, 0):
        monkeypatch.setattr(ed, "BROADCAST_BUCKETS", most)
        assert run(spark, rows, recall=0.9999) == sorted(brute(rows), key=str)


def test_codes_are_balanced_and_lose_less_than_a_random_turn():
    rng = np.random.default_rng(4)
    sample = rng.normal(size=(2000, 16)) * np.linspace(0.2, 3, 16)
    directions, cuts = ed.quantise(sample, np.random.default_rng(5))
    first, _ = ed.quantise(sample, np.random.default_rng(5), rounds=0)
    assert np.allclose(directions.T @ directions, np.eye(16))
    assert np.abs((sample @ directions > cuts).mean(axis=0) - 0.5).max() < 0.01
    centred = sample - sample.mean(axis=0)
    loss = lambda d: ((np.sign(centred @ d) - centred @ d) ** 2).sum()
    assert loss(directions) < loss(first)


def test_tables_widen_with_the_number_of_vectors_and_keep_their_recall():
    sample = np.random.default_rng(6).normal(size=(2000, 64))
    small, large = (ed.learn(sample, n, 0.9, 0.95) for n in (10_000, 10_000_000))
    assert small.bits < large.bits and small.count < large.count
    unit = np.random.default_rng(7).normal(size=(2000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    other = ed.partners(unit, 0.9, np.random.default_rng(8))
    for tables in (small, large):
        assert (tables.keys(unit) == tables.keys(other)).any(axis=1).mean() > 0.9
