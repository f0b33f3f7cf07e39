import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, cluster string, q string"


def brute(rows, k=8, rounds=10, seed=3, dims=64):
    kept = []
    for vec_id, v, *_ in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 1 << 17 for x in v):
            kept.append((vec_id, [math.floor(1024 * float(np.float32(x))) for x in v]))
    order = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [q for _, q in sorted(kept, key=order)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda q: min(range(len(centroids)), key=lambda c: (far(q, centroids[c]), c))
    for _ in range(rounds):
        of = [near(q) for _, q in kept]
        for c in range(len(centroids)):
            own = [q for (_, q), o in zip(kept, of, strict=True) if o == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    of = [near(q) for _, q in kept]
    d = [far(q, centroids[c]) for (_, q), c in zip(kept, of, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, x, sum(y for y, o in zip(d, of, strict=True) if o == c), sum(d), sha[c]) for (i, _), c, x in zip(kept, of, d, strict=True)]


def check(spark, rows, **more):
    found = clustering.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), **more)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=str) == sorted(brute(rows, **{k: v for k, v in more.items() if k in ("k", "rounds", "dims")}), key=str)
    return got


def test_equals_brute_force_with_every_awkward_row(spark):
    rng = np.random.default_rng(5)
    blobs = rng.normal(size=(5, 64))
    rows = [(i, (blobs[i % 5] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist(), "clash", "clash") for i in range(150)]
    good = rows[0][1]
    odd = [(900, None), (901, []), (902, good[:63]), (903, [*good, 0.0]), (904, [*good[:63], None]), (905, [*good[:63], float("nan")]), (906, [*good[:63], float("inf")]), (907, [*good[:63], 2e6]), (None, good), (3, good), (3, rows[1][1]), (908, [-0.0] * 64), (909, [-1e-7] * 64)]
    check(spark, rows + [(i, v, None, None) for i, v in odd] + rows[:20])


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    assert len(check(spark, [(i, [float(i)] * 64, None, None) for i in range(n)])) == n


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    """Equal vectors make equal centroids: all but the first of them stay empty."""
    rows = [(i, [1.0, 2.0], None, None) for i in range(30)] + [(i, [float(i % 2), 0.0], None, None) for i in range(30, 50)]
    got = check(spark, rows, dims=2, rounds=4)
    assert len({r[1] for r in got}) <= 3


def test_bounds_save_scans_and_change_nothing(spark):
    rng = np.random.default_rng(6)
    blobs = 3 * rng.normal(size=(4, 8))
    rows = [(i, (blobs[i % 4] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist(), None, None) for i in range(400)]
    scans = []
    check(spark, rows, dims=8, k=4, scans=scans)
    assert scans[0] == 400 and sum(scans[1:]) < 0.5 * 400 * (len(scans) - 1)


def test_settle_never_skips_a_nearer_centroid():
    rng = np.random.default_rng(7)
    q = rng.integers(-40, 40, (500, 3))
    centroids = rng.integers(-40, 40, (6, 3))
    cluster, upper, lower = np.full(500, -1), np.full(500, np.inf), np.zeros(500)
    moved = np.zeros(6)
    for _ in range(30):
        cluster, upper, lower, _ = clustering.settle(q, cluster, upper, lower, centroids, moved)
        assert (cluster == clustering.squared(q, centroids).argmin(axis=1)).all()
        after = centroids + rng.integers(-3, 4, centroids.shape) * (rng.random((6, 1)) < 0.6)
        moved = np.sqrt(((after - centroids) ** 2).sum(axis=1).astype(float))
        centroids = after


def test_extra_columns_and_float_kinds(spark):
    wide = spark.range(40).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * F.col("id"))).alias("embedding"))
    assert clustering.cluster(wide).count() == 40
