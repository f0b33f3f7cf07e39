"""Centroid clustering of embeddings with Hamerly bounds, in exact integers.

A vector's row carries its cluster, one upper bound on the distance to its own centroid and one lower bound on the distance to
the second nearest. A round loosens both by what the centroids moved; only vectors whose bounds then leave the nearest centroid
open are compared with it, and, if that doesn't settle it either, with all centroids. Comparisons are of squared distances in
64-bit integers, so ties are seen as such. Bounds only ever skip work: they are widened by more than rounding can err, and a
vector is skipped only where they are strictly apart.

The rows with their bounds are written after each round, so a lost executor costs a stage; sums for the new centroids are kept
up by the vectors that changed cluster. The driver holds the centroids, a number of rows bounded by ``k``, and no others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ensure_workers

#: Components beyond this size have squared distances that no long holds.
LARGEST = 1 << 17
#: Relative and absolute widening of bounds; distances err by about 1e-15 of themselves.
WIDER, APART = 1e-9, 1e-6


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q): vectors of exactly ``dims`` components, none null or not finite, each turned into floor(scale * x).

    Vectors with a component of 2^17 or more in size are left out too: their squared distances don't fit a long.
    """
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return vectors.where((F.size(vector_col) == dims) & fine).select(F.col(id_col).alias("vec_id"), whole.alias("q"))


def seeds(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest SHA-256 of ``<seed>:<vec_id>``, in that order; ties by components, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = whole.select("q", order.alias("h")).orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    return np.array([r["q"] for r in first], np.int64)


def squared(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    out = np.empty((len(q), len(centroids)), np.int64)
    for c, centre in enumerate(centroids):
        apart = q - centre
        out[:, c] = np.einsum("ij,ij->i", apart, apart)
    return out


def settle(q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters and bounds after the centroids moved by ``moved``, and how many vectors took a full scan. A cluster of -1 is
    none yet."""
    cluster, known = cluster.copy(), cluster >= 0
    upper = np.where(known, upper + moved[cluster], np.inf) * (1 + WIDER) + APART
    far = np.sort(moved)[::-1]
    # The others' largest movement: that of the second where the own centroid moved most.
    others = np.where(moved[cluster] == far[0], far[1] if len(far) > 1 else 0.0, far[0])
    lower = np.where(known, lower - others, 0.0) * (1 - WIDER) - APART
    between = np.sqrt(squared(centroids, centroids).astype(np.float64))
    np.fill_diagonal(between, np.inf)
    half = between.min(axis=1) / 2 * (1 - WIDER) - APART
    bound = np.maximum(lower, np.where(known, half[cluster], -np.inf))
    open_ = np.flatnonzero(~(upper < bound))
    mine = open_[known[open_]]
    if len(mine):  # the exact distance to the own centroid may settle it
        apart = q[mine] - centroids[cluster[mine]]
        upper[mine] = np.sqrt(np.einsum("ij,ij->i", apart, apart).astype(np.float64)) * (1 + WIDER) + APART
        open_ = open_[~(upper[open_] < bound[open_])]
    if len(open_):
        d = squared(q[open_], centroids)
        near = d.argmin(axis=1)  # the smaller number among equals
        cluster[open_] = near
        rows = np.arange(len(open_))
        upper[open_] = np.sqrt(d[rows, near].astype(np.float64)) * (1 + WIDER) + APART
        if len(centroids) > 1:
            second = np.partition(d, 1, axis=1)[:, 1]
            lower[open_] = np.sqrt(second.astype(np.float64)) * (1 - WIDER) - APART
        else:
            lower[open_] = np.inf
    return cluster, upper, lower, len(open_)


def _vectors(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _round(centroids: np.ndarray, moved: np.ndarray, last: bool):
    """Rows (vec_id, q, cluster, upper, lower) settled anew, with the cluster before; the last round gives exact distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _vectors(batch.column(1))
            was = batch.column(2).to_numpy()
            cluster, upper, lower, scans = settle(q, was, batch.column(3).to_numpy(), batch.column(4).to_numpy(), centroids, moved)
            if last:
                apart = q - centroids[cluster]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(np.einsum("ij,ij->i", apart, apart))], ["vec_id", "cluster", "distance"])
            else:
                scanned = np.zeros(len(q), np.int32)
                scanned[0] = scans
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), batch.column(2), pa.array(scanned)], ["vec_id", "q", "cluster", "upper", "lower", "was", "scans"])

    return run


def _partial(k: int):
    """Per task and cluster: how many vectors joined less those that left, and their component sums likewise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = counts = None
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _vectors(batch.column(0))
            if sums is None:
                sums, counts = np.zeros((k, q.shape[1]), np.int64), np.zeros(k, np.int64)
            for column, sign in ((1, 1), (2, -1)):
                to = batch.column(column).to_numpy()
                for c in np.unique(to[to >= 0]):
                    sums[c] += sign * q[to == c].sum(axis=0)
                    counts[c] += sign * np.count_nonzero(to == c)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(np.column_stack([counts, sums]).tolist(), pa.list_(pa.int64()))], ["c", "sums"])

    return run


def _gathered(rows: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Component sums and counts of what joined each cluster less what left it. Vectors that stay send nothing, tasks one row a cluster."""
    parts = rows.where("cluster <> was").select("q", "cluster", "was").mapInArrow(_partial(k), "c int, sums array<long>")
    sums = np.zeros((k, dims + 1), object)
    for r in parts.select("c", F.posexplode("sums").alias("i", "s")).groupBy("c", "i").agg(F.sum("s").alias("s")).collect():
        sums[r["c"], r["i"]] = r["s"]
    return sums[:, 1:], sums[:, 0]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", scans: list[int] | None = None) -> DataFrame:
    """One row per kept vector (``integer_vectors``): vec_id, cluster, distance (squared), cluster_inertia and inertia (distances
    summed over its cluster and over all), centroid_sha256 (of its centroid's components joined by commas).

    Centroids start as the ``k`` vectors of ``seeds``. Each round assigns every vector to the nearest centroid, the smaller number
    among equals, and replaces each non-empty centroid by the exact floor of its vectors' mean; an empty one stays. Vectors are
    then assigned once more. Fewer than ``k`` vectors make as many centroids; none, an empty table. Rows that repeat count as
    often as they come; null ids are kept, and seeds only after all others. Sums of distances beyond a long are null. Only the
    two named columns are read. ``scans``: gets the number of vectors that each round scanned fully.
    """
    spark = vectors.sparkSession
    ensure_workers(spark)
    scratch = Scratch(spark, "clustering")
    id_type = vectors.schema[id_col].dataType.simpleString()
    start = integer_vectors(vectors, dims, scale, id_col, vector_col)
    rows = scratch.save(start.select("*", F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")), "vectors")
    centroids = seeds(rows, k, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".replace("long", id_type, 1)
    if not len(centroids):
        return spark.createDataFrame([], out)
    k = len(centroids)
    sums, counts = np.zeros((k, dims), object), np.zeros(k, object)
    moved = np.zeros(k)
    schema = f"vec_id {id_type}, q array<int>, cluster int, upper double, lower double, was int, scans int"
    for _ in range(rounds):
        past, rows = rows, scratch.save(rows.select("vec_id", "q", "cluster", "upper", "lower").mapInArrow(_round(centroids, moved, False), schema), "round")
        scratch.drop(past)
        if scans is not None:
            scans.append(rows.agg(F.sum("scans")).first()[0])
        more, n = _gathered(rows, k, dims)
        sums, counts = sums + more, counts + n
        after = np.array([[s // n for s in row] if n else list(old) for row, n, old in zip(sums, counts, centroids.tolist(), strict=True)], np.int64)
        moved = np.sqrt(((after - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + WIDER)
        centroids = after
    last = rows.select("vec_id", "q", "cluster", "upper", "lower").mapInArrow(_round(centroids, moved, True), f"vec_id {id_type}, cluster int, distance long")
    last = scratch.save(last, "clusters")
    scratch.drop(rows)
    per = {r["cluster"]: r["d"] for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    long_or_null = lambda x: int(x) if x < 1 << 63 else None
    whole = long_or_null(sum(per.values()))
    table = [(c, long_or_null(d), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in per.items()]
    totals = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most k rows.
    return last.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
