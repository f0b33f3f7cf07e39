"""Connected components by contraction, in written rounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ensure_workers

#: Edges gathered in a task before they are folded into its forest.
FOLD = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the edges that isn't itself the least of its component, its root."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while (label[a] != label[b]).any():
        one, two = label[a], label[b]
        low = np.minimum(one, two)
        np.minimum.at(label, one, low)
        np.minimum.at(label, two, low)
        while (label[label] != label).any():
            label = label[label]
    inner = np.flatnonzero(label != np.arange(len(label)))
    return names[inner], names[label[inner]]


def _local_stars(batches: Iterator[pa.RecordBatch], roots: bool = False) -> Iterator[pa.RecordBatch]:
    """The stars of a task's edges; what it holds is bounded by the nodes of its split. Folds double, so they cost as much as one.

    ``roots`` adds a row of itself for each root.
    """
    u = v = np.zeros(0, np.int64)
    held, waiting = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        waiting += batch.num_rows
        if waiting >= max(FOLD, len(u)):
            u, v = stars(*(np.concatenate(x) for x in zip((u, v), *held, strict=True)))
            held, waiting = [], 0
    if held:
        u, v = stars(*(np.concatenate(x) for x in zip((u, v), *held, strict=True)))
    if roots:
        own = np.unique(v)
        u, v = np.concatenate([u, own]), np.concatenate([v, own])
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame, scratch: Scratch, fold: int = FOLD) -> DataFrame:
    """(node, root) for every node of ``edges`` (long u, long v) that another node is linked to; nodes have equal roots iff a path links them.

    In a round each task first puts the stars of its own edges in their place, which keeps all nodes and what is connected.
    Each node then points to the least of its neighbours and itself, and edges are drawn between what their ends point to.
    Least goes by the node in odd rounds, which ends stars at once, and by a hash made anew in even ones, which takes away a
    constant share of the nodes whatever the graph's shape, so rounds grow with the logarithm of the nodes at most. Minima
    are aggregated before the shuffle, so hubs don't pile up. A round has no more tasks than one for each ``fold`` edges, so
    the stars of a round of at most so many edges, found in one task, are the last. Rounds shrink; their pointers are joined
    up at the end, the last and smallest first.
    """
    ensure_workers(edges.sparkSession)
    at_first = edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    edges, hops = scratch.save(at_first, "edges"), []
    while rows := edges.count():
        tasks = -(-rows // fold)
        if tasks == 1:
            last = edges.coalesce(1).mapInArrow(partial(_local_stars, roots=True), "old long, new long")
            hops.append(scratch.save(last, "hop"))
            scratch.drop(edges)
            break
        odd = len(hops) % 2 == 0
        ranked = lambda c: F.struct((F.lit(0) if odd else F.xxhash64(F.lit(len(hops)), F.col(c))).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        local = scratch.save(edges.coalesce(tasks).mapInArrow(_local_stars, "u long, v long"), "stars")
        both = local.unionByName(local.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(ranked("v")).alias("near"))
        hop = scratch.save(best.select(F.col("u").alias("old"), F.least("near", ranked("u")).getField("n").alias("new")), "hop")
        hops.append(hop)
        step = local.join(hop, F.col("u") == F.col("old")).select(F.col("new").alias("u"), "v")
        step = step.join(hop, F.col("v") == F.col("old")).select("u", F.col("new").alias("v"))
        past = (edges, local)
        edges = scratch.save(step.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        for table in past:
            scratch.drop(table)
    if not hops:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    at = hops[-1].select(F.col("old").alias("node"), F.col("new").alias("root"))
    for hop in reversed(hops[:-1]):
        later = at.select(F.col("node").alias("past"), "root")
        at = hop.join(later, F.col("new") == F.col("past"), "left").select(F.col("old").alias("node"), F.coalesce("root", "new").alias("root"))
    at = scratch.save(at, "nodes")
    for hop in hops:
        scratch.drop(hop)
    return at
