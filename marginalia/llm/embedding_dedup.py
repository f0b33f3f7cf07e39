"""Embedding near-dedup: codes by iterative quantisation, retrieval through multi-index Hamming tables, reranking by cosine.

Rotations are learned on half of a bounded sample (``SAMPLE``): principal directions of the centred sample are turned until their signs
lose least, and each direction is cut at the sample's median, so that bits are balanced. Several rotations, each begun from another
random turn, give as many bits as are needed. The bits are cut into tables of ``bits`` each; two vectors meet where they agree in
all bits of a table. How many tables it takes is measured, not assumed: partners are made at exactly the threshold's angle from the
vectors of the sample's other half, and tables are added until the wanted share of them meets. (On those it is learned from, a
rotation does better than on others.) The width follows the logarithm of the number of vectors,
so that a bucket holds about ``BUCKET`` of them at any size.

Equal vectors are first reduced to one representative with its number of copies. In a bucket, representatives are compared by
cosine in double precision; buckets over ``TILE`` rows are split into tiles, whose pairs go to tasks of their own. A pair that
meets in several tables counts in the first of them, which both codes tell, so links are counted where they are found: a task
gives back one row per representative and bucket, with its links and a neighbour that stands for all it is connected to there.
Pairs are never written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ensure_workers
from .components import components, stars

SAMPLE = 8192
BUCKET = 64
TILE = 512
MAX_TABLES = 128
#: Rows of counts of large buckets that are broadcast; more go through a shuffle.
BROADCAST_BUCKETS = 1 << 16
ROUNDS = 30


def quantise(sample: np.ndarray, rng: np.random.Generator, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(directions, cuts) of iterative quantisation over centred rows: the signs of ``x @ directions - cuts`` are the bits."""
    mean = sample.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov(sample.T, bias=True).reshape(sample.shape[1], -1))
    projected = (sample - mean) @ axes
    turn, _ = np.linalg.qr(rng.normal(size=axes.shape))
    for _ in range(rounds):
        signs = np.where(projected @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ projected)
        turn = (left @ right).T
    directions = axes @ turn
    return directions, np.median(sample @ directions, axis=0)


@dataclass(frozen=True)
class Tables:
    """``bits`` bits a table, ``count`` tables, and the directions and cuts that give the bits; for vectors of ``dims`` components."""

    dims: int
    bits: int
    count: int
    directions: np.ndarray
    cuts: np.ndarray
    expected: float

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A key per table for rows of length one. Vectors of another length get directions of their own, drawn, not learned."""
        directions, cuts = self.directions, self.cuts
        if unit.shape[1] != self.dims:
            directions, cuts = np.random.default_rng(unit.shape[1]).normal(size=(unit.shape[1], len(self.cuts))), np.zeros(len(self.cuts))
        set_ = (unit @ directions > cuts).reshape(len(unit), self.count, self.bits)
        return (set_ * (1 << np.arange(self.bits, dtype=np.int64))).sum(axis=2)


def partners(unit: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each row one at exactly this cosine from it, in a random direction."""
    aside = rng.normal(size=unit.shape)
    aside -= (aside * unit).sum(axis=1, keepdims=True) * unit
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.divide(aside, length, out=np.zeros_like(aside), where=length > 1e-9)
    other = cosine * unit + math.sqrt(1 - cosine * cosine) * aside
    return other / np.linalg.norm(other, axis=1, keepdims=True)


def learn(sample: np.ndarray, vectors: int, threshold: float, recall: float, seed: int = 0) -> Tables:
    """Tables in which at least ``recall`` of partners at the threshold meet. Where ``MAX_TABLES`` don't reach that, they get narrower."""
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    half, unit = (unit[::2], unit[1::2]) if len(unit) > 1 else (unit, unit)
    other = partners(unit, threshold, rng)
    directions, cuts = np.empty((unit.shape[1], 0)), np.empty(0)
    same = np.empty((len(unit), 0), bool)
    bits = max(1, min(32, math.ceil(math.log2(max(2, vectors / BUCKET)))))
    while True:
        met = np.zeros(len(unit), bool)
        for table in range(MAX_TABLES):
            while len(cuts) < (table + 1) * bits:
                more, at = quantise(half, rng)
                same = np.hstack([same, (unit @ more > at) == (other @ more > at)])
                directions, cuts = np.hstack([directions, more]), np.concatenate([cuts, at])
            met |= same[:, table * bits : (table + 1) * bits].all(axis=1)
            if met.mean() >= recall:
                used = (table + 1) * bits
                return Tables(unit.shape[1], bits, table + 1, directions[:, :used], cuts[:used], float(met.mean()))
        if bits == 1:
            return Tables(unit.shape[1], 1, MAX_TABLES, directions[:, :MAX_TABLES], cuts[:MAX_TABLES], float(met.mean()))
        bits -= 1


def _units(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a batch at length one, in runs of equal numbers of components (in order)."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bounds = np.flatnonzero(np.diff(sizes, prepend=-1))
    out, at = [], 0
    for lo, hi in zip(bounds, [*bounds[1:], len(sizes)], strict=True):
        n = (hi - lo) * sizes[lo]
        rows = flat[at : at + n].reshape(hi - lo, sizes[lo])
        rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that no square under- or overflows
        out.append(rows / np.linalg.norm(rows, axis=1, keepdims=True))
        at += n
    return out


def _code(tables: Tables, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = np.vstack([tables.keys(unit) for unit in _units(batch.column("v"))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], [*batch.schema.names, "keys"])


def _links(unit: np.ndarray, keys: np.ndarray, left: np.ndarray, right: np.ndarray, table: int, threshold: float, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs between ``left`` and ``right`` (places too; the same ones give each pair once) that meet in no
    earlier table."""
    us, vs = [], []
    narrow = unit.astype(np.float32)
    same = left is right
    for lo in range(0, len(left), step):
        a = left[lo : lo + step]
        b = right[lo:] if same else right
        i, j = np.nonzero(narrow[a] @ narrow[b].T >= threshold - 1e-4)
        if same:
            once = j > i
            i, j = i[once], j[once]
        i, j = a[i], b[j]
        if table:
            first = np.concatenate([~(keys[i[k : k + 65536], :table] == keys[j[k : k + 65536], :table]).any(axis=1) for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
            i, j = i[first], j[first]
        exact = np.concatenate([np.einsum("ij,ij->i", unit[i[k : k + 65536]], unit[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
        us.append(i[exact >= threshold])
        vs.append(j[exact >= threshold])
    return np.concatenate(us), np.concatenate(vs)


def _compare(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of tile pairs in; per representative with links its links, weighed by copies, and one it is connected to."""

    def settle(rows: pa.Table) -> pa.RecordBatch | None:
        table, lo, hi = (rows.column(c)[0].as_py() for c in ("table", "lo", "hi"))
        if len(rows) < 2:
            return None
        (unit,) = _units(rows.column("v").combine_chunks())
        keys = rows.column("keys").combine_chunks()
        keys = keys.flatten().to_numpy().reshape(len(rows), -1)
        tile = rows.column("tile").to_numpy()
        left = np.flatnonzero(tile == lo)
        right = left if lo == hi else np.flatnonzero(tile == hi)
        u, v = _links(unit, keys, left, right, table, threshold)
        if not len(u):
            return None
        reps, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        n = np.zeros(len(rows), np.int64)
        np.add.at(n, u, copies[v])
        np.add.at(n, v, copies[u])
        some = np.flatnonzero(n)
        root = dict(zip(*(x.tolist() for x in stars(reps[u], reps[v])), strict=True))
        mine = reps[some]
        return pa.RecordBatch.from_arrays([pa.array(mine), pa.array([root.get(r, r) for r in mine.tolist()], pa.int64()), pa.array(n[some])], ["u", "v", "n"])

    held: pa.Table | None = None
    names = ["table", "key", "dims", "lo", "hi"]
    for batch in batches:
        if not batch.num_rows:
            continue
        here = pa.Table.from_batches([batch])
        here = pa.concat_tables([held, here]) if held is not None else here
        ids = np.column_stack([here.column(c).to_numpy() for c in names])
        starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if (done := settle(here.slice(lo, hi - lo))) is not None:
                yield done
        held = here.slice(starts[-1])
    if held is not None and (done := settle(held)) is not None:
        yield done


def link_counts(reps: DataFrame, tables: Tables, threshold: float, scratch: Scratch) -> DataFrame:
    """(u, v, n) of ``_compare`` over all buckets of all tables, from (rep, v, copies)."""
    kind = reps.schema["v"].dataType.simpleString()
    coded = scratch.save(reps.select("rep", "copies", "v").mapInArrow(partial(_code, tables), f"rep long, copies long, v {kind}, keys array<long>"), "codes")
    entries = coded.select("rep", "copies", "v", "keys", F.size("v").alias("dims"), F.posexplode("keys").alias("table", "key"))
    large = entries.groupBy("table", "key", "dims").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > TILE)
    large = scratch.save(large.select("table", "key", "dims", F.ceil(F.col("rows") / TILE).cast("int").alias("tiles")), "large-buckets")
    side = F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large.hint("merge")
    tiled = entries.join(side, ["table", "key", "dims"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("rep", "table"), F.col("tiles")).cast("int"))
    paired = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    paired = paired.select("table", "key", "dims", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "rep", "copies", "v", "keys")
    group = ["table", "key", "dims", "lo", "hi"]
    return paired.repartition(*group).sortWithinPartitions(*group).mapInArrow(partial(_compare, threshold), "u long, v long, n long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: its id, n_links (other rows linked to it), component_id (the smallest id reachable by links, its
    own included), kept (its id is the component's).

    Rows link whose vectors have a cosine of ``threshold`` or more; no pair below it links, and at least about ``recall`` of pairs
    just at it are found, more the closer they are, all of them if equal. Null and empty vectors, zero vectors and those with null or
    non-finite components link with nothing. Vectors link only with those of as many components. Null ids are smaller than none: a
    component of null ids alone has a null id, and its rows are kept. Rows that repeat are rows of their own. An empty table gives
    an empty one. Only the two named columns are read.
    """
    spark = vectors.sparkSession
    ensure_workers(spark)
    scratch = Scratch(spark, "embedding-dedup")
    v = F.col(vector_col)
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    reps = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    reps = scratch.save(reps.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    alone = rows.where("v is null").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    common = reps.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    if common is None:
        return alone
    sample = reps.where(F.size("v") == common["dims"]).select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    sample = np.array([r["v"] for r in sample], np.float64)
    tables = learn(sample / np.abs(sample).max(axis=1, keepdims=True), common["n"], threshold, recall)
    found = scratch.save(link_counts(reps, tables, threshold, scratch), "links")
    counts = found.groupBy("u").agg(F.sum("n").alias("n"))
    roots = components(found.where("u <> v").select("u", "v"), scratch)
    named = reps.select("rep", "v", "least", "copies").join(counts.withColumnRenamed("u", "rep"), "rep", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    named = scratch.save(named.select("v", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "named")
    # Written, so that the joins have an exchange on both sides and a component, or a vector, of a third of all rows can be split.
    least = scratch.save(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = scratch.save(named.join(least.hint("merge"), "root").select("v", "n_links", "component_id"), "verdicts")
    linked = rows.where("v is not null").join(named.hint("merge"), "v").select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
