"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt into tiles by the population counts of their four 16-bit parts. Two fingerprints within
the radius differ by at most the radius in the sum of those counts' differences, so a pair of tiles whose counts differ
by more is skipped without loss. Tiles are cut into blocks of bounded size; each remaining pair of blocks is compared
whole with numpy's exclusive-or and bit counts. From a pair of blocks only a spanning forest of its links is kept, never
all pairs, which loses no component. Components are then found over the links.

``near_duplicates`` links 64-bit fingerprints. ``drop_similar`` finds near copies by the similarity of their shingles: 256-bit
fingerprints, compared where texts share a shingle of their prefixes, give the candidates, whose shingles are then compared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ensure_workers, text_or_empty
from .components import components, stars

PARTS, PART_BITS = 4, 16
#: Fingerprints in a block, about.
BLOCK = 2048
_MASK_BATCH = 1 << 14


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Bits set in over half the XXH64 hashes of the text's word shingles (A-Z lower-cased, repeats counted); no words: 0."""
    data = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return 0
    ends = [i for i, c in enumerate(data) if c == 32] if len(data) < 64 else np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist()
    starts = [0, *(i + 1 for i in ends)]
    ends.append(len(data))
    hash64 = xxhash.xxh64_intdigest
    if len(starts) <= words:
        return hash64(data, seed)
    n = len(starts) - words + 1
    view = memoryview(data)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _MASK_BATCH):
        stop = min(n, at + _MASK_BATCH)
        h = np.fromiter((hash64(view[a:b], seed) for a, b in zip(starts[at:stop], ends[at + words - 1 : stop + words - 1], strict=True)), np.uint64, stop - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * int(counts[i]) > n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint as a signed long."""
    ensure_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def _tile(fp: str) -> Column:
    """The parts' population counts as one number, a decimal pair of digits each."""
    out = F.lit(0)
    for k in range(PARTS):
        out = out * 100 + F.bit_count(F.shiftrightunsigned(fp, PART_BITS * k).bitwiseAND(F.lit((1 << PART_BITS) - 1).cast("long")))
    return out.cast("int")


def _tile_steps(radius: int) -> list[int]:
    """Differences of tile numbers, zero and upwards, of all count vectors within the radius."""
    moves = [m for m in itertools.product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, m)) <= radius]
    numbers = [sum(d * 100 ** (PARTS - 1 - k) for k, d in enumerate(m)) for m in moves]
    return sorted(x for x in numbers if x >= 0)


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph that joins a's and b's fingerprints within the radius."""
    hits_a, hits_b = [], []
    for at in range(0, len(a), 256):
        near = np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius
        if near.any():
            i, j = np.nonzero(near)
            hits_a.append(i + at)
            hits_b.append(j)
    if not hits_a:
        return a[:0], a[:0]
    i, j = np.concatenate(hits_a), np.concatenate(hits_b)
    if same:
        i, j = i[i < j], j[i < j]
    else:
        j = j + len(a)
    nodes = np.concatenate([a, b])
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    inner = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[inner], nodes[label[inner]]


def links(fps: DataFrame, scratch: Scratch, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints of ``fps`` (fp) within the radius of each other."""
    tiled = scratch.save(fps.select("fp", _tile("fp").alias("tile")), "tiled")
    # At most 17 ** 4 = 83,521 tiles, whatever the input.
    sizes = scratch.save(tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "sizes")
    dealt = tiled.join(F.broadcast(sizes), "tile").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    packed = scratch.save(dealt.groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")), "packed")
    steps = F.array(*[F.lit(s) for s in _tile_steps(radius)])
    sent = packed.select("tile", "block", F.col("fps").alias("a"), F.explode(F.transform(steps, lambda s: s + F.col("tile"))).alias("to"))
    sent = sent.join(F.broadcast(sizes.withColumnRenamed("tile", "to")), "to")
    first = F.when(F.col("to") == F.col("tile"), F.col("block")).otherwise(F.lit(0))
    sent = sent.select("a", (F.col("to") == F.col("tile")).alias("own"), F.col("block").alias("from_block"), "to", F.explode(F.sequence(first, F.col("blocks") - 1)).alias("to_block"))
    right = packed.select(F.col("tile").alias("to"), F.col("block").alias("to_block"), F.col("fps").alias("b"))
    pairs = sent.join(right, ["to", "to_block"]).select("a", "b", (F.col("own") & (F.col("from_block") == F.col("to_block"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            cols = []
            for k in (0, 1):
                lists = batch.column(k)
                cols.append((lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()))
            (av, ao), (bv, bo) = cols
            for r, same in enumerate(batch.column(2).to_pylist()):
                u, v = _forest(av[ao[r] : ao[r + 1]], bv[bo[r] : bo[r + 1]], same, radius)
                if len(u):
                    us.append(u)
                    vs.append(v)
            none = np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x]).view(np.int64)) for x in (us, vs)], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def _placed(rows: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """``rows`` (id, fp and others) with root, a fingerprint of the component, and component_id."""
    least = scratch.save(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(scratch.save(links(least, scratch, radius), "links"), scratch)
    placed = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = scratch.save(placed.join(best, "root").select("fp", "root", "component_id"), "components")
    return rows.join(of_fp, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint (16 hex digits) and component_id, the smallest id of all it is linked to.

    Null text counts as empty; texts without words have fingerprint zero and are linked like others. Null ids pass through
    and are never a component's id unless it has no other. Repeated rows stay. An empty table gives an empty one. Only
    the two named columns are read. No link within the radius is lost, and equal fingerprints are compared once.
    """
    ensure_workers(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    return _placed(rows, scratch, radius).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by shingle similarity: wide fingerprints.

WIDE_WORDS, WIDE_RADIUS = 4, 56
#: Fingerprints in a block of the grid: about a twelfth of all, within these bounds.
GRID, GRID_LEAST, GRID_MOST = 12, 4096, 1 << 17
#: The same where nodes carry their sets, whose bytes in a block are bounded too, about.
SETS_LEAST, SETS_BYTES = 1024, 32 << 20
#: Nodes that share a key and are compared in place; nodes of keys with more meet in the grid.
KEY_MOST = 1000
#: Texts whose shingles show which are common, how many of them a common one is in at least, and how many common ones are told apart.
SEEN, COMMON, COMMON_MOST = 2000, 5, 50_000
#: Tiles of components in the grid, at most.
TILES = 1024
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)  # fixed constants of the splitmix64 generator


def shingle_hashes(text: str, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 hashes of the text's word shingles (A-Z lower-cased; fewer words: the whole sequence; none: nothing)."""
    data = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return np.zeros(0, np.uint64)
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(data)]
    k = min(words, len(starts))
    view, hash64 = memoryview(data), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hash64(view[a:b], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)), np.uint64, len(starts) - k + 1))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256 bits, each set in over half of a text's shingles, as four 64-bit words; each shingle's hash seeds four steps of splitmix64.

    Two texts whose sets of shingles have Jaccard similarity s differ in about arccos(2 s / (1 + s)) / pi of the bits: 39 at
    0.8, 128 if they share nothing. No shingles: zeros.
    """
    counts = np.zeros(64 * WIDE_WORDS, np.int64)
    for at in range(0, len(hashes), _MASK_BATCH):
        x = hashes[at : at + _MASK_BATCH, None] + np.arange(1, WIDE_WORDS + 1, dtype=np.uint64) * np.uint64(_MIX[2])
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def prefix_keys(hashes: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first of a text's sorted shingles, so many that two texts with a similarity of ``least`` share at least one: what is left out
    is less than the overlap that they need. The order is by hash, ``common`` (sorted) ones last; any order gives the same links."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: len(hashes) - math.ceil(least * len(hashes) - 1e-9) + 1]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes; two empty ones are alike."""
    joint = np.concatenate([a, b])
    joint.sort(kind="stable")  # merges the two sorted runs
    both = int(np.count_nonzero(joint[1:] == joint[:-1]))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def wide_distance(a: np.ndarray, b: np.ndarray) -> int:
    return int(np.bitwise_count(a ^ b).sum())


def _wide_hits(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of a's and b's fingerprints within the radius, a strip of a at a time. The first words sort out most pairs."""
    strip = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), strip):
        part = a[at : at + strip]
        far = np.bitwise_count(part[:, None, 0] ^ b[None, :, 0])
        far += np.bitwise_count(part[:, None, 1] ^ b[None, :, 1])
        i, j = np.nonzero(far <= radius)
        if len(i):
            near = np.bitwise_count(part[i] ^ b[j]).sum(axis=1, dtype=np.int64) <= radius
            yield i[near] + at, j[near]


class Side:
    """One side of a cell of the grid."""

    def __init__(self, table: pa.Table):
        self.words = np.stack([table.column(c).to_numpy() for c in _W], axis=1).view(np.uint64)
        self.node, self.label = table.column("node").to_numpy(), table.column("label").to_numpy()
        self.sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in table.column("hashes")] if "hashes" in table.column_names else None


def _forest_links(a: Side, b: Side, same: bool, radius: int) -> tuple[np.ndarray, ...]:
    """A spanning forest of the links, grown strip by strip, so that never all links are held."""
    names = a.node if same else np.concatenate([a.node, b.node])
    label, shift = np.arange(len(names)), 0 if same else len(a.node)
    for i, j in _wide_hits(a.words, b.words, radius):
        j = j + shift
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while (label[label] != label).any():
                label = label[label]
            if (label == before).all():
                break
    inner = np.flatnonzero(label != np.arange(len(label)))
    return names[inner], names[label[inner]], np.zeros(len(inner), np.int64)


def _nearest(a: Side, b: Side, same: bool, radius: int) -> tuple[np.ndarray, ...]:
    """For each node the nearest of another label within the radius, and its distance."""
    out = []
    for one, two in ((a, b),) if same else ((a, b), (b, a)):
        for i, j in _wide_hits(one.words, two.words, radius):
            cross = one.label[i] != two.label[j]
            i, j = i[cross], j[cross]
            far = np.bitwise_count(one.words[i] ^ two.words[j]).sum(axis=1, dtype=np.int64)
            order = np.lexsort((two.node[j], far, i))
            first = order[np.flatnonzero(np.diff(i[order], prepend=-1))] if len(order) else order
            out.append((one.node[i[first]], two.node[j[first]], far[first]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *column]) for column in zip(*out, strict=True)) if out else (none,) * 3


def _crossing(least: float) -> Callable[..., tuple[np.ndarray, ...]]:
    """Links between nodes of different labels whose sets are alike by ``least``: enough of them to connect all labels they join.

    Each pair within the radius is checked here, beside its sets, so no pair leaves a cell but a link that joins two groups.
    """

    def work(a: Side, b: Side, same: bool, radius: int) -> tuple[np.ndarray, ...]:
        _, at = np.unique(np.concatenate([a.label, b.label]), return_inverse=True)
        la, lb = at[: len(a.label)], at[len(a.label) :]
        size_a, size_b = (np.array([len(h) for h in x.sets], np.int64) for x in (a, b))
        parent = list(range(at.max() + 1))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        group = np.arange(at.max() + 1)
        us, vs = [], []
        for i, j in _wide_hits(a.words, b.words, radius):
            # A smaller share in size alone rules the similarity out.
            keep = (group[la[i]] != group[lb[j]]) & (np.minimum(size_a[i], size_b[j]) >= least * np.maximum(size_a[i], size_b[j]))
            if same:
                keep &= i < j
            found = len(us)
            for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
                one, two = root(la[x]), root(lb[y])
                if one != two and similarity(a.sets[x], b.sets[y]) >= least:
                    parent[max(one, two)] = min(one, two)
                    us.append(a.node[x])
                    vs.append(b.node[y])
            if len(us) > found:
                group = np.array([root(x) for x in range(len(parent))])
        u, v = (np.array(x, np.int64) for x in (us, vs))
        return u, v, np.zeros(len(u), np.int64)

    return work


_W = tuple(f"w{k}" for k in range(WIDE_WORDS))


def compare(nodes: DataFrame, scratch: Scratch, work: Callable[..., tuple[np.ndarray, ...]], radius: int = WIDE_RADIUS, block: int | None = None) -> DataFrame:
    """What ``work`` finds (u, v, far) among all ``nodes`` (node, label, w0 to w3) within the radius of each other.

    Tiles are bands of population counts, one more than the radius wide, so tiles that aren't next to each other are skipped.
    A tile's blocks and its neighbour's make a grid of pairs of blocks; a node goes once to each of its pairs, with its set
    (hashes) if it has that column. If nodes have a ``root``, only those of one root need to meet: tiles are then of whole roots.
    """
    carried = ["node", "label", *_W, *(c for c in nodes.columns if c == "hashes")]
    count = F.bit_count(_W[0])
    for c in _W[1:]:
        count = count + F.bit_count(c)
    tile, steps = F.floor(count / (radius + 1)), (-1, 0, 1)
    if "root" in nodes.columns:
        nodes = scratch.save(nodes, "rooted")
        tile, steps = F.pmod(F.xxhash64("root"), F.lit(max(1, min(TILES, nodes.count() // GRID_LEAST)))), (0,)
    tiled = scratch.save(nodes.select(*carried, tile.cast("int").alias("tile")), "bands")
    block = block or min(GRID_MOST, max(GRID_LEAST, -(-tiled.count() // GRID)))
    # At most 257 bands, or TILES.
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).collect()
    cells = F.map_from_entries(F.array(*[F.struct(F.lit(r["tile"]), F.lit(r["blocks"])) for r in sizes])) if sizes else F.lit(None).cast("map<int,int>")
    blocks = lambda t: F.try_element_at(cells, t)
    partners = lambda t: F.when(blocks(t).isNotNull(), F.transform(F.sequence(F.lit(0), F.coalesce(blocks(t), F.lit(1)) - 1), lambda k: F.struct(t.alias("t"), k.alias("k")))).otherwise(F.array().cast("array<struct<t:int,k:int>>"))
    me = F.struct(F.col("tile").alias("t"), F.pmod(F.xxhash64("node"), blocks(F.col("tile"))).cast("int").alias("k"))
    sent = tiled.select(*carried, me.alias("me"), F.explode(F.concat(*[partners((F.col("tile") + d).cast("int")) for d in steps])).alias("other"))
    sent = sent.select(F.least("me", "other").alias("one"), F.greatest("me", "other").alias("two"), (F.col("me") <= F.col("other")).alias("first"), *carried)

    def run(table: pa.Table) -> pa.Table:
        same = table.column("one")[0] == table.column("two")[0]
        a = Side(table if same else table.filter(table.column("first")))
        b = a if same else Side(table.filter(pc.invert(table.column("first"))))
        return pa.table(dict(zip(("u", "v", "far"), work(a, b, same, radius), strict=True)))

    return sent.groupBy("one", "two").applyInArrow(run, "u long, v long, far long")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of ``pairs`` (u, v) those whose ``sets`` (node, hashes) have a similarity of ``least`` or more."""
    side = lambda c, h: sets.select(F.col("node").alias(c), F.col("hashes").alias(h))
    both = pairs.select("u", "v").distinct().join(side("u", "a").hint("merge"), "u").join(side("v", "b").hint("merge"), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) >= least for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def _key_pairs(ends: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i, j) within lists that lie one after the other, each place's list ending at ``ends``; about ``most`` at a time."""
    after = ends - np.arange(len(ends)) - 1
    upto = np.cumsum(after)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most)))
        n = after[at:stop]
        i = np.repeat(np.arange(at, at + len(n)), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = stop


def key_links(nodes: DataFrame, scratch: Scratch, least: float, radius: int = WIDE_RADIUS, block: int | None = None, most: int = KEY_MOST) -> DataFrame:
    """Links (u, v) that connect all ``nodes`` (node, size, keys, w0 to w3) within the radius of each other that share a key and
    whose sizes allow a similarity of ``least``. Nodes of keys that more than ``most`` have are compared in the grid, each pair once."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    counts = scratch.save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    shared = keyed.join(counts.where(F.col("n") <= most).select("key").hint("merge"), "key")
    member = F.struct("node", F.col("size").cast("long").alias("size"), *_W)
    lists = shared.join(nodes.select("node", "size", *_W).hint("merge"), "node").groupBy("key").agg(F.collect_list(member).alias("all")).select("all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            lists = batch.column(0)
            ends = np.diff(lists.offsets.to_numpy())
            ends = np.repeat(np.cumsum(ends), ends)
            node, size, *words = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            words = [w.view(np.uint64) for w in words]
            us, vs = [none], [none]
            for i, j in _key_pairs(ends):
                keep = np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9
                i, j = i[keep], j[keep]
                far = np.zeros(len(i), np.int64)
                for w in words:
                    far += np.bitwise_count(w[i] ^ w[j])
                i, j = i[far <= radius], j[far <= radius]
                u, v = stars(node[i], node[j]) if len(i) else (none, none)
                us.append(u)
                vs.append(v)
            u, v = np.concatenate(us), np.concatenate(vs)
            u, v = stars(u, v) if len(u) else (none, none)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    links = lists.mapInArrow(run, "u long, v long")
    many = counts.where(F.col("n") > most)
    if many.isEmpty():
        return links
    often = keyed.join(many.select("key").hint("merge"), "key", "left_semi").select("node").distinct()
    often = nodes.select("node", F.col("node").alias("label"), *_W).join(often.hint("merge"), "node")
    return links.unionByName(compare(often, scratch, _forest_links, radius, block).select("u", "v"))


def similar_groups(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], scratch: Scratch, least: float = 0.8, radius: int = WIDE_RADIUS, block: int | None = None) -> DataFrame:
    """(node, root) of ``nodes`` (node, size, keys, w0 to w3) linked to others: links are pairs within the radius whose sets are alike by
    ``least``. ``sets_of``: gives the sets (node, hashes) of some nodes (node).

    Nodes that are alike share a key, so those of a key are compared, which gives components of nodes within the radius. What is in
    different components is never alike. Inside components, nodes are checked against the root,
    then in rounds each against the nearest node of another group, which merges groups without listing their pairs; at last
    all pairs that are left between different groups are checked in the cells that compare them, so no link is lost. Only nodes
    that the last round still found near another group go there with their sets: groups merge and never part, so the others
    have no such pair.
    """
    wide = components(scratch.save(key_links(nodes, scratch, least, radius, block), "links"), scratch)
    wide = scratch.save(wide, "wide")
    inside = scratch.save(nodes.join(wide, "node").select("node", *_W, "root"), "inside")
    total = inside.count()
    if not total:
        return wide
    sets = scratch.save(sets_of(inside.select("node")), "sets")
    # Those alike to their root have its label; labels then merge, so each round's graph holds new links only.
    stars = _alike(wide.where("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v")), sets, least)
    at = inside.join(stars.select("u", "v"), F.col("node") == F.col("v"), "left").select("node", F.coalesce("u", "node").alias("label"), *_W, "root")
    at = scratch.save(at, "labelled")

    def merge(at: DataFrame, new: DataFrame) -> DataFrame:
        one, two = (at.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("u", "v"))
        roots = components(new.join(one, "u").join(two, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v")), scratch)
        roots = roots.select(F.col("node").alias("old"), F.col("root").alias("now"))
        return scratch.save(at.join(roots, F.col("label") == F.col("old"), "left").select("node", F.coalesce("now", "label").alias("label"), *_W, "root"), "labelled")

    while True:
        near = scratch.save(compare(at, scratch, _nearest, radius, block).groupBy("u").agg(F.min(F.struct("far", "v")).alias("near")), "near")
        new = scratch.save(_alike(near.select(F.least("u", "near.v").alias("u"), F.greatest("u", "near.v").alias("v")), sets, least), "alike")
        merged = new.count()
        if merged:
            at = merge(at, new)
        if merged * 20 < total:
            break
    # Cells hold sets now, so blocks are bounded by bytes as well.
    open_nodes = at.join(near.select("u"), F.col("node") == F.col("u"), "left_semi")
    crossing = scratch.save(open_nodes.join(sets.hint("merge"), "node"), "crossing")
    left, held = crossing.agg(F.count(F.lit(1)), F.sum(F.octet_length("hashes"))).first()
    fits = block or max(1, min(GRID_MOST, max(SETS_LEAST, -(-left // GRID)), SETS_BYTES * left // (held or 1)))
    rest = scratch.save(compare(crossing, scratch, _crossing(least), radius, fits), "alike")
    if not rest.isEmpty():
        at = merge(at, rest)
    return at.select("node", F.col("label").alias("root"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, seed: int = 42, radius: int = WIDE_RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each group of texts linked by a Jaccard similarity of ``least`` or more of
    their sets of word shingles one row of the smallest id, that of the least text hash if the id repeats in it.

    Candidates are texts that share a shingle of their prefixes and whose wide fingerprints lie within the radius, three standard
    deviations beyond a similarity of 0.8; their similarity is then checked. Null text counts as empty, and texts without words are alike. A null id stays only if
    its group has no other. Of wholly repeated rows one stays. An empty table gives an empty one. Other columns pass through,
    whatever their names.
    """
    ensure_workers(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "simhash-kept")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t.as_py(), words, seed) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["h"])

    text = text_or_empty(text_col)
    # The sample tells which shingles go last in the order of the keys: it saves comparisons and leaves the links as they are.
    seen = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(max(1, docs.count() // SEEN))) == 0)
    often = seen.mapInArrow(shingled, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    common = np.sort(np.array([r["h"] for r in often.orderBy(F.desc("n"), "h").limit(COMMON_MOST).collect()], np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, fps = [], [], []
            for t in batch.column(1):
                h = shingle_hashes(t.as_py(), words, seed)
                sizes.append(len(h))
                keys.append(prefix_keys(h, common, least).view(np.int64))
                fps.append(wide_fingerprint(h))
            fps = np.array(fps, np.uint64).reshape(-1, WIDE_WORDS).view(np.int64)
            offsets = np.cumsum([0, *map(len, keys)])
            keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), keys, *(pa.array(fps[:, k]) for k in range(WIDE_WORDS))], ["id", "sha", "size", "keys", *_W])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), words, seed).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary())], ["node", "hashes"])

    sha = F.unhex(F.sha2(text.cast("binary"), 256))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("sha", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType())), *[T.StructField(w, T.LongType()) for w in _W]])
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), sha.alias("sha")).mapInArrow(run, schema)
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    # A node is a text, known by one of its rows; equal texts are compared once.
    nodes = rows.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"), F.min("row").alias("node"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("size", "keys", *_W)])
    nodes = scratch.save(nodes, "nodes")
    scratch.drop(rows)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The sets are made again for the few texts near others, which is less than to keep them all."""
        wanted = nodes.join(wanted.hint("merge"), "node", "left_semi").select("node", "sha", "least.id", "n")
        texts = docs.select(F.col(id_col).alias("__id"), sha.alias("__sha"), text.alias("text"))
        found = texts.join(wanted.hint("merge"), (F.col("__sha") == F.col("sha")) & F.col("__id").eqNullSafe(F.col("id")))
        if not wanted.where("n > 1").isEmpty():
            found = found.dropDuplicates(["node"])  # an id may repeat with the same text
        return found.select("node", "text").mapInArrow(sets, "node long, hashes binary")

    groups = similar_groups(nodes, sets_of, scratch, least, radius)
    placed = nodes.select(F.col("node").alias("one"), "sha", "least").join(groups, F.col("one") == F.col("node"), "left").select("sha", "least", F.coalesce("root", "one").alias("root"))
    stay = placed.groupBy("root").agg(F.min(F.struct("least", "sha")).alias("one"))
    stay = scratch.save(stay.select(F.col("one.least.id").alias("__id"), F.col("one.sha").alias("__sha")), "stay")
    out = docs.withColumn("__own", F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)))
    # A sort-merge join at every size: what stays grows with the documents.
    out = out.join(stay.hint("merge"), (F.col("__own") == F.col("__sha")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    if not nodes.where("n > 1").isEmpty():
        out = out.dropDuplicates([id_col, "__own"])  # an id may repeat with the same text
    return out.drop("__own")
