"""Exact dedup by deterministic block naming.

A text's bytes are cut into fixed-size blocks. Sorting the distinct blocks gives each an integer name; adjacent names
are then paired, and sorting the distinct pairs names the pairs, until each document has one name. Equal names at a
level mean equal bytes, so with the byte length (which fixes the number of levels) the last name is an identity without
collisions.

Block contents are shuffled once. Each task first keeps one copy of each block it reads, so a block that a third of
all rows share reaches its sorter once per task; documents carry references to their task's copies. Names are dense
ranks within hash buckets, ``(rank - 1) * buckets + bucket``: they depend on the set of blocks alone, never on
partitioning, so a lost task that runs again gives the same names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, ensure_workers, text_or_empty

BLOCK_BYTES = 4096
BUCKETS = 1 << 20
#: A task forgets the blocks it has seen beyond this many bytes; it then only sends some again.
SEEN_BYTES = 32 << 20
_TASK_SHIFT = 40


def _cut(id_type: T.DataType, block_bytes: int):
    """Rows of documents (key, id, bytes, digest, references) and of blocks (reference, content), in one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << _TASK_SHIFT
        seen: dict[bytes, int] = {}
        held = refs = rows = 0
        for batch in batches:
            keys, sizes, digests, doc_refs, new_refs, new_blocks = [], [], [], [], [], []
            for text in batch.column(1):
                data = text.as_py().encode()
                mine = []
                for at in range(0, len(data) or 1, block_bytes):
                    block = data[at : at + block_bytes]
                    ref = seen.get(block)
                    if ref is None:
                        if held > SEEN_BYTES:
                            seen, held = {}, 0
                        ref = seen[block] = base + refs
                        held += len(block)
                        refs += 1
                        new_refs.append(ref)
                        new_blocks.append(block)
                    mine.append(ref)
                keys.append(base + rows)
                rows += 1
                sizes.append(len(data))
                digests.append(hashlib.sha256(data).digest())
                doc_refs.append(mine)
            n, m = len(keys), len(new_refs)
            ids = pa.concat_arrays([batch.column(0), pa.nulls(m, batch.column(0).type)])
            fill = [None] * m
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys + fill, pa.int64()), ids, pa.array(sizes + fill, pa.int64()), pa.array(digests + fill, pa.binary()), pa.array(doc_refs + fill, pa.list_(pa.int64())), pa.array([None] * n + new_refs, pa.int64()), pa.array([None] * n + new_blocks, pa.binary())],
                ["key", "id", "n_bytes", "digest", "refs", "ref", "block"],
            )

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("refs", T.ArrayType(T.LongType())), T.StructField("ref", T.LongType()), T.StructField("block", T.BinaryType())])
    return run, schema


def _name(bucket: str, *order: str) -> Column:
    """Dense rank within a bucket, made unique over all buckets."""
    rank = F.dense_rank().over(Window.partitionBy(bucket).orderBy(*order))
    return (rank.cast("long") - 1) * BUCKETS + F.col(bucket)


def _bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS))


def identities(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: key (of the row), id, n_bytes, digest (SHA-256) and name; (n_bytes, name) is equal iff the texts are."""
    ensure_workers(docs.sparkSession)
    run, schema = _cut(docs.schema[id_col].dataType, block_bytes)
    cut = scratch.save(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema), "blocks")
    rows = cut.where("key is not null").select("key", "id", "n_bytes", "digest", "refs", F.size("refs").alias("n"))
    blocks = cut.where("ref is not null").select("ref", "block").withColumn("bucket", _bucket("block"))
    block_names = blocks.select("ref", _name("bucket", "block").alias("name"))

    level = scratch.save(rows.select("key", "n", F.posexplode("refs").alias("pos", "ref")).join(block_names, "ref").select("key", "n", "pos", "name"), "level")
    whole = [level.where("n = 1").select("key", "name")]
    longest = rows.agg(F.max("n")).first()[0] or 0
    while longest > 1:
        longest = (longest + 1) // 2
        up = F.floor(F.col("pos") / 2).cast("int")
        pairs = level.where("n > 1").groupBy("key", (F.ceil(F.col("n") / 2)).cast("int").alias("n"), up.alias("pos"))
        pairs = scratch.save(pairs.agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")), "pairs")
        names = pairs.select("a", "b").distinct().withColumn("bucket", _bucket("a", "b")).select("a", "b", _name("bucket", "a", "b").alias("name"))
        level = scratch.save(pairs.join(names, ["a", "b"]).select("key", "n", "pos", "name"), "level")
        scratch.drop(pairs)
        whole.append(level.where("n = 1").select("key", "name"))
    names = whole[0]
    for part in whole[1:]:
        names = names.unionByName(part)
    return scratch.save(rows.drop("refs", "n").join(names, "key"), "identities")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id (id of the row of equal text that stays), group_size, kept, text_sha256.

    Of equal texts the row of the largest id stays; null ids are the smallest. Where several rows have that id, exactly one
    of them stays. Null text equals empty text. An empty table gives an empty one. Only the two named columns are read.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    named = identities(docs, scratch, id_col, text_col, block_bytes)
    groups = named.groupBy("n_bytes", "name").agg(F.max(F.struct("id", "key")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    # Written, so that the join has an exchange on both sides and a group of a third of all rows can be split.
    groups = scratch.save(groups, "groups")
    return named.join(groups, ["n_bytes", "name"]).select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("key") == F.col("keep.key")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of wholly repeated rows one stays."""
    scratch = Scratch(docs.sparkSession, "exact-dedup-kept")
    verdicts = scratch.save(exact_duplicates(docs, id_col, text_col), "verdicts")
    stay = verdicts.where("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    out = docs.withColumn("__own", F.sha2(text_or_empty(text_col).cast("binary"), 256))
    # A sort-merge join at every size: what stays grows with the documents.
    out = out.join(stay.hint("merge"), F.col("__own").eqNullSafe(F.col("__sha")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    if not verdicts.where(~F.col("kept") & F.col(id_col).eqNullSafe(F.col("keep_id"))).isEmpty():
        out = out.dropDuplicates([id_col, "__own"])  # an id repeats with the same text
    return out.drop("__own")
