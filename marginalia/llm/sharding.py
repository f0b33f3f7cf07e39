"""Shards by balanced label propagation.

Documents of a group (equal texts) are linked; a document alone in its group has no links. Linked documents start on the
shard their id hashes to, and every group counts its members per shard (aggregated before the shuffle, so a group of a third
of all rows is a few counts). Groups of over a ``HEAVY``-th of a quota, bounded in number, are placed first, one by one: on
the shard of most members of those they fit, or over as few shards as hold them. The others ask in rounds for the shard of
most members of those with room. A shard grants cells of groups by their hash, all that still fit; who was refused
asks again, for shards that have room then. Rounds end when no cell is granted or so few groups are left that they are
placed one by one. Documents without links then fill what is left of each quota, so they even out the shards at
no cost in cut edges; groups that no shard could take lie side by side among them.

The law is ``rows``: counts of any two shards differ by one at most. Slots number each shard's rows from 0 without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, text_or_empty

#: Histogram cells a shard; with the shards they bound what is broadcast or brought to the driver.
CELLS = 4096
#: Groups of over this part of a quota are placed one by one.
HEAVY = 16


def _numbered(df: DataFrame, by: str, cell: str, order: list[str]) -> DataFrame:
    """``at``: a gapless number from 0 within ``by``, in order of ``cell`` and ``order``. Cells, bounded in number, carry the offsets."""
    counts = df.groupBy(by, cell).agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(by).alias("__by"), F.col(cell).alias("__cell"), F.coalesce(earlier, F.lit(0)).alias("__before"))
    here = F.row_number().over(Window.partitionBy(by, cell).orderBy(*order))
    numbered = df.withColumn("__here", here)
    joined = numbered.join(F.broadcast(offsets), F.col(by).eqNullSafe(F.col("__by")) & (F.col(cell) == F.col("__cell")))
    return joined.withColumn("at", F.col("__before") + F.col("__here") - 1).drop("__by", "__cell", "__before", "__here")


def _pack(groups: list, room: list[int]) -> list[tuple[str, int, int, int]]:
    """(group, first, end, shard) of ``groups`` (g, members, at), largest first: which of a group's rows go where. Takes from ``room``."""
    out = []
    for r in sorted(groups, key=lambda r: (-r["members"], r["g"])):
        done = 0
        while done < r["members"]:
            left = r["members"] - done
            fits = [s for s in range(len(room)) if room[s] >= left]
            to = max(fits, key=lambda s: (r["at"][s], -room[s])) if fits else max(range(len(room)), key=lambda s: (room[s], r["at"][s]))
            n = min(left, room[to])
            out.append((r["g"], done, done + n, to))
            room[to] -= n
            done += n
    return out


def _propagate(light: DataFrame, room: list[int], scratch: Scratch) -> tuple[list[DataFrame], list]:
    """Tables (g, to) of the groups ``light`` (g, members, at) that were granted a shard, and the last few groups. Takes from ``room``."""
    settled, turn = [], 0
    while True:
        if light.limit(CELLS + 1).count() <= CELLS and turn:
            return settled, light.collect()
        turn += 1
        free = F.array(*[F.lit(n).cast("long") for n in room])
        wish = lambda n, s: F.when(F.element_at(free, s + 1) >= F.col("members"), F.struct(n.alias("n"), F.xxhash64(F.lit(turn), F.col("g"), s).alias("h"), s.alias("to")))  # noqa: B023, E731
        asked = light.withColumn("to", F.array_max(F.transform("at", wish)).getField("to")).withColumn("cell", F.pmod(F.xxhash64(F.lit(turn), F.lit(5), "g"), F.lit(CELLS)).cast("int"))
        asked = scratch.save(asked, "asked")
        granted = [bytearray(b"0" * CELLS) for _ in room]
        # At most n_shards * CELLS counts.
        for r in sorted(asked.where("to is not null").groupBy("to", "cell").agg(F.sum("members").alias("n")).collect(), key=lambda r: (r["to"], r["cell"])):
            if r["n"] <= room[r["to"]]:
                room[r["to"]] -= r["n"]
                granted[r["to"]][r["cell"]] = ord("1")
        if not any(b"1" in g for g in granted):
            return settled, []
        yes = F.coalesce(F.substring(F.element_at(F.array(*[F.lit(g.decode()) for g in granted]), F.col("to") + 1), F.col("cell") + 1, F.lit(1)) == "1", F.lit(False))
        settled.append(asked.where(yes).select("g", "to"))
        light = asked.where(~yes).select("g", "members", "at")


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, size (UTF-8 bytes of the text and 1), text_crc32, law, shard, slot and grown_shard (null).

    Null text has no bytes: size 1, and it is linked to empty texts. Repeated rows are rows like others; null ids too. An empty
    table gives an empty one. Only the two named columns are read. Groups of equal texts stay on one shard as far as quotas let
    them: a group larger than a shard's quota fills shard after shard.

    Everything hangs on hashes of ids and texts, nothing on partitions, so reruns agree. Rows of equal id and text are
    interchangeable: which of them comes first makes no difference to the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = text_or_empty(text_col).cast("binary")
    base = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.sha2(text, 256).alias("sha"))
    rows = scratch.save(base, "rows")
    total = rows.count()
    quotas = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    start = F.pmod(F.xxhash64("id", "sha"), F.lit(n_shards)).cast("int")
    votes = rows.groupBy(F.col("sha").alias("g"), start.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    groups = votes.groupBy("g").agg(F.sum("n").alias("members"), F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("m")).where("members > 1")
    at = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0)))
    groups = scratch.save(groups.select("g", "members", at.alias("at")), "groups")

    room, bar = list(quotas), max(1, total // n_shards // HEAVY)
    # At most n_shards * 2 * HEAVY groups.
    placed = _pack(groups.where(F.col("members") > bar).collect(), room)
    settled, last = _propagate(groups.where(F.col("members") <= bar), room, scratch)
    placed += _pack(last, room)
    parts = spark.createDataFrame(placed, "g string, first long, end long, to int")
    names = parts.groupBy("g").agg(F.count(F.lit(1)).alias("parts"), F.min("to").alias("shard"))

    known = rows.join(F.broadcast(names), F.col("sha") == F.col("g"), "left").drop("g").withColumn("cell", F.pmod(F.xxhash64("id", "sha"), F.lit(CELLS)).cast("int"))
    known = scratch.save(known, "known")
    # Few groups have parts: those beyond a quota, and what meets the end of the last room.
    cut = _numbered(known.where("parts > 1").drop("shard").withColumn("cell", F.col("cell") % 256), "sha", "cell", ["id", "sha"])
    cut = cut.join(F.broadcast(parts), (F.col("sha") == F.col("g")) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("end"))).select("id", "size", "crc", "sha", F.col("to").alias("shard"))
    rest = known.where("parts is null").select("id", "size", "crc", "sha")
    grants = groups.where("false").select("g", F.lit(0).alias("to"))
    for table in settled:
        grants = grants.unionByName(table)
    light = groups.where(F.col("members") <= bar).select("g").join(scratch.save(grants, "grants"), "g", "left")
    rest = rest.join(light, F.col("sha") == F.col("g"), "left").select("id", "size", "crc", "sha", F.col("to").alias("shard"), F.col("g").isNotNull().alias("linked"))
    held = known.where("parts = 1").select("id", "size", "crc", "sha", "shard").unionByName(cut)
    placed = rest.unionByName(held.withColumn("linked", F.lit(True)))

    # Groups that no shard could take share a cell, so that they lie side by side.
    spread = F.when(F.col("shard").isNull() & F.col("linked"), F.xxhash64("sha")).otherwise(F.xxhash64("id", "sha"))
    placed = scratch.save(placed.withColumn("cell", F.pmod(spread, F.lit(CELLS)).cast("int")), "placed")
    held = _numbered(placed.where("shard is not null"), "shard", "cell", ["id", "sha"])
    free = _numbered(placed.where("shard is null").withColumn("all", F.lit(0)), "all", "cell", ["sha", "id"])
    taken = [0] * n_shards
    for r in placed.where("shard is not null").groupBy("shard").count().collect():
        taken[r["shard"]] = r["count"]
    shard, slot, start = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(n_shards):
        here = (F.col("at") >= start) & (F.col("at") < start + quotas[s] - taken[s])
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, F.col("at") - start + taken[s]).otherwise(slot)
        start += quotas[s] - taken[s]
    free = free.select("id", "size", "crc", shard.alias("shard"), slot.alias("slot"))
    out = held.select("id", "size", "crc", "shard", F.col("at").alias("slot")).unionByName(free)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
