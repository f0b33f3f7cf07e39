"""Mixing sources to target weights by the cube method.

Each source's target fixes a rate; a document is taken ``floor(rate)`` times for sure and once more with the fraction as
inclusion probability. The flight phase moves those probabilities through the null space of the balancing constraints
(words and documents of the source): any three open units have a direction that keeps both totals, and moving along it
until a unit reaches 0 or 1 settles a unit. Flights run in blocks of bounded size; the at most two units a block leaves
open fly again together with other blocks' leftovers, and so on up a tree, until a source has one block left. What is open
then, with a dozen units held back from the last flight, is landed by trying all outcomes and taking the one
nearest the totals. The flight keeps all inclusion probabilities. The landing doesn't: its dozen units, and where giants leave
the words too far off also some of at most ``LANDING`` others of a source, are chosen by the words that are missing.

Blocks, orders and random numbers come from hashes of the rows and a seed, never from partitions, so reruns agree.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, ensure_workers

#: Units in a block of the flight, about.
BLOCK = 4096
#: Units that the last flight of a source leaves to the landing, besides those it leaves open: the largest, which no others could make up for.
HELD_BACK = 12
#: Units of a source's last flight that the landing may change to make up for giants.
LANDING = 256
#: The plan of at most this many sources is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Sources whose targets the driver computes, a row of a few numbers each. More of them are an error, not a silent strain.
MAX_SOURCES = 2_000_000
_EPS = 1e-9


def n_words(text_col: str) -> Column:
    """Runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> dict[str | None, float]:
    """Target words per source. Sources in code point order, null last, weigh ``weights`` in turn and share all words; a target
    stops at ``cap`` times its source's size, and the excess is shared again by weight among the rest until none is above."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, target = Fraction(sum(size.values())), set(size), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] > cap * size[s] * total}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: Fraction(cap * size[s]) for s in over}
        left -= sum(cap * size[s] for s in over)
        open_ -= over
    return {s: float(v) for s, v in target.items()}


def fly(units: list[tuple[float, float]], rng: random.Random) -> tuple[dict[int, int], dict[int, float]]:
    """Settle all but at most two units (size, probability). Returns the settled outcomes and the open probabilities."""
    settled: dict[int, int] = {}
    open_: list[tuple[int, float, float]] = []
    for i, (size, p) in enumerate(units):
        open_.append((i, size, p))
        while len(open_) == 3:
            (_, s1, p1), (_, s2, p2), (_, s3, p3) = open_
            # The null space of rows (1, 1, 1) and (s1, s2, s3); of equal sizes, any direction that keeps the count.
            u = (s2 - s3, s3 - s1, s1 - s2) if s1 != s2 or s2 != s3 else (1.0, -1.0, 0.0)
            up = min((1 - p if d > 0 else p) / abs(d) for p, d in zip((p1, p2, p3), u, strict=True) if d)
            down = min((p if d > 0 else 1 - p) / abs(d) for p, d in zip((p1, p2, p3), u, strict=True) if d)
            step = up if rng.random() * (up + down) < down else -down
            moved = []
            for (k, s, p), d in zip(open_, u, strict=True):
                p += step * d
                if p < _EPS or p > 1 - _EPS:
                    settled[k] = int(p > 0.5)
                else:
                    moved.append((k, s, p))
            open_ = moved
    return settled, {k: p for k, _, p in open_}


def land(units: list[tuple[float, float]]) -> list[int]:
    """The outcome of a few units nearest their expected words, then nearest their expected count."""
    sizes, chances = (np.array(c, np.float64) for c in zip(*units, strict=True)) if units else (np.zeros(0), np.zeros(0))
    outcomes = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    words, count = np.abs(outcomes @ sizes - sizes @ chances), np.abs(outcomes.sum(axis=1) - chances.sum())
    return outcomes[np.lexsort((count, words))[0]].tolist()


def repair(sizes: list[float], outcome: list[int], missing: float, most: int = LANDING) -> None:
    """What no outcome of the landing could reach: takes up (or drops) some of ``most`` of the last flight's units, evenly spread
    over the sizes, largest first, while that comes nearer the words."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    for k in order[:: -(-len(order) // most)] if order else ():
        step = sizes[k] if outcome[k] == 0 else -sizes[k]
        if abs(missing - step) < abs(missing) and (step > 0) == (missing > 0):
            outcome[k] = 1 - outcome[k]
            missing -= step


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 42, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: its id, size (words), source_size, target (of its source) and copies, how often the mix takes it.

    Null text has size 0; a null source is a source of its own, the last. Documents without words weigh nothing and get no
    copies; sources without words have target 0. Repeated rows and null ids are units like others: no step joins on the id.
    An empty table gives an empty one. Only the three named columns are read. Copies never exceed ``cap``. The sums per source
    come to the driver, one row a source and at most ``MAX_SOURCES``, as do no rows of documents. Units of equal id, source and
    size are interchangeable: which of them is taken makes no difference to the result.
    """
    spark = docs.sparkSession
    ensure_workers(spark)
    scratch = Scratch(spark, "mixing")
    sized = scratch.save(docs.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size")), "sized")
    totals = scratch.save(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("units")), "totals")
    if totals.count() > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: mix groups of them instead")
    totals = totals.collect()
    targets = source_targets([(r["source"], r["size"]) for r in totals], weights, cap)
    plan_rows = []
    for r in totals:
        rate = min(float(cap), targets[r["source"]] / r["size"]) if r["size"] else 0.0
        whole = int(rate + _EPS)
        plan_rows.append((r["source"], r["size"], targets[r["source"]], whole, max(0.0, rate - whole), -(-r["units"] // block)))
    plan = spark.createDataFrame(plan_rows, "p_source string, source_size long, target double, whole int, p double, blocks int")
    if len(plan_rows) <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    base = ["id", "source", "size", "source_size", "target", "whole"]
    to_fly = (F.col("size") > 0) & (F.col("p") > _EPS)
    fixed = rows.where(~to_fly).select(*base, F.when(F.col("size") > 0, 0).otherwise(-F.col("whole")).alias("extra"))

    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([*(T.StructField(c, kinds[c]) for c in base), T.StructField("p", T.DoubleType()), T.StructField("blocks", T.IntegerType()), T.StructField("extra", T.IntegerType())])

    def settle(turn: int, key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["mixed", "id", "size", "p"], kind="stable", na_position="last").reset_index(drop=True)
        units = list(zip(group["size"].astype(float), group["p"], strict=True))
        last = group["blocks"].iloc[0] == 1
        held = set(sorted(range(len(units)), key=lambda k: (-units[k][0], k))[: HELD_BACK * last])
        flying = [k for k in range(len(units)) if k not in held]
        settled, open_ = ({flying[i]: v for i, v in part.items()} for part in fly([units[k] for k in flying], random.Random(f"{seed}/{turn}/{key}")))
        if last:
            open_ |= {k: units[k][1] for k in held}
            left = sorted(open_)
            settled |= dict(zip(left, land([(units[k][0], open_[k]) for k in left]), strict=True))
            open_, outcome = {}, [settled[k] for k in range(len(units))]
            sizes = [s for s, _ in units]
            repair(sizes, outcome, sum(s * p for s, p in units) - sum(s * x for s, x in zip(sizes, outcome, strict=True)))
            settled = dict(enumerate(outcome))
        group["extra"] = pd.array([settled.get(k) for k in range(len(group))], "Int32")
        for k, p in open_.items():
            group.loc[k, "p"] = p
        return group[schema.names]

    def flight(turn: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        return lambda key, group: settle(turn, key, group)

    done, turn, most = [], 0, max((r[5] for r in plan_rows), default=0)
    open_rows = rows.where(to_fly)
    while True:
        mixed = F.xxhash64(F.lit(seed + turn), "id", "size")
        dealt = open_rows.select(*base, "p", "blocks", mixed.alias("mixed"), F.pmod(mixed, F.greatest("blocks", F.lit(1))).alias("block"))
        flown = scratch.save(dealt.groupBy("source", "block").applyInPandas(flight(turn), schema), "flown")
        done.append(flown.where("extra is not null").select(*base, "extra"))
        if most <= 1:
            break
        # A block leaves two units open at most.
        most, turn = -(-2 * most // block), turn + 1
        open_rows = flown.where("extra is null").withColumn("blocks", F.ceil(F.lit(2) * F.col("blocks") / block).cast("int"))
    for part in done:
        fixed = fixed.unionByName(part)
    return fixed.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as ``mix`` takes it. Options are those of ``mix``.

    Rows that agree in id, source and size share their copies as evenly as they go, in order of their texts.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    keys = ["__id", "__source", "__size"]
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    shares = scratch.save(mixed.groupBy(F.col(id_col).alias("__i"), F.col(source_col).alias("__s"), F.col("size").alias("__z")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")), "shares")
    rows = docs.withColumns({"__id": F.col(id_col), "__source": F.col(source_col), "__size": n_words(text_col)})
    same = F.col("__id").eqNullSafe(F.col("__i")) & F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))
    # A sort-merge join at every size: the shares grow with the documents.
    rows = rows.join(shares.where("__copies > 0").hint("merge"), same)
    copies = F.col("__copies")
    if not shares.where("__rows > 1").isEmpty():
        at = F.row_number().over(Window.partitionBy(*keys).orderBy(text_col)) - 1
        rows = rows.withColumn("__at", at)
        copies = F.floor(F.col("__copies") / F.col("__rows")) + F.when(F.col("__at") < F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    return rows.withColumn("__one", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns)
