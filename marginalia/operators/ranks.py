"""Ranks within groups of any size, and pairs of equal rank, without a group ever meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch


def ranked(rows: DataFrame, group: list[str], order: str, scratch: Scratch, cells: int | None = None) -> DataFrame:
    """``rows`` with ``rank``: the place, from 1, of each row within its group by ``order``, whose values are distinct within a group.

    Rows are dealt into cells by ranges of group and order together, so a group of a third of all rows covers a third of the cells.
    A rank is the place within the cell and group plus the rows of the group in the cells before it. Counts per cell and group are
    as many as groups and cells together, and a group has one a cell at most. ``cells``: how many at most; else Spark's choice.
    """
    keys = [*group, order]
    dealt = rows.repartitionByRange(cells, *keys) if cells else rows.repartitionByRange(*keys)
    # Written, so that a row has the same cell in both uses even if a task runs again.
    dealt = scratch.save(dealt.withColumn("__cell", F.spark_partition_id()), "cells")
    counts = dealt.groupBy(*group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*group, "__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    here = dealt.withColumn("__at", F.row_number().over(Window.partitionBy(*group, "__cell").orderBy(order)))
    return here.join(before, [*group, "__cell"]).withColumn("rank", F.col("__before") + F.col("__at")).drop("__cell", "__before", "__at")


def aligned(left: DataFrame, right: DataFrame, group: str, left_order: str, right_order: str, scratch: Scratch, cells: int | None = None) -> DataFrame:
    """Rows of both sides paired one to one: the first of a group with the first, the second with the second, and so on.

    The join is on group and rank, so its keys are as many as pairs. ``left`` and ``right`` share no column but ``group``.
    """
    one = ranked(left, [group], left_order, scratch, cells)
    two = ranked(right, [group], right_order, scratch, cells)
    return one.join(two, [group, "rank"]).drop("rank")
