"""Embeds within embeds, to a depth of ten.

``embed_reach`` and ``first_repeats`` hold a row per pair or per note, however many ways lead from one to the other; only
``embed_closure`` lists the ways themselves, for the roots one asks about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

MAX_DEPTH = 10


def embed_closure(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, target, depth, trail, cycle) of all ways in which a note embeds another. ``edges``: source, target, media. There may be
    as many ways as the fan-out to the power of the depth; ``embed_reach`` tells what is embedded without them.

    Media and unknown targets are leaves. A target already on the trail is reported as a cycle and not followed; nothing
    deeper than ``max_depth`` is. An iteration a level: each is a join on the source.
    """
    level = edges.select(F.col("source").alias("root"), "target", F.lit(1).alias("depth"), F.array("source", "target").alias("trail"), (F.col("source") == F.col("target")).alias("cycle"), "media")
    out = level
    step = edges.select(F.col("source").alias("target"), F.col("target").alias("next"), F.col("media").alias("next_media"))
    for _ in range(max_depth - 1):
        open_ = level.where(~F.col("cycle") & ~F.col("media"))
        level = open_.join(step, "target").select("root", F.col("next").alias("target"), (F.col("depth") + 1).alias("depth"), F.concat("trail", F.array("next")).alias("trail"), F.array_contains("trail", F.col("next")).alias("cycle"), F.col("next_media").alias("media"))
        out = out.unionByName(level)
    return out.drop("media")


def _edges(edges: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.save(edges.groupBy("source", "target").agg(F.bool_and("media").alias("media")), "edges")


def embed_reach(edges: DataFrame, max_depth: int = MAX_DEPTH, scratch: Scratch | None = None) -> DataFrame:
    """(root, target, depth) of all that a note embeds, directly or not, at its least depth; itself too, if it is on a cycle.

    A level follows only the pairs that the level before found first, and drops those found earlier; levels are written. Media are
    leaves: a target is media or not, whichever note embeds it.
    """
    scratch = scratch or Scratch(edges.sparkSession, "embeds")
    edges = _edges(edges, scratch)
    step = edges.select(F.col("source").alias("target"), F.col("target").alias("next"), F.col("media").alias("next_media"))
    new = edges.select(F.col("source").alias("root"), "target", F.lit(1).alias("depth"), "media")
    seen = new
    for depth in range(2, max_depth + 1):
        onward = new.where(~F.col("media")).join(step, "target").groupBy("root", F.col("next").alias("target")).agg(F.bool_and("next_media").alias("media"))
        first = onward.join(seen.select("root", "target"), ["root", "target"], "left_anti")
        new = scratch.save(first.select("root", "target", F.lit(depth).alias("depth"), "media"), "level")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen.drop("media")


def cyclic_core(edges: DataFrame, rounds: int = MAX_DEPTH, scratch: Scratch | None = None) -> DataFrame:
    """Edges left after ``rounds`` rounds of taking away those from notes that none embeds and those to notes that embed none. All edges
    of cycles stay; with them what lies between cycles, or too deep to be taken away in so many rounds."""
    scratch = scratch or Scratch(edges.sparkSession, "embeds")
    left, n = _edges(edges, scratch), None
    for _ in range(rounds):
        kept = left.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        kept = kept.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        left = scratch.save(kept.select("source", "target", "media"), "core")
        before, n = n, left.count()
        if n in (before, 0):
            break
    return left


def first_repeats(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, depth): at which depth a note's embeds first come back to a note on their way, for roots where that is at most
    ``max_depth``.

    For a note on a cycle that is its shortest cycle, found within the cyclic core; for any other it is one more than the least of
    the notes it embeds. So depths go up the edges, a round each, and no pairs of notes are made outside the core.
    """
    scratch = Scratch(edges.sparkSession, "embeds")
    own = embed_reach(cyclic_core(edges, max_depth, scratch), max_depth, scratch).where(F.col("root") == F.col("target")).select("root", "depth")
    known = scratch.save(own, "cycles")
    up = _edges(edges, scratch).where(~F.col("media")).select(F.col("source").alias("above"), F.col("target").alias("root"))
    for _ in range(max_depth - 1):
        if known.isEmpty():
            break
        reached = known.where(F.col("depth") < max_depth).join(up, "root").select(F.col("above").alias("root"), (F.col("depth") + 1).alias("depth"))
        both = known.unionByName(reached).groupBy("root").agg(F.min("depth").alias("depth"))
        after = scratch.save(both, "depths")
        same = after.join(known, ["root", "depth"], "left_anti").isEmpty()
        known = after
        if same:
            break
    return known


def too_deep(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Roots whose embeds go on below ``max_depth`` without coming back to a note on the way.

    A note with a way of n edges below it is one with an edge to a note with a way of n - 1; that settles all roots without cycles
    below them. Only for those with one are the ways listed.
    """
    scratch = Scratch(edges.sparkSession, "embeds")
    every = _edges(edges, scratch)
    # ``way``: notes with a way of so many edges; a medium may be its last note alone.
    way = every.select("source").distinct()
    for _ in range(max_depth):
        way = scratch.save(every.where(~F.col("media")).join(way.select(F.col("source").alias("target")), "target", "left_semi").select("source").distinct(), "ways")
        if way.isEmpty():
            return way.select(F.col("source").alias("root"))
    far = way.select(F.col("source").alias("root"))
    back = scratch.save(first_repeats(edges, max_depth + 1).select("root"), "back")
    straight = far.join(back, "root", "left_anti")
    unsure = far.join(back, "root", "left_semi")
    if unsure.isEmpty():
        return straight
    below = embed_reach(edges, max_depth + 1).join(unsure, "root", "left_semi").select(F.col("target").alias("source")).unionByName(unsure.select(F.col("root").alias("source"))).distinct()
    ways = embed_closure(edges.join(below, "source", "left_semi"), max_depth + 1).join(unsure, "root", "left_semi")
    return straight.unionByName(ways.where((F.col("depth") > max_depth) & ~F.col("cycle")).select("root").distinct())


def cycles(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, trail): the ways of each root that come back to a note on them."""
    roots = first_repeats(edges, max_depth).select("root")
    below = embed_reach(edges, max_depth).join(roots, "root", "left_semi").select(F.col("target").alias("source")).unionByName(roots.select(F.col("root").alias("source"))).distinct()
    return embed_closure(edges.join(below, "source", "left_semi"), max_depth).where("cycle").join(roots, "root", "left_semi").select("root", "trail")
