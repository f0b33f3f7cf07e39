"""The second pass of a push: which pages to render again, once new pages and new titles are known.

Only what changed is followed: links that had no page are matched with the new pages alone, and links to renamed pages are found by
their page. What is rendered again follows from the changes, not from the number of notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.globs import basename
from ..scratch import Scratch
from . import links as lk


def rename_titles(moves: DataFrame) -> DataFrame:
    """(page_id, title) of renamed notes with a page: the new file name without its last extension."""
    name = basename(F.col("path"))
    title = F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name)
    return moves.where(F.coalesce("page_id", F.lit("")) != "").select("page_id", title.alias("title"))


def with_pages(state: DataFrame, created: DataFrame) -> DataFrame:
    """State after a first pass that made pages (note_path, page_id): rows without one get theirs, notes without a row get one."""
    new = created.select("note_path", F.col("page_id").alias("__page"))
    both = state.join(new, "note_path", "full_outer")
    return both.withColumn("page_id", F.coalesce("__page", "page_id")).withColumn("status", F.coalesce("status", F.lit("synced"))).select(*state.columns)


def newly_resolved(links: DataFrame, created: DataFrame, aliases: DataFrame) -> DataFrame:
    """(source_path, target_name, page_id): links that had no page and now lead to one of ``created`` (note_path, page_id)."""
    open_ = lk.unresolved(links)
    found = lk.resolve(open_, created, aliases).select(F.col("target").alias("target_name"), F.col("page_id").alias("new_page"))
    return open_.join(found, "target_name").select("source_path", "target_name", F.col("new_page").alias("page_id"))


def pages_to_render(links: DataFrame, created: DataFrame, moves: DataFrame, state: DataFrame, aliases: DataFrame) -> DataFrame:
    """(note_path, page_id, resolved, renamed): notes with a page whose links changed, and how many of them newly lead to a page and
    how many lead to a renamed one.

    ``links`` as they were before the pass, ``state`` as it is after it; ``moves``: old_path, path, page_id. A note that moved itself is
    looked up by its new path. Links and moves are written once, as several steps read them.
    """
    scratch = Scratch(links.sparkSession, "relink")
    links, moves = scratch.save(links, "links"), scratch.save(moves.select("old_path", "path", "page_id"), "moves")
    fresh = newly_resolved(links, created, aliases).select("source_path", F.lit(1).alias("resolved"), F.lit(0).alias("renamed"))
    old = links.where("resolved").join(moves.select("page_id").distinct().hint("merge"), "page_id", "left_semi").select("source_path", F.lit(0).alias("resolved"), F.lit(1).alias("renamed"))
    touched = fresh.unionByName(old).groupBy("source_path").agg(F.sum("resolved").alias("resolved"), F.sum("renamed").alias("renamed"))
    now = touched.join(moves.select(F.col("old_path").alias("source_path"), F.col("path").alias("__to")).hint("merge"), "source_path", "left")
    now = now.select(F.coalesce("__to", "source_path").alias("note_path"), "resolved", "renamed")
    pages = state.where(F.coalesce("page_id", F.lit("")) != "").select("note_path", "page_id")
    return now.join(pages, "note_path").select("note_path", "page_id", "resolved", "renamed")
