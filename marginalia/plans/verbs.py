"""init, status, push, pull, sync, links, conflicts, watch: each returns tables; sinks do the rest."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import ignored, matches
from ..functions.text import is_uuid
from ..operators import blocks, diff, extract, links, properties, state


class Vault(NamedTuple):
    """A snapshot of everything a plan reads. ``notes``: path, content, mtime."""

    notes: DataFrame
    state: DataFrame
    links: DataFrame
    aliases: DataFrame
    remote: DataFrame


class Initial(NamedTuple):
    state: DataFrame
    links: DataFrame
    aliases: DataFrame
    errors: DataFrame


def init(notes: DataFrame) -> Initial:
    """State (all pending), links and aliases of a new vault in one pass over its notes; notes that can't be read are in ``errors``."""
    parsed = extract.parse_notes(notes)
    good = parsed.where(F.col("error").isNull())
    h = diff.fingerprints(notes).select("note_path", "content_hash", "frontmatter_hash", "mtime")
    none = lambda kind: F.lit(None).cast(kind)
    rows = h.select("note_path", none("string").alias("page_id"), none("string").alias("parent_id"), "content_hash", "frontmatter_hash", F.col("mtime").alias("local_mtime"), none("timestamp").alias("remote_mtime"), none("timestamp").alias("last_sync"), none("string").alias("sync_direction"), F.lit("pending").alias("status"))
    return Initial(rows, links.register(extract.link_edges(good).select("source_path", "target")), extract.page_aliases(good), parsed.where(F.col("error").isNotNull()).select("path", "error"))


def find_database(databases: DataFrame, name: str) -> DataFrame:
    """By id if the name is one, else by title without regard to case."""
    return databases.where(F.when(is_uuid(F.lit(name)), F.replace("page_id", F.lit("-"), F.lit("")) == name.replace("-", "")).otherwise(F.lower("title") == name.lower()))


def status(v: Vault) -> DataFrame:
    hashes = diff.fingerprints(v.notes)
    return diff.status_summary(diff.all_changes(hashes, v.state, v.remote), v.state, v.links)


def push(v: Vault, pattern: str | None = None, push_all: bool = False, force: bool = False, ignore: list[str] | None = None) -> DataFrame:
    """(path, type) to push. Conflicts are held back unless forced; ``pattern`` keeps matching paths only."""
    plan = diff.push_candidates(diff.fingerprints(v.notes), v.state, push_all)
    if pattern is not None:
        plan = plan.where(matches(F.col("path"), pattern))
    if ignore:
        plan = plan.where(~ignored(F.col("path"), ignore))
    if force:
        return plan.withColumn("type", F.when(F.col("type") == "conflict", "modified").otherwise(F.col("type")))
    return plan.join(state.conflicts(v.state).select(F.col("note_path").alias("path")), "path", "left_anti").where("type <> 'conflict'")


class Rendered(NamedTuple):
    properties: DataFrame
    blocks: DataFrame


def render(v: Vault, plan: DataFrame, rules: tuple[properties.Rule, ...] = properties.DEFAULT_RULES, style: str = "placeholder") -> Rendered:
    """Pages of the planned notes. Links are resolved before rendering, so one pass does."""
    parsed = extract.parse_notes(v.notes.join(plan.select("path"), "path", "left_semi"))
    fm = F.from_json(F.to_json("frontmatter"), "map<string,string>")
    props = parsed.select(F.col("path").alias("page_key"), properties.to_properties(fm, F.col("tags"), rules).alias("properties"))
    raw = blocks.note_blocks(parsed)
    found = links.resolve(extract.link_edges(parsed), v.state, v.aliases, "target")
    return Rendered(props, blocks.render_links(raw, found, style))


def pull(v: Vault, pattern: str | None = None, pull_all: bool = False) -> DataFrame:
    """(path, page_id, action) to pull or delete, and pages no note has yet."""
    plan = diff.pull_candidates(v.state, v.remote, pull_all).join(state.conflicts(v.state).select(F.col("note_path").alias("path")), "path", "left_anti")
    if pattern is not None:
        plan = plan.where(matches(F.col("path"), pattern))
    new = diff.discover_untracked(v.state, v.remote).select("path", "page_id", F.lit("pull").alias("action"))
    return plan.unionByName(new if pattern is None else new.where(matches(F.col("path"), pattern)))


def sync(v: Vault, strategy: str = "manual") -> DataFrame:
    return diff.sync_plan(diff.fingerprints(v.notes), v.state, v.remote, strategy)


def link_report(v: Vault, k: int = 3) -> DataFrame:
    """Unresolved links, each with its best suggestions."""
    left = links.unresolved(links.resolve_all(v.links, v.state, v.aliases))
    return left.join(links.suggestions(left, v.state, k), left["target_name"] == F.col("target"), "left").select("source_path", "target_name", "suggestions")


def conflict_report(v: Vault, history: DataFrame) -> DataFrame:
    known = state.parse_details(history.where("action = 'conflict'")).groupBy("note_path").agg(F.max_by("conflict", F.struct("ts", "seq")).alias("conflict"))
    return state.conflicts(v.state).select("note_path", "page_id").join(known, "note_path", "left")


def resolve_conflict(notes: DataFrame, remote_markdown: DataFrame, choices: DataFrame, at: Column) -> DataFrame:
    """(path, content, action) by choice (note_path, keep): local pushes, remote writes the page, both writes the page beside the note
    as ``X.conflict.md`` under a header of four keys."""
    rows = choices.join(remote_markdown.select("note_path", F.col("markdown").alias("remote")), "note_path", "left")
    header = F.concat(F.lit("---\nconflict: true\noriginal: "), "note_path", F.lit("\nsource: remote\ndetected: "), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\n---\n\n"))
    keep = F.col("keep")
    path = F.when(keep == "both", F.concat(F.regexp_replace("note_path", r"\.md\z", ""), F.lit(".conflict.md"))).otherwise(F.col("note_path"))
    content = F.when(keep == "remote", F.col("remote")).when(keep == "both", F.concat(header, F.coalesce("remote", F.lit(""))))
    return rows.join(notes.select(F.col("path").alias("note_path")), "note_path", "left_semi").select(path.alias("path"), content.alias("content"), F.when(keep == "local", "push").otherwise("write").alias("action"))

