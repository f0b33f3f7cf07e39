"""Change detection: notes against state, state against remote pages, and plans over both.

notes:  note_path, content_hash, frontmatter_hash, full_hash, mtime (fingerprints already taken; no text is shuffled)
state:  schema.SYNC_STATE; a state table's content_hash is a body hash
remote: schema.REMOTE_PAGES
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import normalise, split_for_hash
from ..scratch import Scratch
from .ranks import aligned, ranked

CHANGE = ("path", "old_path", "type", "direction", "local_hash", "remote_hash", "local_mtime", "remote_mtime", "frontmatter_only", "page_id")


def fingerprints(notes: DataFrame, path: str = "path", content: str = "content", mtime: str | None = "mtime", keep: tuple[str, ...] = ()) -> DataFrame:
    """Hashes of note contents, one row a note."""
    when = F.col(mtime) if mtime and mtime in notes.columns else F.lit(None).cast("timestamp")
    more = [c for c in keep if c in notes.columns]
    # In steps, so that each regular expression runs once a note.
    parts = notes.select(F.col(path).alias("note_path"), *more, split_for_hash(F.col(content)).alias("p"), when.alias("mtime"))
    plain = parts.select("note_path", *more, normalise(F.col("p.body")).alias("body"), normalise(F.col("p.frontmatter")).alias("fm"), "mtime")
    sha = lambda c: F.when(c == "", "").otherwise(F.sha2(c, 256))
    full = F.when(F.col("fm") == "", F.col("body")).otherwise(F.concat("fm", F.lit("\n"), "body"))
    return plain.select("note_path", *more, sha(F.col("body")).alias("content_hash"), sha(F.col("fm")).alias("frontmatter_hash"), sha(full).alias("full_hash"), "mtime")


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _row(**values: Column) -> list[Column]:
    kinds = {"local_mtime": "timestamp", "remote_mtime": "timestamp", "frontmatter_only": "boolean"}
    return [values.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in CHANGE]


def new_notes(notes: DataFrame, state: DataFrame) -> DataFrame:
    return notes.join(state, "note_path", "left_anti")


def vanished(notes: DataFrame, state: DataFrame) -> DataFrame:
    """Synced state rows with a page whose note is gone: candidates for deletion or renaming."""
    return state.where((_text("page_id") != "") & (F.col("status") == "synced")).join(notes, "note_path", "left_anti")


def renames(notes: DataFrame, state: DataFrame, rename_on: str = "full_hash") -> DataFrame:
    """Vanished and new notes of equal hash, paired one to one in path order per hash; (path, old_path, hash, mtime, page_id).

    The stored hash is compared with the new note's ``rename_on`` hash. Equal empty hashes pair too. A hash that many notes share
    (a template, empty notes) is ranked in cells, so it needn't fit a task.
    """
    scratch = Scratch(notes.sparkSession, "renames")
    new = new_notes(notes, state).select(F.col(rename_on).alias("hash"), F.col("note_path").alias("path"), "mtime")
    old = vanished(notes, state).select(F.col("content_hash").alias("hash"), F.col("note_path").alias("old_path"), "page_id")
    return aligned(new, old, "hash", "path", "old_path", scratch).select("hash", "path", "mtime", "old_path", "page_id")


def _change(**values: Column) -> Column:
    return F.struct(*_row(**values))


def _changes(notes: DataFrame, state: DataFrame, seen: DataFrame | None, rename_on: str) -> DataFrame:
    """All changes: notes and state meet in one full outer join on the path, which is written. Notes on both sides give theirs where
    they are; new and vanished notes of equal hash are ranked by path within their side (``ranks.ranked``) and meet by (hash, rank).

    ``seen``: note_path, last_edited, archived of state rows whose page changed remotely.
    """
    scratch = Scratch(notes.sparkSession, "changes")
    n = notes.select("note_path", F.struct("content_hash", "frontmatter_hash", "full_hash", "mtime").alias("n"))
    s = state.select("note_path", "page_id", "content_hash", "frontmatter_hash", "status", "remote_mtime")
    if seen is not None:
        s = s.join(seen.select("note_path", "last_edited", "archived", F.lit(True).alias("seen")), "note_path", "left")
    else:
        s = s.withColumns({"last_edited": F.lit(None).cast("timestamp"), "archived": F.lit(None).cast("boolean"), "seen": F.lit(None).cast("boolean")})
    s = s.select("note_path", F.struct(*s.columns[1:]).alias("s"))
    gone = F.col("n").isNull() & (_text("s.page_id") != "") & (F.coalesce(F.col("s.status"), F.lit("")) == "synced")
    side = F.when(F.col("s").isNull(), "new").when(gone, "gone").otherwise("both")
    rows = scratch.save(n.join(s, "note_path", "full_outer").withColumn("side", side), "met")
    hash_ = F.when(F.col("side") == "new", F.col(f"n.{rename_on}")).otherwise(F.col("s.content_hash"))
    loose = rows.where("side <> 'both'").withColumn("meet", F.coalesce(F.concat(F.lit("h"), hash_), F.concat(F.lit("p"), "note_path")))
    one = lambda kind: F.first(F.when(F.col("side") == kind, F.struct("note_path", "n", "s")), ignorenulls=True).alias(kind)
    met = ranked(loose, ["meet", "side"], "note_path", scratch).groupBy("meet", "rank").agg(one("new"), one("gone"))

    n, s = F.col("n"), F.col("s")
    body, front = n["content_hash"] != _text(s["content_hash"]), n["frontmatter_hash"] != _text(s["frontmatter_hash"])
    differs = n.isNotNull() & (body | front)
    touched = F.coalesce(s["seen"], F.lit(False))
    conflict = touched | (F.coalesce(s["status"], F.lit("pending")) == "conflict")
    changed = _change(path=F.col("note_path"), type=F.when(conflict, "conflict").otherwise("modified"), direction=F.when(conflict, "both").otherwise("push"), local_hash=n["full_hash"], local_mtime=n["mtime"], remote_mtime=F.when(touched, s["last_edited"]).otherwise(s["remote_mtime"]), frontmatter_only=front & ~body, page_id=s["page_id"])
    remote_only = lambda path, s: _change(path=path, type=F.when(s["archived"], "deleted").otherwise("modified"), direction=F.lit("pull"), remote_mtime=s["last_edited"], frontmatter_only=F.lit(False), page_id=s["page_id"])
    new, old = F.col("new"), F.col("gone")
    renamed = _change(path=new["note_path"], old_path=old["note_path"], type=F.lit("renamed"), direction=F.lit("push"), local_hash=new["n"][rename_on], local_mtime=new["n"]["mtime"], frontmatter_only=F.lit(False), page_id=old["s"]["page_id"])
    created = _change(path=new["note_path"], type=F.lit("created"), direction=F.lit("push"), local_hash=new["n"]["full_hash"], local_mtime=new["n"]["mtime"], frontmatter_only=F.lit(False))
    old_seen = F.coalesce(old["s"]["seen"], F.lit(False))
    deleted = _change(path=old["note_path"], type=F.when(old_seen, "conflict").otherwise("deleted"), direction=F.when(old_seen, "both").otherwise("push"), remote_hash=old["s"]["content_hash"], remote_mtime=F.when(old_seen, old["s"]["last_edited"]), frontmatter_only=F.lit(False), page_id=old["s"]["page_id"])
    moved = new.isNotNull() & old.isNotNull()
    stays = F.array(F.when(differs, changed).when(touched, remote_only(F.col("note_path"), s)))
    moves = F.array(F.when(moved, renamed).when(new.isNotNull(), created).otherwise(deleted), F.when(moved & old_seen, remote_only(old["note_path"], old["s"])))
    # Exploded, so that a change is made once and not anew for each of its fields.
    each = lambda df, changes: df.select(F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("c")).select("c.*")
    return each(rows.where("side = 'both'"), stays).unionByName(each(met, moves))


def local_changes(notes: DataFrame, state: DataFrame, rename_on: str = "full_hash") -> DataFrame:
    """Every change a push would carry: modified and conflicting, renamed, created, deleted; a path is in one row at most."""
    return _changes(notes, state, None, rename_on)


def _edited(remote: str, local: str) -> Column:
    """Edited after the stored time, both in whole seconds; a missing stored time is before all."""
    stored = F.date_trunc("second", F.coalesce(F.col(local), F.lit("1970-01-01").cast("timestamp")))
    return F.coalesce(F.date_trunc("second", F.col(remote)) > stored, F.lit(False))


def all_changes(notes: DataFrame, state: DataFrame, remote: DataFrame, rename_on: str = "full_hash") -> DataFrame:
    """Local changes overlaid with remote ones. A remote row with an error counts as unseen.

    Archived pages: a local change becomes a conflict, else the note is deleted by the pull. Pages edited since: a local
    change becomes a conflict; an unchanged or missing note is pulled.
    """
    seen = state.where(_text("page_id") != "").join(remote.where(F.col("error").isNull()).select("page_id", "last_edited", "archived"), "page_id")
    return _changes(notes, state, seen.where(F.col("archived") | _edited("last_edited", "remote_mtime")), rename_on)


def remote_changes(state: DataFrame, remote: DataFrame) -> DataFrame:
    """Pages edited after their last sync: modified by the pull, or a conflict where the state says so."""
    seen = state.where(_text("page_id") != "").join(remote.where("error is null and not archived").select("page_id", "last_edited"), "page_id")
    conflict = F.col("status") == "conflict"
    return seen.where(_edited("last_edited", "last_sync")).select(*_row(path=F.col("note_path"), type=F.when(conflict, "conflict").otherwise("modified"), direction=F.when(conflict, "both").otherwise("pull"), local_mtime=F.col("local_mtime"), remote_mtime=F.col("last_edited"), frontmatter_only=F.lit(False), page_id=F.col("page_id")))


def pull_candidates(state: DataFrame, remote: DataFrame, pull_all: bool = False) -> DataFrame:
    """(path, page_id, action): pull what was edited (or all), delete what isn't there any more."""
    seen = state.where(_text("page_id") != "").join(remote.select("page_id", "last_edited", "archived", "error", F.lit(True).alias("known")), "page_id", "left")
    gone = F.col("known").isNull() | F.coalesce(F.col("archived"), F.lit(False)) | F.coalesce(F.contains("error", F.lit("not found")), F.lit(False))
    edited = F.lit(pull_all) | _edited("last_edited", "remote_mtime")
    action = F.when(gone, "delete").when(F.col("error").isNull() & edited, "pull")
    return seen.select(F.col("note_path").alias("path"), "page_id", action.alias("action")).where("action is not null")


def discover_untracked(state: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote pages that no state row tracks: (page_id, title, path)."""
    from ..functions.text import sanitise_filename

    tracked = state.where(_text("page_id") != "").select("page_id")
    title = F.when(_text("title") == "", "Untitled").otherwise(F.col("title"))
    return remote.join(tracked, "page_id", "left_anti").select("page_id", title.alias("title"), F.concat(sanitise_filename(title), F.lit(".md")).alias("path"))


def push_candidates(notes: DataFrame, state: DataFrame, push_all: bool = False) -> DataFrame:
    """What a push would send: everything, or local changes and pending rows that aren't among them."""
    if push_all:
        known = state.select("note_path", "page_id")
        return notes.join(known, "note_path", "left").select(F.col("note_path").alias("path"), F.when(_text("page_id") == "", "created").otherwise("modified").alias("type"))
    changes = local_changes(notes, state).where("direction <> 'pull'").select("path", "type")
    pending = state.where("status = 'pending'").select(F.col("note_path").alias("path"), F.when(_text("page_id") == "", "created").otherwise("modified").alias("type"))
    return changes.unionByName(pending.join(changes, "path", "left_anti"))


def sync_plan(notes: DataFrame, state: DataFrame, remote: DataFrame, strategy: str = "newer") -> DataFrame:
    """(path, type, action): push, pull or conflict for each path. Conflicts are settled by strategy: ours, theirs, newer
    (later of both times; the remote's if the local one is unknown) or manual (they stay). A path has one action."""
    changes = all_changes(notes, state, remote)
    is_conflict = F.col("type") == "conflict"
    settled = {"ours": F.lit("push"), "theirs": F.lit("pull"), "manual": F.lit("conflict"), "newer": F.when(F.coalesce(F.col("local_mtime") > F.col("remote_mtime"), F.lit(False)), "push").otherwise("pull")}[strategy]
    return changes.select("path", "type", F.when(is_conflict, settled).otherwise(F.col("direction")).alias("action"))


def poll_conflicts(notes: DataFrame, state: DataFrame, remote: DataFrame, strategy: str = "manual") -> DataFrame:
    """Remotely edited pages as a poll handles them: (path, action). Unchanged notes are pulled; changed ones go by strategy."""
    seen = state.where(_text("page_id") != "").join(remote.where("error is null and not archived").select("page_id", "last_edited"), "page_id").where(_edited("last_edited", "remote_mtime"))
    both = seen.join(notes.select("note_path", F.col("content_hash").alias("body"), "mtime"), "note_path", "left")
    clash = F.coalesce(F.col("body") != _text("content_hash"), F.lit(False))
    settled = {"ours": F.lit("keep"), "theirs": F.lit("pull"), "manual": F.lit("conflict"), "newer": F.when(F.coalesce(F.col("mtime") > F.col("last_edited"), F.lit(False)), "keep").otherwise("pull")}[strategy]
    return both.select(F.col("note_path").alias("path"), F.when(clash, settled).otherwise("pull").alias("action"))


# filters, counts and unions over changes


def by_direction(changes: DataFrame, direction: str) -> DataFrame:
    return changes.where(F.col("direction") == direction)


def by_type(changes: DataFrame, kind: str) -> DataFrame:
    return changes.where(F.col("type") == kind)


def has_conflicts(changes: DataFrame) -> DataFrame:
    return changes.agg(F.coalesce(F.bool_or(F.col("type") == "conflict"), F.lit(False)).alias("has_conflicts"))


def count_by(changes: DataFrame, column: str) -> DataFrame:
    return changes.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def merge_conflicts(changes: DataFrame, more: DataFrame) -> DataFrame:
    """Conflicts of both, each path once."""
    first = by_type(changes, "conflict")
    return first.unionByName(by_type(more, "conflict").join(first.select("path"), "path", "left_anti"))


def status_summary(changes: DataFrame, state: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts. Pending state rows count as new besides, as the status report has it."""
    count = lambda cond: F.count_if(cond).cast("long")
    both = lambda kind, way: (F.col("type") == kind) & (F.col("direction") == way)
    parts = [
        changes.agg(count(F.col("type") == "created").alias("created"), count(both("modified", "push")).alias("modified"), count(both("modified", "pull")).alias("to_pull"), count(F.col("type") == "deleted").alias("deleted"), count(F.col("type") == "renamed").alias("renamed"), count(F.col("type") == "conflict").alias("conflicts")),
        state.agg(count(F.col("status") == "synced").alias("synced"), count(F.col("status") == "pending").alias("pending")),
        links.agg(F.count(F.lit(1)).alias("links"), count(F.col("resolved")).alias("resolved_links")),
    ]
    names = [c for p in parts for c in p.columns]
    # Three rows of one, laid over each other.
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).agg(*(F.max(c).alias(c) for c in names))
    return one.select((F.col("created") + F.col("pending")).alias("new"), "modified", "to_pull", "deleted", "renamed", "conflicts", "synced", "pending", "links", "resolved_links", (F.col("links") - F.col("resolved_links")).alias("unresolved_links"))
