"""State, aliases, history and configuration as immutable snapshots: a write is a new snapshot, the latest row of a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def null_string(c: str) -> Column:
    """Empty strings are stored as null."""
    return F.nullif(F.col(c), F.lit(""))


def whole_seconds(c: str) -> Column:
    """Times are stored in whole seconds."""
    return F.date_trunc("second", c)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of equal key, all columns. Keys of ``rows`` are distinct. An anti-join, so old rows move once."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*table.columns))


def upsert_latest(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """As ``upsert`` where ``rows`` may repeat keys: the row of the largest version wins (aggregated before the shuffle)."""
    values = [c for c in table.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max(F.struct(version, *[c for c in values if c != version])).alias("b")).select(*keys, *(F.col(f"b.{c}").alias(c) for c in values))
    return upsert(table, latest, keys)


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on), on, "left_anti")


def rename_paths(table: DataFrame, moves: DataFrame, column: str = "note_path") -> DataFrame:
    """``moves``: old_path, new_path, one row a path."""
    joined = table.join(moves.select(F.col("old_path").alias("__old"), F.col("new_path").alias("__new")), F.col(column) == F.col("__old"), "left")
    return joined.withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def upsert_aliases(aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """Aliases of the batch without empty names; type is updated."""
    return upsert(aliases, rows.where("alias_name <> ''").dropDuplicates(["note_path", "alias_name"]), ["note_path", "alias_name"])


def by_status(state: DataFrame, status: str | None = None) -> DataFrame:
    return (state if not status else state.where(F.col("status") == status)).orderBy("note_path")


def lookup(table: DataFrame, column: str, value: str) -> DataFrame:
    return table.where(F.col(column) == value)


def conflicts(state: DataFrame) -> DataFrame:
    return state.where("status = 'conflict'")


def has_conflict(state: DataFrame, path: str) -> DataFrame:
    return state.where(F.col("note_path") == path).agg(F.coalesce(F.bool_or(F.col("status") == "conflict"), F.lit(False)).alias("has_conflict"))


def latest_conflict(history: DataFrame, action: str = "conflict") -> DataFrame:
    """(note_path, details, ts) of the latest conflict row of each path."""
    return history.where(F.col("action") == action).groupBy("note_path").agg(F.max_by(F.struct("details", "ts"), F.struct("ts", "seq")).alias("b")).select("note_path", "b.details", "b.ts")


def recent_history(history: DataFrame, n: int = 50, path: str | None = None) -> DataFrame:
    rows = history if path is None else history.where(F.col("note_path") == path)
    return rows.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def retain_history(history: DataFrame, now: Column, age: Column) -> DataFrame:
    """What a clean-up of rows older than ``age`` leaves."""
    return history.where(F.col("ts") >= now - age)


def expired_count(history: DataFrame, now: Column, age: Column) -> DataFrame:
    return history.agg(F.count_if(F.col("ts") < now - age).alias("removed"))


#: Cells of rows that are numbered side by side; their offsets are broadcast.
NUMBER_CELLS = 4096
CONFLICT = "local_hash string, remote_hash string, local_mtime timestamp, remote_mtime timestamp"


def record_conflicts(state: DataFrame, history: DataFrame, found: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """State with the paths of ``found`` in conflict, and history with a row for each, its details in JSON. Unknown paths are ignored."""
    known = found.join(state.select("note_path"), "note_path", "left_semi")
    new_state = _set_status(state, known, "conflict", at)
    rows = known.select("note_path", F.to_json(F.struct("local_hash", "remote_hash", "local_mtime", "remote_mtime")).alias("details"), F.col("local_hash").alias("content_hash"))
    # Numbered after the last sequence number: within cells of bounded number, with the cells' offsets.
    last = history.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    cells = rows.withColumn("cell", F.pmod(F.xxhash64("note_path"), F.lit(NUMBER_CELLS)))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("cell", before.alias("before")).crossJoin(F.broadcast(last))
    here = F.row_number().over(Window.partitionBy("cell").orderBy("note_path"))
    numbered = cells.withColumn("here", here).join(F.broadcast(offsets), "cell").select((F.col("last") + F.col("before") + F.col("here")).cast("long").alias("seq"), "note_path", F.lit("conflict").alias("action"), at.alias("ts"), "content_hash", "details")
    return new_state, history.unionByName(numbered.select(*history.columns))


def resolve_conflicts(state: DataFrame, paths: DataFrame, at: Column) -> DataFrame:
    return _set_status(state, paths, "synced", at)


def _set_status(state: DataFrame, paths: DataFrame, status: str, at: Column) -> DataFrame:
    hit = F.col("__hit").isNotNull()
    joined = state.join(paths.select("note_path").distinct().withColumn("__hit", F.lit(True)), "note_path", "left")
    return joined.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "last_sync": F.when(hit, at).otherwise(F.col("last_sync"))}).select(*state.columns)


def parse_details(history: DataFrame) -> DataFrame:
    return history.withColumn("conflict", F.from_json("details", CONFLICT))


def deletion_plan(changes: DataFrame, remote: str = "archive", local: str = "archive", archive_dir: str = "_archive") -> DataFrame:
    """(path, page_id, action, to) for deleted rows: pushes delete pages, pulls delete notes, each by its strategy."""
    gone = changes.where("type = 'deleted'")
    push = F.col("direction") == "push"
    action = F.when(push, F.lit({"archive": "archive_page", "delete": "archive_page", "ignore": "ignore"}[remote])).otherwise(F.lit({"archive": "move_note", "delete": "remove_note", "ignore": "ignore"}[local]))
    to = F.when(action == "move_note", F.concat(F.lit(archive_dir + "/"), F.element_at(F.split("path", "/"), -1)))
    return gone.select("path", "page_id", action.alias("action"), to.alias("to"))


def apply_renames(state: DataFrame, links: DataFrame, aliases: DataFrame, moves: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State, links and aliases after renames; moved state rows are stamped."""
    moved = rename_paths(state.join(moves.select(F.col("old_path").alias("note_path"), F.lit(True).alias("__moved")), "note_path", "left"), moves)
    moved = moved.withColumn("last_sync", F.when(F.col("__moved").isNotNull(), at).otherwise(F.col("last_sync"))).drop("__moved")
    return moved.select(*state.columns), rename_paths(links, moves, "source_path"), rename_paths(aliases, moves)
