"""Paged reads of a remote workspace: cursor loops in tasks, a data source for database queries, and block trees level by level.

A service answers one request with one page of rows and the cursor of the next. Which service it is, is the caller's: ``connect``
is called once a task and gives an object with ``children(parent_id, cursor, size)``; a class of the data source's ``service`` option
gives ``databases()`` and ``query(database_id, wanted, cursor, size)``. ``Export`` reads a workspace that was written as Parquet.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import import_module

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.ranks import ranked
from ..scratch import Scratch
from ..session import share_package
from .remote import PAGE_SIZE

BLOCK = "block_id string, parent_id string, type string, text string, has_children boolean"
PAGE = "database_id string, page_id string, title string, tag string, archived boolean"

Answer = tuple[pa.Table, int | None]

#: Bytes of a row group of an export, about: what a request reads at most before its first row.
ROW_GROUP = 1 << 20


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def cursor_loop(ask: Callable[[int | None], Answer], wait: Callable[[], None] = lambda: None) -> Iterator[tuple[int, pa.Table]]:
    """(number of the request, its rows), from 1, until a page has no next cursor. An empty parent takes one request too."""
    cursor, n, more = None, 0, True
    while more:
        wait()
        rows, after = ask(cursor)
        n += 1
        yield n, rows
        if after is not None and after == cursor:
            raise ValueError(f"the service gave cursor {cursor} again")
        cursor, more = after, after is not None


# a workspace written as Parquet


def export_rows(rows: DataFrame, path: str, parent: str, order: str, scratch: Scratch) -> None:
    """Writes rows by parent and place (``pos``, from 0, by ``order``), in files that each hold a range of them."""
    placed = ranked(rows, [parent], order, scratch).withColumn("pos", F.col("rank") - 1).drop("rank", order)
    placed.repartitionByRange(parent, "pos").sortWithinPartitions(parent, "pos").write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)


class Export:
    """A service over two exported tables, ``blocks`` (``BLOCK``) and ``pages`` (``PAGE``), below ``path``, which tasks can read. A
    cursor is the place of the next row.

    Rows lie in order over files and row groups, whose footers say which parents they hold, so a request reads the row groups of its
    rows alone. The last one read is kept: parents asked in order read each about once.
    """

    def __init__(self, path: str):
        self._fs, self._root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self._open: dict[str, list[tuple[str, str, int, int, str, int]]] = {}
        self._none: dict[str, pa.Table] = {}
        self._last: tuple[tuple[str, int] | None, pa.Table | None] = (None, None)
        self._goes_on: tuple[tuple[str, str, int | None] | None, int] = (None, 0)
        #: Row groups read.
        self.reads = 0

    def _groups(self, table: str, parent: str) -> list[tuple[str, str, int, int, str, int]]:
        """Row groups in the order of their rows: first and last parent, least and greatest pos, file, number. Read once a task."""
        if table not in self._open:
            found = []
            for info in self._fs.get_file_info(fs.FileSelector(f"{self._root}/{table}")):
                if not info.path.endswith(".parquet"):
                    continue
                with pq.ParquetFile(info.path, filesystem=self._fs) as file:
                    self._none[table] = file.schema_arrow.empty_table()
                    at = {name: file.schema_arrow.get_field_index(name) for name in (parent, "pos")}
                    for g in range(file.num_row_groups):
                        names, places = (file.metadata.row_group(g).column(at[c]).statistics for c in (parent, "pos"))
                        if names is not None and names.has_min_max and places is not None and places.has_min_max:
                            found.append((names.min, names.max, places.min, places.max, info.path, g))
                        elif names is None or names.null_count != file.metadata.row_group(g).num_rows:
                            rows = file.read_row_group(g, columns=[parent, "pos"]).drop_null()
                            if len(rows):
                                ends = (pc.min_max(rows.column(c)).as_py() for c in (parent, "pos"))
                                found.append((*(e[k] for e in ends for k in ("min", "max")), info.path, g))
            self._open[table] = sorted(found)
        return self._open[table]

    def _read(self, path: str, group: int) -> pa.Table:
        if self._last[0] != (path, group):
            with pq.ParquetFile(path, filesystem=self._fs) as file:
                self._last = (path, group), file.read_row_group(group)
            self.reads += 1
        return self._last[1]

    def _page(self, table: str, parent: str, parent_id: str, cursor: int | None, size: int, also: ds.Expression | None = None) -> Answer:
        groups = self._groups(table, parent)
        which = (ds.field(parent) == parent_id) & (ds.field("pos") >= (cursor or 0))
        # A page that goes on begins in the row group that the one before it ended in.
        at = self._goes_on[1] if self._goes_on[0] == (table, parent_id, cursor) else bisect_left(groups, parent_id, key=lambda g: g[1])
        parts, n = [], 0
        # The first rows found are the page; one more tells whether there is a next.
        while at < len(groups) and groups[at][0] <= parent_id and n <= size:
            _, _, _, last, path, group = groups[at]
            if last >= (cursor or 0):
                parts.append(self._read(path, group).filter(which if also is None else which & also).slice(0, size + 1 - n))
                n += len(parts[-1])
            at += 1
        if not parts:
            return self._none[table], None
        found = pa.concat_tables(parts)
        after = found.column("pos")[size].as_py() if len(found) > size else None
        self._goes_on = (table, parent_id, after), at - 1
        return found.slice(0, size), after

    def children(self, parent_id: str, cursor: int | None, size: int) -> Answer:
        return self._page("blocks", "parent_id", parent_id, cursor, size)

    def databases(self) -> list[str]:
        """Of all databases, the ids; a workspace has few."""
        dataset = ds.dataset(f"{self._root}/pages", filesystem=self._fs, format="parquet")
        seen: set[str] = set()
        for batch in dataset.to_batches(columns=["database_id"]):
            seen.update(batch.column(0).unique().to_pylist())
        return sorted(seen)

    def query(self, database_id: str, wanted: dict[str, object], cursor: int | None, size: int) -> Answer:
        also = None
        for column, value in wanted.items():
            also = (ds.field(column) == value) if also is None else also & (ds.field(column) == value)
        return self._page("pages", "database_id", database_id, cursor, size, also)


# block trees


def fetch_children(parents: DataFrame, connect: Callable[[], object], size: int = PAGE_SIZE, limiter: Callable[[], object] | None = None) -> DataFrame:
    """The children of each ``parent_id``, in tasks: ``BLOCK``, pos and the number of the request (``request``, from 1) that brought each.

    A parent without children gives one row with a null block_id, so that every request is seen. Memory holds a page at a time.
    ``limiter``: makes an object whose ``wait`` is called before each request.
    """
    names = _names(BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service = connect()
        wait = limiter().wait if limiter else lambda: None
        for batch in batches:
            for parent in batch.column(0).to_pylist():
                for n, rows in cursor_loop(lambda at, p=parent: service.children(p, at, size), wait):
                    if not len(rows):
                        rows = pa.table({c: pa.nulls(1, pa.bool_() if c == "has_children" else pa.string()) for c in names} | {"pos": pa.nulls(1, pa.int64())})
                    columns = [pa.array([parent] * len(rows)) if c == "parent_id" else rows.column(c).combine_chunks() for c in names]
                    yield pa.RecordBatch.from_arrays([*columns, rows.column("pos").cast(pa.int64()).combine_chunks(), pa.array([n] * len(rows), pa.int32())], [*names, "pos", "request"])

    share_package(parents.sparkSession)
    return parents.select("parent_id").mapInArrow(run, f"{BLOCK}, pos long, request int")


def fetch_trees(pages: DataFrame, connect: Callable[[], object], size: int = PAGE_SIZE, deepest: int = 100, limiter: Callable[[], object] | None = None) -> DataFrame:
    """All blocks below each ``page_id``: page_id, block_path (places from the page down), depth, ``BLOCK``, pos, request.

    Level by level: the blocks of a level that have children are the parents of the next one, dealt out anew, so that a page with most
    of the blocks keeps no task busy alone. Each level is written. More than ``deepest`` levels are an error, as a block within
    itself would have. Rows with a null block_id tell of requests that found nothing.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "trees")
    parents = pages.select("page_id", F.col("page_id").alias("parent_id"), F.array().cast("array<long>").alias("above")).distinct()
    levels: list[DataFrame] = []
    for depth in range(deepest + 1):
        parents = scratch.save(parents, "parents")
        if parents.isEmpty():
            break
        if depth == deepest:
            raise ValueError(f"blocks more than {deepest} deep")
        # In ranges and in order, as services keep their rows: neighbours are read together.
        asked = parents.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "parent_id").sortWithinPartitions("parent_id")
        # Written before the join, so that no request is made twice.
        got = scratch.save(fetch_children(asked, connect, size, limiter), "level")
        level = got.join(parents, "parent_id").select("page_id", F.when(F.col("block_id").isNotNull(), F.concat("above", F.array("pos"))).alias("block_path"), F.lit(depth).alias("depth"), "block_id", "parent_id", "type", "text", "has_children", "pos", "request")
        levels.append(level)
        parents = level.where("has_children").select("page_id", F.col("block_id").alias("parent_id"), F.col("block_path").alias("above"))
    if not levels:
        return spark.createDataFrame([], f"page_id string, block_path array<long>, depth int, {BLOCK}, pos long, request int")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def request_counts(trees: DataFrame) -> DataFrame:
    """(page_id, blocks, requests) of ``fetch_trees``: what reading each page took."""
    last = trees.groupBy("page_id", "parent_id").agg(F.max("request").alias("n"), F.count("block_id").alias("blocks"))
    return last.groupBy("page_id").agg(F.sum("blocks").alias("blocks"), F.sum("n").alias("requests"))


# database queries


@dataclass
class _Database(InputPartition):
    database_id: str

    def __init__(self, database_id: str):
        super().__init__(database_id)
        self.database_id = database_id


class _QueryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.service = _service(options)
        self.size = int(options.get("pageSize", PAGE_SIZE))
        self.only = options.get("database")
        self.wanted = json.loads(options.get("wanted", "{}"))

    def partitions(self) -> list[InputPartition]:
        return [_Database(x) for x in ([self.only] if self.only else self.service.databases())]

    def read(self, partition: _Database) -> Iterator[pa.RecordBatch]:
        names = _names(PAGE)
        for n, rows in cursor_loop(lambda at: self.service.query(partition.database_id, self.wanted, at, self.size)):
            yield pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in names), pa.array([n] * len(rows), pa.int32())], [*names, "request"])


def _service(options: dict[str, str]) -> object:
    module, _, name = options.get("service", "marginalia.sources.paged:Export").partition(":")
    return getattr(import_module(module), name)(options["path"])


class WorkspacePages(DataSource):
    """``spark.read.format("workspace_pages")``: the pages of all databases, a partition each, with the request that brought them.

    Options: path (the service's address), service (``module:class``), pageSize, database (only that one), wanted (JSON of columns and
    the values they must have, which go with each request). ``query_pages`` sets them.

    Filters are options and are not taken from the plan: Spark 4.1 keeps what was pushed into a loaded table for its later queries,
    which then miss rows.
    """

    @classmethod
    def name(cls) -> str:
        return "workspace_pages"

    def schema(self) -> str:
        return f"{PAGE}, request int"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _QueryReader(self.options)


def register(spark: SparkSession) -> None:
    share_package(spark)
    spark.dataSource.register(WorkspacePages)


def query_pages(spark: SparkSession, path: str, database: str | None = None, wanted: dict[str, str | bool] | None = None, service: str | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """``PAGE`` and request of one database's pages, or of all databases', of those whose columns have the values ``wanted``."""
    register(spark)
    options = {"path": path, "pageSize": str(size), "wanted": json.dumps(wanted or {})} | ({"database": database} if database else {}) | ({"service": service} if service else {})
    return spark.read.format("workspace_pages").options(**options).load()
