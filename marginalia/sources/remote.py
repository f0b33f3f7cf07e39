"""The remote workspace as tables: pages, properties and flat blocks. A write is a table of requests; nothing here has side effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values.
APPEND_BATCH = 100
PAGE_SIZE = 100
CHILD_TYPES = ("paragraph", "bulleted_list_item", "numbered_list_item", "to_do", "toggle", "quote", "callout", "table", "column_list", "synced_block")
UPDATABLE = {
    "paragraph": ("rich_text",), "heading_1": ("rich_text",), "heading_2": ("rich_text",), "heading_3": ("rich_text",), "bulleted_list_item": ("rich_text",),
    "numbered_list_item": ("rich_text",), "to_do": ("rich_text", "checked"), "toggle": ("rich_text",), "quote": ("rich_text",), "callout": ("rich_text", "icon"),
    "code": ("rich_text", "language"), "equation": ("expression",), "image": ("url",), "bookmark": ("url",), "divider": (),
}


def page(pages: DataFrame, page_id: str) -> DataFrame:
    return pages.where(F.col("page_id") == page_id)


def batch_metadata(ids: DataFrame, pages: DataFrame) -> DataFrame:
    """Metadata of all ids; those unknown have an error."""
    found = ids.select("page_id").join(pages.select("page_id", "last_edited", "archived", "error", F.lit(True).alias("__known")), "page_id", "left")
    missing = F.col("__known").isNull()
    return found.withColumn("error", F.when(missing, F.concat(F.lit("page not found: "), "page_id")).otherwise(F.col("error"))).drop("__known")


def known_metadata(ids: DataFrame, pages: DataFrame) -> DataFrame:
    """Metadata of the ids that are known; failures are left out."""
    return ids.select("page_id").join(pages.where(F.col("error").isNull()), "page_id")


def cached_metadata(ids: DataFrame, cache: DataFrame, pages: DataFrame, now: Column, ttl: Column) -> tuple[DataFrame, DataFrame]:
    """(metadata, new cache): rows fetched within ``ttl`` come from the cache, only the rest from ``pages``."""
    fresh = cache.where(F.col("fetched_at") > now - ttl)
    hits = fresh.join(ids.select("page_id"), "page_id", "left_semi")
    misses = batch_metadata(ids.join(fresh.select("page_id"), "page_id", "left_anti"), pages).withColumn("fetched_at", now).select(*cache.columns)
    kept = cache.join(misses.select("page_id"), "page_id", "left_anti")
    return hits.unionByName(misses), kept.unionByName(misses)


def clear_cache(cache: DataFrame, page_id: str | None = None) -> DataFrame:
    return cache.limit(0) if page_id is None else cache.where(F.col("page_id") != page_id)


def search(pages: DataFrame, query: str) -> DataFrame:
    return pages.where(F.contains(F.lower("title"), F.lit(query.lower())))


def full_pages(properties: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_key, properties, blocks in document order)."""
    ordered = blocks.groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("block_path", "depth", "type", "attrs", "rich_text"))).alias("blocks"))
    return properties.join(ordered, "page_key", "left")


def children(blocks: DataFrame, parent: list[int] | None = None) -> DataFrame:
    """All blocks below a block: those whose path it begins."""
    if not parent:
        return blocks
    n = len(parent)
    return blocks.where((F.size("block_path") > n) & (F.slice("block_path", 1, n) == F.array(*map(F.lit, parent))))


def append_batches(blocks: DataFrame, size: int = APPEND_BATCH) -> DataFrame:
    """``batch`` and ``batch_pos`` of each top-level block of a page, at most ``size`` a request."""
    at = F.row_number().over(Window.partitionBy("page_key").orderBy("block_path")) - 1
    return blocks.where("depth = 0").withColumn("__at", at).withColumns({"batch": F.floor(F.col("__at") / size).cast("bigint"), "batch_pos": (F.col("__at") % size).cast("bigint")}).drop("__at")


def replace_blocks(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """The page update: all blocks of the pages in ``new`` go, its own come."""
    return blocks.join(new.select("page_key").distinct(), "page_key", "left_anti").unionByName(new)


def delete_blocks(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    return blocks.join(keys.select("page_key").distinct(), "page_key", "left_anti")


def archive(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Deleting a page is archiving it."""
    hit = ids.select("page_id").distinct().withColumn("__hit", F.lit(True))
    return pages.join(hit, "page_id", "left").withColumn("archived", F.col("archived") | F.col("__hit").isNotNull()).drop("__hit")


def update_titles(pages: DataFrame, titles: DataFrame) -> DataFrame:
    new = titles.select("page_id", F.col("title").alias("__title"))
    return pages.join(new, "page_id", "left").withColumn("title", F.coalesce("__title", "title")).drop("__title")


def create_requests(rendered: DataFrame, database_id: str | None = None, parent_page: str | None = None) -> DataFrame:
    """One row a page to create: its parent, properties and number of append requests. Under a page only the title is kept."""
    if (database_id is None) == (parent_page is None):
        raise ValueError("name a database or a parent page")
    properties = F.col("properties") if database_id else title_only(F.col("properties"))
    kind, parent = ("database_id", database_id) if database_id else ("page_id", parent_page)
    return rendered.select("page_key", F.lit(kind).alias("parent_type"), F.lit(parent).alias("parent"), properties.alias("properties"), F.ceil(F.size("blocks") / APPEND_BATCH).cast("int").alias("append_requests"))


def title_only(properties: Column) -> Column:
    """A page under a page has its title as only property, by the name ``title``."""
    titles = F.map_filter(properties, lambda _, v: v["type"] == "title")
    return F.transform_keys(titles, lambda k, _: F.lit("title"))


def block_update(block_type: Column, attrs: Column) -> Column:
    """What an update of a block may set; an error for other types."""
    fields = F.lit(None).cast("array<string>")
    for kind, names in UPDATABLE.items():
        fields = F.when(block_type == kind, F.array(*map(F.lit, names)).cast("array<string>")).otherwise(fields)
    known = F.when(block_type.isin(*UPDATABLE), fields).otherwise(F.raise_error(F.concat(F.lit("block type can't be updated: "), block_type)).cast("array<string>"))
    return F.map_filter(attrs, lambda k, _: F.array_contains(known, k))


def has_children(blocks: DataFrame) -> DataFrame:
    """(page_key, block_path, has_children)."""
    parents = blocks.where("depth > 0").select("page_key", F.slice("block_path", 1, F.size("block_path") - 1).alias("block_path")).distinct().withColumn("__p", F.lit(True))
    return blocks.join(parents, ["page_key", "block_path"], "left").select("page_key", "block_path", (F.col("__p").isNotNull() & F.col("type").isin(*CHILD_TYPES)).alias("has_children"))
