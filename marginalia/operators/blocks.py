"""Notes as flat tables of blocks and back. ``block_path``, the ordinals from the root, gives document order when sorted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import richtext
from ..functions.richtext import RUN
from ..schema import BLOCKS
from ..scratch import Scratch
from ..session import share_package

_RUN = pa.struct([(n, pa.string() if n in ("type", "content", "link", "page_id", "color") else pa.bool_()) for n in md.RUN])
_KINDS = {"page_key": pa.string(), "block_path": pa.list_(pa.int32()), "depth": pa.int32(), "type": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "rich_text": pa.list_(_RUN)}


#: Notes whose blocks are held at once.
NOTES = 250


def note_blocks(notes: DataFrame, key: str = "path", body: str = "body", icons: dict[str, str] | None = None) -> DataFrame:
    """schema.BLOCKS of every note's body. Links stay unresolved runs of type ``link`` until ``render_links``.

    Notes are dealt out over all tasks first: reading one takes long, and a table of one file or row group would be one task's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, NOTES) for b in batches for at in range(0, b.num_rows, NOTES)):
            rows = []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, b in md.flat(md.parse(text or "", icons=icons)):
                    rows.append((page, list(path), len(path) - 1, b.type, list(b.attrs.items()), b.runs))
            columns = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, _KINDS.values(), strict=True)], list(_KINDS))

    share_package(notes.sparkSession)
    pages = notes.select(F.col(key).cast("string").alias("page_key"), F.col(body).alias("body"))
    return pages.repartition(int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_key").mapInArrow(run, BLOCKS)


def render_links(blocks: DataFrame, resolved: DataFrame, style: str = "placeholder") -> DataFrame:
    """Placeholders of links (red ``[[target]]`` runs) become mentions where ``resolved`` (target, page_id) has their page; else they
    go (skip), become plain text (text) or stay (placeholder).

    Blocks are written once, as they are read again with what their links resolve to, and making them takes long. Only those with
    links are joined.
    """
    blocks = Scratch(blocks.sparkSession, "links").save(blocks, "blocks")
    is_link = lambda r: (r["type"] == "text") & (r["color"] == "red") & r["content"].startswith("[[")
    target = lambda r: F.regexp_extract(r["content"], r"^\[\[(.*)\]\]$", 1)
    page = lambda r: F.regexp_extract(target(r), "^[^#^]*", 0)
    has_link = F.coalesce(F.exists("rich_text", is_link), F.lit(False))
    linking = blocks.where(has_link)
    wanted = linking.select("page_key", "block_path", F.explode(F.array_distinct(F.transform(F.filter("rich_text", is_link), page))).alias("target"))
    found = wanted.join(resolved.select("target", "page_id"), "target").groupBy("page_key", "block_path").agg(F.map_from_entries(F.collect_list(F.struct("target", "page_id"))).alias("__found"))
    joined = linking.join(found, ["page_key", "block_path"], "left")
    known = lambda r: F.element_at("__found", page(r))
    change = lambda r, **new: F.struct(*((new[n] if n in new else r[n]).alias(n) for n in md.RUN)).cast(RUN)
    shown = lambda r: F.regexp_replace(F.element_at(F.split(page(r), "/"), -1), r"\.md\z", "")
    fallback = {"skip": lambda r: F.lit(None).cast(RUN), "text": lambda r: change(r, content=shown(r), color=F.lit(None).cast("string")), "placeholder": lambda r: r.cast(RUN)}[style]
    each = lambda r: F.when(~F.coalesce(is_link(r), F.lit(False)), r.cast(RUN)).when(known(r).isNotNull(), change(r, type=F.lit("mention"), content=shown(r), page_id=known(r), color=F.lit(None).cast("string"))).otherwise(fallback(r))
    shown_links = joined.withColumn("rich_text", F.filter(F.transform("rich_text", each), lambda r: r.isNotNull())).select(*blocks.columns)
    return shown_links.unionByName(blocks.where(~has_link))


def blocks_markdown(blocks: DataFrame, paths: DataFrame | None = None, icons: dict[str, str] | None = None) -> DataFrame:
    """(page_key, markdown) of every page. ``paths``: page_id, note_path of pages that mentions name, the first path of each page. A
    group is one page's blocks.

    Runs become text by expressions, so Python gets a text per block and puts the blocks together. With ``paths`` blocks are written
    once, as those with mentions are read again with the paths; the others are not joined.
    """
    if paths is None:
        texts = _texts(blocks)
    else:
        blocks = Scratch(blocks.sparkSession, "markdown").save(blocks, "blocks")
        has_mention = F.coalesce(F.exists("rich_text", lambda r: r["type"] == "mention"), F.lit(False))
        naming = blocks.where(has_mention)
        mentions = naming.select("page_key", "block_path", F.explode("rich_text").alias("r")).where("r.type = 'mention'").select("page_key", "block_path", F.col("r.page_id").alias("page_id")).distinct()
        first = paths.where("page_id is not null and note_path is not null").groupBy("page_id").agg(F.regexp_replace(F.min("note_path"), r"\.md\z", "").alias("p"))
        named = mentions.join(first, "page_id").groupBy("page_key", "block_path").agg(F.map_from_entries(F.collect_list(F.struct("page_id", "p"))).alias("paths"))
        texts = _texts(naming.join(named, ["page_key", "block_path"], "left"), F.col("paths")).unionByName(_texts(blocks.where(~has_mention)))
    # Dealt by number, which adaptive plans leave as it is: few bytes of blocks take long to render.
    dealt = texts.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_key")
    pages = dealt.groupBy("page_key").agg(F.sort_array(F.collect_list(F.struct("block_path", "type", "attrs", "text"))).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, NOTES) for b in batches for at in range(0, b.num_rows, NOTES)):
            texts = []
            for rows in batch.column(1).to_pylist():
                tree = md.nest([(r["block_path"], md.Block(r["type"], [md.run(r["text"])], {a["key"]: a["value"] for a in r["attrs"] or []})) for r in rows])
                texts.append(md.render(tree, icons=icons))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_key", "markdown"])

    share_package(blocks.sparkSession)
    return pages.select("page_key", "blocks").mapInArrow(run, "page_key string, markdown string")


def _texts(blocks: DataFrame, paths: Column | None = None) -> DataFrame:
    """Blocks with their runs as one text; code as it is. Attributes are entries, as maps have no order."""
    text = F.when(F.col("type") == "code", richtext.plain(F.col("rich_text"))).otherwise(richtext.markdown(F.col("rich_text"), paths))
    return blocks.select("page_key", "block_path", "type", F.map_entries("attrs").alias("attrs"), F.coalesce(text, F.lit("")).alias("text"))
