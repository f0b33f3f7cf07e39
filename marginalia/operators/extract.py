"""Whole notes parsed: frontmatter, links, embeds, tags and queries outside code. Texts are read by expressions; only the
frontmatter's block goes to Python, in Arrow batches, as YAML needs it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import notes as nt
from ..functions import text
from ..session import share_package


def _read_yaml(lenient: bool):
    """From blocks to struct(json, error)."""

    @F.pandas_udf("json string, error string")
    def read(blocks: pd.Series) -> pd.DataFrame:
        rows = []
        for block in blocks:
            try:
                rows.append((fm.to_json(fm.parse(block, lenient)), None))
            except fm.FrontmatterError as e:
                rows.append(("{}", str(e)))
        return pd.DataFrame(rows, columns=["json", "error"])

    return read


def parse_notes(notes: DataFrame, path: str = "path", content: str = "content", lenient: bool = False) -> DataFrame:
    """path, frontmatter (VARIANT), body, links, embeds, tags, queries, error of every note; null content counts as empty.

    Broken or unclosed frontmatter is an error: the content stays whole and links, embeds and tags are none. Leniently it is
    read by lines, or all body. Tags are those of the text, then those of the frontmatter's list.
    """
    share_package(notes.sparkSession)
    whole = notes.select(F.col(path).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    cut = whole.withColumn("cut", nt.split_frontmatter(F.col("content"), lenient))
    read = cut.withColumn("read", F.when(F.col("cut.block").rlike(r"\S"), _read_yaml(lenient)(F.col("cut.block"))))
    error = F.when(F.col("cut.unclosed"), "frontmatter isn't closed").otherwise(F.col("read.error"))
    read = read.select("path", fm.variant(F.coalesce("read.json", F.lit("{}"))).alias("frontmatter"), F.when(error.isNull(), F.col("cut.body")).otherwise(F.col("content")).alias("body"), error.alias("error"))
    parts = read.withColumn("parts", nt.note_parts(F.when(F.col("error").isNull(), F.col("body"))))
    kind = F.schema_of_variant(F.try_variant_get("frontmatter", "$.tags", "variant"))
    listed = F.when(kind.startswith("ARRAY"), F.try_variant_get("frontmatter", "$.tags", "array<string>"))
    return parts.select("path", "frontmatter", "body", "parts.links", "parts.embeds", text.merge_tags(F.col("parts.tags"), listed).alias("tags"), "error", text.queries(F.col("body")).alias("queries"))


def note_edges(notes: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, links, embeds and the text's own tags of every note, without a Python worker: frontmatter is cut off unread, and what
    isn't closed is text."""
    body = nt.split_frontmatter(F.coalesce(F.col(content), F.lit("")), lenient=True)["body"]
    parts = notes.select(F.col(path).alias("path"), body.alias("body")).withColumn("parts", nt.note_parts(F.col("body")))
    return parts.select("path", "parts.links", "parts.embeds", "parts.tags")


def page_aliases(parsed: DataFrame) -> DataFrame:
    """(note_path, alias_name, alias_type) of titles and listed aliases."""
    title = parsed.select(F.col("path").alias("note_path"), fm.title(F.col("frontmatter")).alias("alias_name"), F.lit("title").alias("alias_type"))
    listed = parsed.select(F.col("path").alias("note_path"), F.explode(fm.get_list(F.col("frontmatter"), "aliases")).alias("alias_name"), F.lit("alias").alias("alias_type"))
    return title.unionByName(listed).where("alias_name <> ''").dropDuplicates(["note_path", "alias_name"])


def link_edges(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("source_path"), F.explode("links").alias("l")).select("source_path", "l.*")
