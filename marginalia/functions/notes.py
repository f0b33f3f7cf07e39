"""Notes read by expressions alone: frontmatter cut off, code masked, blocks of lines, links, embeds and tags in them.

All is linear in a note's length: a note is cut once into lines and those into blocks, and matches are taken block by block, so
that a link's line is its block's and no offsets are searched. Nothing reaches from one block into the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import link_struct

#: The first line ``---`` opens, the next such line (or one at the very end) closes; LF or CRLF. Groups: the block, where the body
#: follows or is empty; neither for an empty block.
FRONTMATTER = r"(?s)\A---\r?\n(?:(.*?)\r?\n---\r?\n|---(?:\r?\n|\z)|(.*?)\r?\n---\z)"
_CLOSED = r"(?:.*?^ {{0,3}}{0}{1}*+[ \t\r]*+$|.*)"
#: A fence to the line that closes it, which is at least as long, or to the end. One of ` has no other ` on its line.
FENCED = r"(?dms)(?:^ {0,3}(`{3,}+)[^`\n]*+$" + _CLOSED.format(r"\1", "`") + r"|^ {0,3}(~{3,}+)[^\n]*+$" + _CLOSED.format(r"\2", "~") + ")"
INLINE_CODE = r"(?s)(?<!`)(`++)(?!`).+?(?<!`)\1(?!`)"
NOTE_LINK = r"(!?)\[\[([^\[\]|]+)(?:\|([^\[\]]+))?\]\]"
TAG = r"(?U)(?<![\w#&/\[])#((?=[\w/-]*[^\W\d])[\w/-]+)"
_QUOTE = r"^(?: {0,3}> ?)+"
_HEADING = r"^ {0,3}#{1,6}(?:\s|$)"
_STARTS = r"^\s*(?:#{1,6}\s|[-*+]\s|\d{1,9}[.)]\s|\|)"

_EDGE = "array<struct<target:string,alias:string,heading:string,block:string,line:int>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_frontmatter(content: Column, lenient: bool = False) -> Column:
    """struct(block, body, unclosed). Block is null without frontmatter; what isn't closed is all body, and unclosed unless lenient."""
    opened = content.rlike(r"\A---\r?\n")

    def parts(head: Column) -> Column:
        block = F.when(head != "", F.concat(F.regexp_extract(head, FRONTMATTER, 1), F.regexp_extract(head, FRONTMATTER, 2)))
        body = F.when(head != "", F.substr(content, F.length(head) + 1)).otherwise(content)
        return F.struct(block.alias("block"), body.alias("body"), (opened & (head == "") & F.lit(not lenient)).alias("unclosed"))

    return bound(F.when(opened, F.regexp_extract(content, FRONTMATTER, 0)).otherwise(""), parts)


def without_fences(body: Column) -> Column:
    """The body with fenced code blanked out, every line where it was."""
    code = F.transform(F.regexp_extract_all(body, F.lit(FENCED), 0), lambda c: F.regexp_replace(c, r"[^\n]", " "))
    parts = F.arrays_zip(F.split(body, FENCED, -1).alias("text"), code.alias("code"))
    masked = F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.coalesce(p["code"], F.lit("")))), "")
    return F.when(F.contains(body, F.lit("```")) | F.contains(body, F.lit("~~~")), masked).otherwise(body)


def _begins(line: Column, previous: Column) -> Column:
    """A line begins a block after a blank line or a heading, where a quote begins, and if it is a heading, an item or a table's row."""
    after = previous.isNull() | previous["blank"] | previous["inner"].rlike(_HEADING)
    return ~line["blank"] & F.coalesce(after | line["inner"].rlike(_STARTS) | (line["quoted"] & ~previous["quoted"]), F.lit(True))


def _seen(line: Column) -> Column:
    quoted = F.contains(line, F.lit(">")) & line.rlike(_QUOTE)
    inner = F.when(quoted, F.regexp_replace(line, _QUOTE, "")).otherwise(line)
    return F.struct(inner.alias("inner"), quoted.alias("quoted"), (~inner.rlike(r"\S")).alias("blank"))


def text_blocks(body: Column) -> Column:
    """array of struct(line, text): the blocks of a body in order, each with the number of its first line, from 1; no code in fences."""

    def firsts(lines: Column) -> Column:
        return F.filter(F.transform(lines, lambda x, i: F.when(_begins(x, F.get(lines, i - 1)), i + 1)), lambda n: n.isNotNull())

    def cut(lines: Column) -> Column:
        behind = F.size(lines) + 1
        one = lambda firsts: F.transform(firsts, lambda n, k: F.struct(n.alias("line"), F.array_join(F.slice(lines, n, F.coalesce(F.get(firsts, k + 1), behind) - n), "\n").alias("text")))
        return bound(bound(F.transform(lines, _seen), firsts), one)

    return bound(F.split(without_fences(body), "\n", -1), cut)


def _edges(block: Column) -> Column:
    groups = F.arrays_zip(*[F.regexp_extract_all(block["text"], F.lit(NOTE_LINK), k).alias(n) for k, n in ((1, "mark"), (2, "raw"), (3, "alias"))])

    def edge(x: Column) -> Column:
        link = link_struct(x["raw"], x["alias"])
        return F.struct((x["mark"] == "!").alias("embed"), *(link[n].alias(n) for n in ("target", "alias", "heading", "block")), block["line"].alias("line"))

    return F.transform(groups, edge)


def note_parts(body: Column) -> Column:
    """struct(links, embeds, tags) of a body, in order, outside code. An edge has target, alias, heading, block and its block's line.

    Null or empty bodies have none.
    """
    plain = F.transform(text_blocks(F.coalesce(body, F.lit(""))), lambda b: F.struct(b["line"].alias("line"), F.when(F.contains(b["text"], F.lit("`")), F.regexp_replace(b["text"], INLINE_CODE, " ")).otherwise(b["text"]).alias("text")))

    def parts(blocks: Column) -> Column:
        found = F.flatten(F.transform(F.filter(blocks, lambda b: F.contains(b["text"], F.lit("[["))), _edges))
        tags = F.flatten(F.transform(F.filter(blocks, lambda b: F.contains(b["text"], F.lit("#"))), lambda b: F.regexp_extract_all(F.regexp_replace(b["text"], NOTE_LINK, " "), F.lit(TAG), 1)))
        bare = lambda e: F.struct(*(e[n].alias(n) for n in ("target", "alias", "heading", "block", "line")))
        kept = lambda found, embeds: F.transform(F.filter(found, lambda e: e["embed"] == F.lit(embeds)), bare).cast(_EDGE)
        return bound(found, lambda found: F.struct(kept(found, False).alias("links"), kept(found, True).alias("embeds"), tags.alias("tags")))

    return bound(plain, parts)
