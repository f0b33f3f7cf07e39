"""Links, embeds, query blocks and names inside notes, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .globs import basename

LINK = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
#: File extensions by kind of embed.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp", "svg", "webp", "avif", "tiff", "ico")
LINK_IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp", "svg", "webp")
AUDIO_EXTENSIONS = ("mp3", "wav", "ogg", "m4a", "flac", "aac", "wma", "webm")
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "wmv", "webm", "ogv")
#: Fences of query blocks.
QUERY_BLOCK = r"(?s)```dataview\n(.+?)\n```"
QUERY_JS = r"(?s)```dataviewjs\n(.+?)\n```"
QUERY_INLINE = r"`=([^`]+)`"


def _before_last(c: Column, ch: str) -> Column:
    return F.when(F.contains(c, F.lit(ch)), F.regexp_extract(c, rf"(?s)^(.*)\{ch}[^\{ch}]*$", 1)).otherwise(c)


def _after_last(c: Column, ch: str) -> Column:
    return F.when(F.contains(c, F.lit(ch)), F.regexp_extract(c, rf"(?s)\{ch}([^\{ch}]*)$", 1)).otherwise(F.lit(""))


def link_struct(target: Column, alias: Column) -> Column:
    """The last ``^`` begins the block, then the last ``#`` the heading."""
    page = _before_last(target, "^")
    return F.struct(_before_last(page, "#").alias("target"), alias.alias("alias"), _after_last(page, "#").alias("heading"), _after_last(target, "^").alias("block"))


def links(body: Column) -> Column:
    """All ``[[target|alias]]`` of a text, the insides of embeds included, in order."""
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(LINK), 1).alias("t"), F.regexp_extract_all(body, F.lit(LINK), 2).alias("a"))
    return F.transform(pairs, lambda x: link_struct(x["t"], F.coalesce(x["a"], F.lit(""))))


def embeds(body: Column) -> Column:
    """All ``![[target|alias]]`` of a text, in order."""
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit("!" + LINK), 1).alias("t"), F.regexp_extract_all(body, F.lit("!" + LINK), 2).alias("a"))
    return F.transform(pairs, lambda x: link_struct(x["t"], F.coalesce(x["a"], F.lit(""))))


def parse_link(raw: Column) -> Column:
    """A single ``[[...]]`` or ``![[...]]``; null if it is none. The last ``|`` begins the alias."""
    embed = raw.startswith("![[")
    inner = F.regexp_extract(raw, r"(?s)^!?\[\[(.*)\]\]$", 1)
    parts = link_struct(_before_last(inner, "|"), _after_last(inner, "|"))
    return F.when(raw.rlike(r"(?s)^!?\[\[.*\]\]$"), F.struct(parts["target"].alias("target"), parts["alias"].alias("alias"), parts["heading"].alias("heading"), parts["block"].alias("block"), embed.alias("is_embed")))


def strip_md(c: Column) -> Column:
    return F.regexp_replace(c, r"\.md\z", "")


def note_name(path: Column) -> Column:
    """Base name without ``.md``."""
    return strip_md(basename(path))


def display(target: Column, alias: Column) -> Column:
    return F.when(alias != "", alias).otherwise(note_name(target))


def format_link(target: Column, alias: Column, heading: Column, block: Column, is_embed: Column) -> Column:
    part = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")
    return F.concat(F.when(is_embed, "!").otherwise(""), F.lit("[["), target, part("#", heading), part("^", block), part("|", alias), F.lit("]]"))


def _extension(target: Column) -> Column:
    return F.lower(F.regexp_extract(basename(target), r"\.([^.]*)\z", 1))


def _ends_in(target: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(target).rlike(rf"\.({'|'.join(extensions)})\z")


def link_media(target: Column, is_embed: Column) -> Column:
    """struct(image, file, note) of a link: embeds of images, of other files, of notes."""
    ext = _extension(target)
    image = is_embed & ext.isin(*LINK_IMAGE_EXTENSIONS)
    dotted = F.contains(basename(target), F.lit("."))
    return F.struct(image.alias("image"), (is_embed & ~image & dotted).alias("file"), (is_embed & (~dotted | (basename(target).endswith(".md")))).alias("note"))


def embed_media(target: Column) -> Column:
    """struct(image, pdf, audio, video); ``.webm`` is audio and video."""
    return F.struct(_ends_in(target, IMAGE_EXTENSIONS).alias("image"), _ends_in(target, ("pdf",)).alias("pdf"), _ends_in(target, AUDIO_EXTENSIONS).alias("audio"), _ends_in(target, VIDEO_EXTENSIONS).alias("video"))


def dimensions(alias: Column) -> Column:
    """struct(width, height) of ``W`` or ``WxH``; what doesn't begin with digits is 0."""
    number = lambda c: F.coalesce(F.regexp_extract(c, r"^\s*(\d{1,9})", 1).try_cast("int"), F.lit(0))
    return F.struct(number(F.substring_index(alias, "x", 1)).alias("width"), F.when(F.contains(alias, F.lit("x")), number(F.regexp_extract(alias, r"x(.*)$", 1))).otherwise(0).alias("height"))


def sanitise_filename(name: Column) -> Column:
    """Nine characters that file systems refuse become ``-``; blanks, then dots go at the ends; nothing left: Untitled."""
    clean = F.regexp_replace(F.trim(F.translate(name, '/\\:*?"<>|', "---------")), r"^\.+|\.+\z", "")
    return F.when(clean == "", "Untitled").otherwise(clean)


def parse_target(target: Column) -> Column:
    """struct(page, heading, block): cut at the first ``^``, then at the first ``#``; the page loses ``.md``."""
    head = F.substring_index(target, "^", 1)
    block = F.when(F.contains(target, F.lit("^")), F.substr(target, F.length(head) + 2)).otherwise("")
    page = F.substring_index(head, "#", 1)
    heading = F.when(F.contains(head, F.lit("#")), F.substr(head, F.length(page) + 2)).otherwise("")
    return F.struct(strip_md(page).alias("page"), heading.alias("heading"), block.alias("block"))


def normalise_target(target: Column) -> Column:
    """``.md`` goes first, then what follows ``#``, then what follows ``^``; so ``A.md#H`` stays ``A.md``."""
    return F.substring_index(F.substring_index(strip_md(target), "#", 1), "^", 1)


def query_type(query: Column) -> Column:
    """By the first letters; none known: TABLE."""
    upper = F.upper(F.trim(query, F.lit(" \t\n\r\x0b\x0c")))
    return F.when(upper.startswith("LIST"), "LIST").when(upper.startswith("TASK"), "TASK").when(upper.startswith("CALENDAR"), "CALENDAR").otherwise("TABLE")


def queries(body: Column) -> Column:
    """Query blocks, then script blocks, then inline queries: array of struct(raw, type, inline)."""
    found = lambda regex, kind, inline: F.transform(F.regexp_extract_all(body, F.lit(regex), 1), lambda q: F.struct(q.alias("raw"), (kind(q) if callable(kind) else F.lit(kind)).alias("type"), F.lit(inline).alias("inline")))
    return F.concat(found(QUERY_BLOCK, query_type, False), found(QUERY_JS, "JS", False), found(QUERY_INLINE, "INLINE", True))


def _located(body: Column, regex: str) -> Column:
    """Matches of a pattern with one group, in order: array of struct(raw, start_pos, end_pos). Offsets are in bytes, from 0; a match
    begins after all pieces and matches before it."""
    whole = F.regexp_extract_all(body, F.lit(regex), 0)
    parts = F.arrays_zip(F.slice(F.split(body, regex, -1), F.lit(1), F.size(whole)).alias("before"), whole.alias("whole"), F.regexp_extract_all(body, F.lit(regex), 1).alias("raw"))
    none = F.array().cast("array<struct<raw:string,start_pos:int,end_pos:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.octet_length(x["before"])
        end = start + F.octet_length(x["whole"])
        found = F.struct(x["raw"].alias("raw"), start.alias("start_pos"), end.alias("end_pos"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(found)).alias("found"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def located_queries(body: Column) -> Column:
    """As ``queries``, with the byte offsets of each one's first and behind its last character, its fence or quotes included."""
    found = lambda regex, kind, inline: F.transform(_located(body, regex), lambda q: F.struct(q["raw"].alias("raw"), (kind(q["raw"]) if callable(kind) else F.lit(kind)).alias("type"), q["start_pos"].alias("start_pos"), q["end_pos"].alias("end_pos"), F.lit(inline).alias("inline")))
    return F.concat(found(QUERY_BLOCK, query_type, False), found(QUERY_JS, "JS", False), found(QUERY_INLINE, "INLINE", True))


def contains_query(body: Column) -> Column:
    return body.rlike(QUERY_BLOCK) | body.rlike(QUERY_INLINE) | body.rlike(QUERY_JS)


def query_placeholder(raw: Column, inline: Column) -> Column:
    """What stands for a query where it can't run."""
    callout = F.concat(F.lit("> [!info] Query\n> This query runs in the note editor only:\n> ```\n> "), F.replace(raw, F.lit("\n"), F.lit("\n> ")), F.lit("\n> ```\n"))
    return F.when(inline, F.concat(F.lit("[query: "), raw, F.lit("]"))).otherwise(callout)


def merge_tags(inline: Column, frontmatter: Column) -> Column:
    """Inline tags in order, then those of the frontmatter's list; repeats stay."""
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(inline, empty), F.coalesce(frontmatter, empty))


def database_title(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["content"]), "")


def is_uuid(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit("")).rlike(r"^[0-9a-fA-F]{32}\z")


def is_not_found(error: Column) -> Column:
    return F.contains(error, F.lit("not found")) | F.contains(error, F.lit("Could not find")) | F.contains(error, F.lit("404"))


def status_line(label: str, count: Column, noun: str = "note") -> Column:
    return F.format_string(f"  %-18s %4d {noun}%s", F.lit(label + ":"), count, F.when(count == 1, "").otherwise("s"))


def score_label(score: Column) -> Column:
    return F.when(score == 4, "exact").when(score == 3, "case-insensitive").when(score == 2, "prefix").when(score == 1, "fuzzy").otherwise("none")


def duration(seconds: Column) -> Column:
    """``250ms``, ``12.3s``, ``4m5s`` or ``2h7m``."""
    s = seconds.cast("double")
    whole = F.floor(s)
    short = F.when(s < 1, F.format_string("%dms", F.floor(s * 1000))).when(s < 60, F.format_string("%.1fs", s))
    return short.when(s < 3600, F.format_string("%dm%ds", F.floor(whole / 60), whole % 60)).otherwise(F.format_string("%dh%dm", F.floor(whole / 3600), F.floor(whole / 60) % 60))


def replace_links(body: Column, pages: Column) -> Column:
    """Links whose page ``pages`` (a map from target to new target) names point to its new target; alias, heading and block stay."""
    pieces = F.split(body, r"(?=\[\[)|(?<=\]\])")

    def piece(p: Column) -> Column:
        inner = F.regexp_extract(p, r"(?s)^\[\[([^\]|#^]+)", 1)
        new = F.element_at(pages, inner)
        return F.when(p.startswith("[[") & p.endswith("]]") & new.isNotNull(), F.concat(F.lit("[["), new, F.substr(p, F.length(inner) + 3))).otherwise(p)

    return F.array_join(F.transform(pieces, piece), "")
