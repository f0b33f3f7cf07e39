"""Content normalisation and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as trimmed at both ends of a content.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_space(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE_SPACE))


def normalise(content: Column) -> Column:
    """Line ends become LF, blanks at line ends go, three or more line feeds become two, the ends are trimmed."""
    lf = F.replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    bare = F.regexp_replace(lf, r"(?dm)[ \t]+$", "")
    return trim_space(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def fingerprint(content: Column) -> Column:
    """SHA-256 of the normalised content; nothing for nothing."""
    text = normalise(F.coalesce(content, F.lit("")))
    return F.when(text == "", "").otherwise(F.sha2(text, 256))


def raw_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def _after_open(content: Column) -> Column:
    return F.substr(content, F.lit(5))


def split_for_hash(content: Column) -> Column:
    """struct(frontmatter, body): the block between a first line ``---`` and the next such line, LF only; else all is body."""
    rest = _after_open(content)
    at = F.instr(rest, "\n---\n")
    opened = content.startswith("---\n")
    end = F.endswith(rest, F.lit("\n---"))
    fm = F.when(at > 0, F.substr(rest, F.lit(1), at - 1)).when(end, F.substr(rest, F.lit(1), F.length(rest) - 4))
    body = F.when(at > 0, F.substr(rest, at + 5)).when(end, F.lit(""))
    has = opened & ((at > 0) | end)
    return F.struct(F.when(has, fm).otherwise("").alias("frontmatter"), F.when(has, body).otherwise(content).alias("body"))


def hash_triple(content: Column) -> Column:
    """struct(content_hash, frontmatter_hash, full_hash); an empty part has an empty hash."""
    parts = split_for_hash(content)
    body, fm = normalise(parts["body"]), normalise(parts["frontmatter"])
    sha = lambda c: F.when(c == "", "").otherwise(F.sha2(c, 256))
    full = F.when(fm == "", body).otherwise(F.concat(fm, F.lit("\n"), body))
    return F.struct(sha(body).alias("content_hash"), sha(fm).alias("frontmatter_hash"), sha(full).alias("full_hash"))


def content_changed(new: Column, old: Column) -> Column:
    return F.coalesce(new["content_hash"], F.lit("")) != F.coalesce(old["content_hash"], F.lit(""))


def frontmatter_changed(new: Column, old: Column) -> Column:
    return F.coalesce(new["frontmatter_hash"], F.lit("")) != F.coalesce(old["frontmatter_hash"], F.lit(""))


def changed(new: Column, old: Column) -> Column:
    return content_changed(new, old) | frontmatter_changed(new, old)


def state_hashes(content_hash: Column, frontmatter_hash: Column) -> Column:
    """A state row's hashes: missing ones are empty, and the full hash always is."""
    return F.struct(F.coalesce(content_hash, F.lit("")).alias("content_hash"), F.coalesce(frontmatter_hash, F.lit("")).alias("frontmatter_hash"), F.lit("").alias("full_hash"))
