"""Frontmatter of notes: splitting, YAML with recovery, typed access. Plain Python for the parser, expressions for access."""

from __future__ import annotations

import datetime
import json
import re

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 20


class FrontmatterError(ValueError):
    pass


class _Loader(yaml.SafeLoader):
    """YAML 1.2 booleans: only true and false; yes, no, on and off are strings."""


_Loader.yaml_implicit_resolvers = {k: [(tag, rx) for tag, rx in v if tag != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def split(content: str, lenient: bool = False) -> tuple[str | None, str]:
    """(block or None, body). A first line ``---`` opens, the next such line (or one at the very end) closes; LF or CRLF.

    Without a closing line the strict reading fails and the lenient one takes all as body.
    """
    first = re.match(r"---(\r?\n)", content)
    if not first:
        return None, content
    rest = content[first.end() :]
    if m := re.search(r"\r?\n---\r?\n", rest):
        return rest[: m.start()], rest[m.end() :]
    if m := re.match(r"---(?:\r?\n|\Z)", rest):
        return "", rest[m.end() :]
    if m := re.search(r"\r?\n---\Z", rest):
        return rest[: m.start()], ""
    if lenient:
        return None, content
    raise FrontmatterError("frontmatter isn't closed")


def split_public(content: str) -> tuple[str | None, str]:
    """The library's public variant: LF only, and an unclosed block is none."""
    if not content.startswith("---\n"):
        return None, content
    rest = content[4:]
    if rest.startswith("---\n") or rest == "---":
        return "", rest[4:]
    at = rest.find("\n---")
    if at < 0 or (len(rest) > at + 4 and rest[at + 4] != "\n"):
        return None, content
    return rest[:at], rest[at + 5 :]


def _depth(value: object, level: int = 1) -> int:
    if level > MAX_DEPTH + 2:
        return level
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return max((_depth(v, level + 1) for v in inner), default=level)


def recover(block: str) -> dict:
    """Line by line what can be had: ``key: value`` at the margin, with ``|`` and ``>`` texts; comments and list lines are left out."""
    out: dict[str, object] = {}
    lines = block.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i].rstrip("\r")
        i += 1
        m = re.match(r"([^\s#:\-][^:]*):(?:\s+(.*)|\s*)$", line)
        if not m:
            continue
        key, value = m[1].strip(), (m[2] or "").strip()
        if value in ("|", ">", "|-", ">-"):
            text = []
            while i < len(lines) and (lines[i].startswith((" ", "\t")) or not lines[i].strip()):
                text.append(lines[i].strip())
                i += 1
            out[key] = ("\n" if value[0] == "|" else " ").join(text).strip()
            continue
        try:
            parsed = yaml.load(value, _Loader) if value else ""
        except yaml.YAMLError:
            parsed = value.strip("\"'")
        out[key] = parsed if parsed is not None else ""
    return out


#: Lines of ``key: words`` and ``key: [words, words]`` where every word is a string in YAML too: they begin with a letter.
_WORDS = r"[A-Za-z][A-Za-z0-9]*(?:[ _/-][A-Za-z0-9]+)*"
_PLAIN = re.compile(rf"({_WORDS}): (?:({_WORDS})|\[({_WORDS}(?:, {_WORDS})*)\])(?:\n|\Z)")
_NO_STRING = {"true", "false", "null"}


def _plain_mapping(block: str) -> dict | None:
    """What YAML makes of a block of plain lines, at a hundredth of its time; None for any other block."""
    out: dict[str, object] = {}
    at = 0
    while at < len(block):
        m = _PLAIN.match(block, at)
        if not m or len(m[1]) > 100:
            return None
        value = m[2] or m[3].split(", ")
        if not _NO_STRING.isdisjoint(w.lower() for w in (m[1], *([value] if m[2] else value))):
            return None
        out[m[1]] = value
        at = m.end()
    return out


def parse(block: str | None, lenient: bool = False) -> dict:
    """The mapping; broken YAML fails, or leniently is recovered by lines. Deeper than 20 levels fails."""
    if not block or not block.strip():
        return {}
    if (plain := _plain_mapping(block)) is not None:
        return plain
    try:
        value = yaml.load(block, _Loader)
    except yaml.YAMLError as e:
        if lenient:
            return recover(block)
        raise FrontmatterError(f"invalid YAML: {e}") from e
    if value is None:
        return {}
    if not isinstance(value, dict):
        if lenient:
            return recover(block)
        raise FrontmatterError("frontmatter isn't a mapping")
    # The mapping itself is level 1 and its values, at depth 0, level 2.
    if _depth(value) > MAX_DEPTH + 2:
        raise FrontmatterError("frontmatter is nested too deeply")
    return value


def _plain(value: object) -> object:
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def to_json(mapping: dict) -> str:
    return json.dumps(_plain(mapping), ensure_ascii=False, sort_keys=True)


def serialise(mapping: dict, body: str = "") -> str:
    """``---`` block of sorted keys, indented by two, and the body."""
    if not mapping:
        return body
    return "---\n" + yaml.safe_dump(_plain(mapping), allow_unicode=True, indent=2, default_flow_style=False) + "---\n" + body


def merge(left: dict, right: dict) -> dict:
    """The right side wins."""
    return {**left, **right}


# typed access to frontmatter held as JSON


def variant(c: Column) -> Column:
    return F.try_parse_json(c)


def get_string(fm: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(fm, f"$.{key}", "string"), F.lit(""))


def get_list(fm: Column, key: str) -> Column:
    """A list's strings; a scalar is a list of one; a missing key an empty list."""
    many, one = F.try_variant_get(fm, f"$.{key}", "array<string>"), F.try_variant_get(fm, f"$.{key}", "string")
    return F.when(F.schema_of_variant(F.try_variant_get(fm, f"$.{key}", "variant")).startswith("ARRAY"), many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def get_int(fm: Column, key: str) -> Column:
    """Fractions are cut off; anything else than a number is 0."""
    kind = F.schema_of_variant(F.try_variant_get(fm, f"$.{key}", "variant"))
    return F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(fm, f"$.{key}", "double").cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def get_bool(fm: Column, key: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(fm, f"$.{key}", "variant"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(fm, f"$.{key}", "boolean")).otherwise(F.lit(False))


def get_time(fm: Column, key: str) -> Column:
    from .dates import parse_date

    return parse_date(F.try_variant_get(fm, f"$.{key}", "string"))


def title(fm: Column) -> Column:
    return get_string(fm, "title")


def has(fm: Column, key: str) -> Column:
    return F.try_variant_get(fm, f"$.{key}", "variant").isNotNull()


# frontmatter as a map of strings


def set_key(mapping: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(mapping, lambda k, _: k != key), F.create_map(F.lit(key), value))


def delete_key(mapping: Column, key: str) -> Column:
    return F.map_filter(mapping, lambda k, _: k != key)


def merge_maps(left: Column, right: Column) -> Column:
    """The right side wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)
