"""Typed properties of pages from frontmatter and back, by mapping rules.

Frontmatter is a map of strings (values as JSON would show them, lists as JSON arrays). A property is
struct(type, str, num, bool, date, list); a page's properties are a map from name to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date

#: Fixed values.
TYPES = ("title", "rich_text", "number", "select", "multi_select", "date", "checkbox", "url", "email", "phone_number")
TYPE_ALIASES = {"text": "rich_text", "tags": "multi_select", "bool": "checkbox", "phone": "phone_number"}
TRUE_STRINGS = ("true", "1", "yes")
PROPERTY = "struct<type:string,str:string,num:double,bool:boolean,date:timestamp,list:array<string>>"


@dataclass(frozen=True)
class Rule:
    """``transform`` may change the raw value first."""

    key: str
    name: str
    type: str
    transform: Callable[[Column], Column] | None = None


DEFAULT_RULES = (Rule("title", "Name", "title"), Rule("tags", "Tags", "multi_select"), Rule("status", "Status", "select"), Rule("date", "Date", "date"), Rule("url", "URL", "url"))


def type_of(name: str, aliases: bool = True) -> str:
    """The strict dialect knows the ten types; the configuration's also knows their short names. Others are rich text."""
    return name if name in TYPES else TYPE_ALIASES.get(name, "rich_text") if aliases else "rich_text"


def _property(kind: str, **value: Column) -> Column:
    kinds = {"str": "string", "num": "double", "bool": "boolean", "date": "timestamp", "list": "array<string>"}
    return F.struct(F.lit(kind).alias("type"), *(value.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))


def _list(raw: Column) -> Column:
    """A JSON array's strings; anything else is a list of one."""
    return F.when(raw.startswith("["), F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))).otherwise(F.array(raw))


def convert(raw: Column, kind: str) -> Column:
    """The property of a raw value; null (no property) for a date that no layout reads. What isn't a number is 0."""
    if kind == "number":
        return _property(kind, num=F.coalesce(raw.try_cast("double"), F.lit(0.0)))
    if kind == "multi_select":
        return _property(kind, list=_list(raw))
    if kind == "date":
        day = parse_date(raw)
        return F.when(day.isNotNull(), _property(kind, date=day))
    if kind == "checkbox":
        return _property(kind, bool=F.lower(raw).isin(*TRUE_STRINGS))
    return _property(kind, str=raw)


def to_properties(frontmatter: Column, tags: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """Properties by the rules whose key the frontmatter has. Without a ``tags`` key, inline tags stand in for it."""
    entries = []
    for rule in rules:
        raw = F.element_at(frontmatter, rule.key)
        if rule.key == "tags":
            raw = F.when(F.map_contains_key(frontmatter, "tags"), raw).when(F.size(tags) > 0, F.to_json(tags))
        if rule.transform:
            raw = rule.transform(raw)
        entries.append(F.struct(F.lit(rule.name).alias("key"), F.when(raw.isNotNull(), convert(raw, rule.type)).cast(PROPERTY).alias("value")))
    by_name = {r.name: e for r, e in zip(rules, entries, strict=True)}  # the last rule of a name wins
    return F.map_from_entries(F.filter(F.array(*by_name.values()), lambda e: e["value"].isNotNull()))


def _value(p: Column) -> Column:
    """A property as a frontmatter string; null if it is empty."""
    kind = p["type"]
    number = F.when(p["num"] == F.floor(p["num"]), p["num"].cast("bigint").cast("string")).otherwise(p["num"].cast("string"))
    return (
        F.when(kind == "number", number)
        .when(kind == "checkbox", p["bool"].cast("string"))
        .when(kind == "multi_select", F.when(F.size(p["list"]) > 0, F.to_json(p["list"])))
        .when(kind == "date", F.date_format(p["date"], "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.when(p["str"] != "", p["str"]))
    )


def to_frontmatter(properties: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """Mapped properties under their keys, the others under their names in lower case; empty ones are left out."""
    mapped = [F.struct(F.lit(r.key).alias("key"), _value(F.element_at(properties, r.name)).alias("value")) for r in rules]
    known = F.array(*(F.lit(r.name) for r in rules)) if rules else F.array().cast("array<string>")
    rest = F.transform(F.map_entries(F.map_filter(properties, lambda k, _: ~F.array_contains(known, k))), lambda e: F.struct(F.lower(e["key"]).alias("key"), _value(e["value"]).alias("value")))
    taken = F.array(*(F.lit(r.key) for r in rules)) if rules else F.array().cast("array<string>")
    rest = F.filter(rest, lambda e: ~F.array_contains(taken, e["key"]))
    return F.map_from_entries(F.filter(F.concat(F.array(*mapped), rest) if mapped else rest, lambda e: e["value"].isNotNull()))


def rule_join(frontmatter: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules as a table (key, name, type): (path, name, type, value) of each rule whose key a note's map ``fm`` has."""
    rows = frontmatter.select("path", F.explode("fm").alias("key", "value"))
    return rows.join(rules, "key").select("path", "name", "type", "value")


def sorted_keys(frontmatter: Column) -> Column:
    return F.array_sort(F.map_keys(frontmatter))


def render_frontmatter(frontmatter: Column, compat: bool = False) -> Column:
    """The block of sorted ``key: value`` lines. ``compat`` prints lists as ``[a b]`` and nothing quoted; else values are valid YAML."""

    def show(k: Column) -> Column:
        v = F.element_at(frontmatter, k)
        if compat:
            return F.when(v.startswith("["), F.concat(F.lit("["), F.array_join(F.from_json(v, "array<string>"), " "), F.lit("]"))).otherwise(v)
        plain = v.rlike(r"^[\p{L}\p{N}][\p{L}\p{N} _./-]*\z") | v.startswith("[")
        return F.when(plain, v).otherwise(F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))

    lines = F.transform(sorted_keys(frontmatter), lambda k: F.concat(k, F.lit(": "), show(k), F.lit("\n")))
    return F.when(F.size(lines) > 0, F.concat(F.lit("---\n"), F.array_join(lines, ""), F.lit("---\n\n"))).otherwise("")


def option_names(options: Column) -> Column:
    return F.transform(options, lambda o: o["name"])
