"""Glob patterns as regular expressions. A star never crosses a slash, and ``**`` means no more than ``*``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell pattern with ``*``, ``?``, ``[...]`` and backslash escapes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            negated = body.startswith("^")
            out.append("[" + ("^/" if negated else "") + re.sub(r"([\\\[&~|])", r"\\\1", body[negated:]) + "]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def matches(path: Column, pattern: str) -> Column:
    """Whole-path match; an empty pattern matches nothing but an empty path."""
    return path.rlike(glob_regex(pattern).replace("$", r"\z"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ignored(path: Column, patterns: list[str], double_star_retry: bool = True) -> Column:
    """Whether any pattern matches the path or its base name; with retry also after ``**`` became ``*``."""
    tests = []
    for p in patterns:
        for q in {p, p.replace("**", "*")} if double_star_retry and "**" in p else {p}:
            tests += [matches(path, q), matches(basename(path), q)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def markdown_event(path: Column, patterns: list[str]) -> Column:
    """Events worth handling: markdown files whose base name has no leading dot and that no pattern ignores."""
    name = basename(path)
    return ~name.startswith(".") & name.endswith(".md") & ~ignored(path, patterns, double_star_retry=False)
