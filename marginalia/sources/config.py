"""Configuration: YAML over defaults, environment variables, validation, and what depends on a note's folder."""

from __future__ import annotations

import copy
import os
import re
from functools import reduce

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.globs import matches
from ..operators.properties import TYPE_ALIASES, TYPES

#: Fixed values.
STRATEGIES = ("manual", "ours", "theirs", "newer")
UNRESOLVED = ("placeholder", "text", "skip")
DELETIONS = {"remote": ("archive", "delete", "ignore"), "local": ("archive", "delete", "ignore")}
MAX_BATCH = 100
DEFAULTS = {
    "vault": "",
    "remote": {"token": "", "default_database": "", "default_page": ""},
    "mappings": [],
    "transform": {
        "queries": "placeholder",
        "unresolved_links": "placeholder",
        "callouts": {"note": "💡", "warning": "⚠️", "tip": "💡", "info": "ℹ️", "danger": "🔴", "example": "📝", "quote": "💬", "success": "✅", "failure": "❌", "bug": "🐛", "question": "❓"},
    },
    "sync": {"conflict_strategy": "manual", "ignore": ["templates/**", "**/.excalidraw.md"], "deletion": {"remote": "archive", "local": "archive"}},
    "rate_limit": {"requests_per_second": 3, "batch_size": 100, "workers": 4},
    "watch": {"debounce": "5s", "poll": "5m"},
}
_DURATION = re.compile(r"(\d+(?:\.\d+)?)(ms|h|m|s)")


def expand(value: object) -> object:
    """``${X}`` and ``$X`` in strings, from the environment; unknown ones are empty. A leading ``~`` is the home folder."""
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    if not isinstance(value, str):
        return value
    text = re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: os.environ.get(m[1] or m[2], ""), value)
    return os.path.expanduser(text) if text.startswith("~") else text


def _over(base: dict, top: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in top.items():
        out[k] = _over(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return expand(_over(DEFAULTS, yaml.safe_load(f) or {}))


def save(config: dict, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(config, f, allow_unicode=True, sort_keys=False)


def find(candidates: list[str]) -> str | None:
    """The first of the places that holds a file."""
    return next((p for p in map(os.path.expanduser, candidates) if os.path.isfile(p)), None)


def duration_seconds(text: str) -> float:
    """``500ms``, ``5s``, ``1h30m``, or ``0``."""
    if text in ("", "0"):
        return 0.0
    parts = _DURATION.findall(text)
    if "".join(a + b for a, b in parts) != text:
        raise ValueError(f"no duration: {text}")
    return sum(float(n) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[unit] for n, unit in parts)


def validate(config: dict) -> list[str]:
    """What is wrong with a configuration; nothing if it can be used."""
    wrong = []
    if not config["vault"]:
        wrong.append("vault is required")
    if not config["remote"]["token"]:
        wrong.append("remote.token is required")
    if not (config["remote"]["default_database"] or config["remote"]["default_page"] or config["mappings"]):
        wrong.append("a default database, a default page or a mapping is required")
    checks = [("sync.conflict_strategy", config["sync"]["conflict_strategy"], STRATEGIES), ("transform.unresolved_links", config["transform"]["unresolved_links"], UNRESOLVED), *((f"sync.deletion.{k}", config["sync"]["deletion"].get(k, "archive"), v) for k, v in DELETIONS.items())]
    wrong += [f"{name} must be one of {', '.join(allowed)}" for name, value, allowed in checks if value not in allowed]
    limits = config["rate_limit"]
    if not 0 < limits["batch_size"] <= MAX_BATCH:
        wrong.append(f"rate_limit.batch_size must be from 1 to {MAX_BATCH}")
    if limits["requests_per_second"] <= 0 or limits["workers"] <= 0:
        wrong.append("rate_limit values must be above 0")
    for name in ("debounce", "poll"):
        try:
            duration_seconds(config["watch"][name])
        except ValueError as e:
            wrong.append(f"watch.{name}: {e}")
    for i, m in enumerate(config["mappings"]):
        if not m.get("path"):
            wrong.append(f"mappings[{i}].path is required")
        wrong += [f"mappings[{i}]: property type {p.get('type')} is unknown" for p in m.get("properties", []) if p.get("type") not in {*TYPES, *TYPE_ALIASES}]
    return wrong


def folder_mapping(path: Column, mappings: list[dict]) -> Column:
    """Ordinal of the first mapping whose pattern the path matches, or null. A pattern is a glob, or a folder that holds the path."""
    rules = [(i, matches(path, m["path"]) | path.startswith(m["path"].rstrip("/*") + "/")) for i, m in enumerate(mappings)]
    return reduce(lambda otherwise, rule: F.when(rule[1], F.lit(rule[0])).otherwise(otherwise), reversed(rules), F.lit(None).cast("int"))


def database_of(path: Column, config: dict) -> Column:
    """The database a path goes to: its mapping's, else the default."""
    at = folder_mapping(path, config["mappings"])
    named = [F.when(at == i, F.lit(m["database"])) for i, m in enumerate(config["mappings"]) if m.get("database")]
    return F.coalesce(*named, F.lit(config["remote"]["default_database"] or None).cast("string"))


def merge_properties(folder: list[dict], defaults: list[dict]) -> list[dict]:
    """The folder's rules override defaults of the same key and follow them otherwise."""
    own = {p["key"]: p for p in folder}
    return [own.get(p["key"], p) for p in defaults] + [p for p in folder if p["key"] not in {d["key"] for d in defaults}]
