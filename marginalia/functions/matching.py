"""Fuzzy match scores: 4 exact, 3 but for case, 2 prefix, 1 within the edit distance, 0 none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_key(name: Column) -> Column:
    """Lower case; runs of anything but letters and decimal digits are one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}]+", " "))


def distance(a: Column, b: Column) -> Column:
    """Edit distance by code points; against nothing, the other side's bytes."""
    return F.when(a == "", F.octet_length(b)).when(b == "", F.octet_length(a)).otherwise(F.levenshtein(a, b))


def allowed(key: Column, max_distance: int) -> Column:
    """The limit; without one (0 or less) it follows the key's bytes."""
    if max_distance > 0:
        return F.lit(max_distance)
    return F.when(F.octet_length(key) <= 4, 1).when(F.octet_length(key) <= 8, 2).otherwise(3)


def match(target: Column, candidate: Column, max_distance: int = 3) -> Column:
    """struct(score, distance)."""
    t, c = match_key(target), match_key(candidate)
    prefix = c.startswith(t)
    d = distance(t, c)
    score = F.when(t == c, F.when(target == candidate, 4).otherwise(3)).when(prefix, 2).when(d <= allowed(t, max_distance), 1).otherwise(0)
    return F.struct(score.alias("score"), F.when(t == c, 0).when(prefix, F.octet_length(c) - F.octet_length(t)).otherwise(d).alias("distance"))
