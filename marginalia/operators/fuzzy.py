"""Fuzzy name matching: the candidates of each target by score, distance and path, without meeting all pairs.

Two indices give the pairs that may be within a distance ``d``. Names of up to ``SHORT`` characters meet by their deletion
neighbourhoods: two names within ``d`` edits, the longer one of ``m`` characters, have a common subsequence of ``m - d``, so each
name is held under ``m`` and what is left of it after deletions, and only for lengths ``m`` that a partner can have. Of longer
names one of ``d + 1`` stretches survives the edits near its place (``_sketch``).

The search widens distance by distance: a target that has found enough goes no further, so the wide and dear neighbourhoods are
made only for targets that still lack matches.

Joins are sort-merge joins at every size: a plan takes what a row explodes to for as large as the row, and would broadcast a
neighbourhood of hundreds of times that through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import matching, text
from ..scratch import Scratch

#: Longest names that meet by deletion neighbourhoods; at three deletions a name of twelve has 299 subsequences.
SHORT = 12


def candidates(state: DataFrame) -> DataFrame:
    return state.where(F.coalesce("page_id", F.lit("")) != "").select("note_path", "page_id", matching.match_key(text.note_name(F.col("note_path"))).alias("c_key"))


def keyed(targets: DataFrame, target: str) -> DataFrame:
    return targets.select(F.col(target).alias("target")).where("target is not null").distinct().withColumn("t_key", matching.match_key(text.note_name(F.col("target"))))


# names of up to SHORT characters


def _one_less(name: Column) -> Column:
    """The name less one character, wherever it stands; of nothing, nothing."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))


def _dealt(names: DataFrame, name: str) -> DataFrame:
    """Names over all tasks: a row makes hundreds, so even a table of one small file is worth dealing out."""
    return names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), name)


def neighbourhood(names: DataFrame, name: str, distance: int) -> DataFrame:
    """(name, n, m, left): what is left of each short name after the deletions that a longer partner of ``m`` characters leaves it."""
    step = _dealt(names.select(name, F.length(name).alias("n")).where(F.col("n") <= SHORT), name).withColumn("l0", F.array(name))
    for i in range(distance):
        step = step.withColumn(f"l{i + 1}", F.array_distinct(F.flatten(F.transform(f"l{i}", _one_less))))

    def grown(by: int) -> Column:
        return F.transform(f"l{distance - by}", lambda left: F.struct((F.col("n") + by).alias("m"), left.alias("left")))

    held = step.select(name, "n", F.explode(F.flatten(F.array(*map(grown, range(distance + 1))))).alias("k"))
    return held.where(F.col("k.m") <= SHORT).select(name, "n", "k.m", "k.left")


def _short_pairs(keys: DataFrame, held: DataFrame, distance: int) -> DataFrame:
    # Longs sort and move faster than strings; a hash that two have by chance adds a pair, whose distance is counted.
    met = F.xxhash64("m", "left").alias("met")
    asked = neighbourhood(keys, "t_key", distance).select("t_key", "m", met)
    held = neighbourhood(held, "c_key", distance).select("c_key", met)
    pairs = asked.join(held.hint("merge"), "met").where(F.col("m") == F.greatest(F.length("t_key"), F.length("c_key")))
    return pairs.select("t_key", "c_key")


# longer names


def _sketch(key: Column, distance: int) -> Column:
    """Keys that two names within ``distance`` edits share at least one of.

    A name is cut into distance + 1 stretches; an edit breaks one stretch at most, so one survives somewhere within
    ``distance`` places of where it stood.
    """
    parts = distance + 1
    n = F.length(key)
    out = []
    for i in range(parts):
        lo = F.floor(n * i / parts).cast("int")
        hi = F.floor(n * (i + 1) / parts).cast("int")
        out.append(F.concat_ws("|", F.lit(i), n, F.substr(key, lo + 1, hi - lo)))
    return F.array(*out)


def _probes(key: Column, distance: int) -> Column:
    """All keys a name must ask for: stretches of names up to ``distance`` longer or shorter, at the shifts that leave edits
    enough for both sides. With ``s`` the shift at the stretch and ``d`` the difference in length, the edits before it are
    |s| at least and those after it |d - s|. Only lengths of which one of the two names is long."""
    parts = distance + 1
    lengths = F.filter(F.sequence(F.length(key) - distance, F.length(key) + distance), lambda n: F.greatest(n, F.length(key)) > SHORT)

    def stretch(i: int, n: Column, lo: Column, size: Column) -> Callable[[Column], Column]:
        return lambda s: F.concat_ws("|", F.lit(i), n, F.substr(key, lo + s + 1, size))

    def of(n: Column) -> Column:
        differ = F.length(key) - n
        stretches = []
        for i in range(parts):
            lo = F.floor(n * i / parts).cast("int")
            size = F.floor(n * (i + 1) / parts).cast("int") - lo
            shifts = F.filter(F.sequence(F.lit(-distance), F.lit(distance)), _fits(lo, differ, distance))
            stretches.append(F.transform(shifts, stretch(i, n, lo, size)))
        return F.flatten(F.array(*stretches))

    return F.array_distinct(F.flatten(F.transform(lengths, of)))


def _fits(lo: Column, differ: Column, distance: int) -> Callable[[Column], Column]:
    return lambda s: (lo + s >= 0) & (F.abs(s) + F.abs(differ - s) <= distance)


def _long_pairs(keys: DataFrame, held: DataFrame, distance: int) -> DataFrame:
    near = SHORT - distance
    asked = _dealt(keys.where(F.length("t_key") > near), "t_key").select("t_key", F.explode(_probes(F.col("t_key"), distance)).alias("k")).select("t_key", F.xxhash64("k").alias("met"))
    held = held.where(F.length("c_key") > near).select("c_key", F.explode(F.array_distinct(_sketch(F.col("c_key"), distance))).alias("k")).select("c_key", F.xxhash64("k").alias("met"))
    return asked.join(held.hint("merge"), "met").select("t_key", "c_key")


def near_pairs(keys: DataFrame, held: DataFrame, distance: int) -> DataFrame:
    """Distinct (t_key, c_key) that may be within the distance, every pair that is among them; of distinct t_key and c_key."""
    keys = keys.where("t_key <> ''")
    return _short_pairs(keys, held, distance).unionByName(_long_pairs(keys, held, distance)).distinct()


# scores


def prefix_pairs(keys: DataFrame, cands: DataFrame) -> DataFrame:
    """Keys and those candidates' keys that they begin, themselves included."""
    begun = cands.select("c_key", F.explode(F.transform(F.sequence(F.lit(0), F.length("c_key")), lambda n: F.substr("c_key", F.lit(1), n))).alias("t_key")).distinct()
    return keys.join(begun.hint("merge"), "t_key").select("t_key", "c_key")


def first_of_prefix(keys: DataFrame, cands: DataFrame, k: int) -> DataFrame:
    """(t_key, c_key, note_path, page_id): the k candidates nearest in length, then path, of those that each key begins. Only k rows
    of a prefix leave a task."""
    ends = F.transform(F.sequence(F.lit(0), F.length("c_key")), lambda n: F.substr("c_key", F.lit(1), n))
    begun = cands.select("c_key", "note_path", "page_id", F.explode(ends).alias("t_key")).join(keys.hint("merge"), "t_key", "left_semi")
    nearest = Window.partitionBy("t_key").orderBy(F.octet_length("c_key"), "note_path")
    return begun.withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= k).drop("at")


def scored(pairs: DataFrame, distance: int) -> DataFrame:
    """(t_key, c_key, score, distance) of the pairs that match. Both sides are match keys, so equal ones are exact matches."""
    t, c = F.col("t_key"), F.col("c_key")
    prefix = c.startswith(t)
    edits = F.when(c == "", F.octet_length(t)).otherwise(F.levenshtein(t, c, distance))
    score = F.when(t == c, 4).when(prefix, 2).when((edits >= 0) & (edits <= distance), 1).otherwise(0)
    apart = F.when(t == c, 0).when(prefix, F.octet_length(c) - F.octet_length(t)).otherwise(edits)
    return pairs.withColumns({"score": score, "distance": apart}).where("score > 0")


def fuzzy_matches(targets: DataFrame, state: DataFrame, max_distance: int = 3, target: str = "target_name") -> DataFrame:
    """(target, note_path, page_id, score, distance) of every candidate with a score above 0.

    No pair is scored that shares no key: equal and prefix matches meet on prefixes of the candidates, near ones in the two
    indices. Names of at most max_distance characters are within it of each other, and meet.
    """
    names, cands = keyed(targets, target), candidates(state)
    keys, held = names.select("t_key").distinct(), cands.select("c_key").distinct()
    pairs = prefix_pairs(keys, held).unionByName(near_pairs(keys, held, max_distance)).distinct()
    return names.join(scored(pairs, max_distance).hint("merge"), "t_key").join(cands.hint("merge"), "c_key").select("target", "note_path", "page_id", "score", "distance")


def fuzzy_topk(targets: DataFrame, state: DataFrame, k: int = 3, max_distance: int = 3, target: str = "target_name", compared: list[int] | None = None) -> DataFrame:
    """(target, note_path, page_id, score, distance, rank): the k best candidates of each target by score, then distance, then path.

    Equal and prefix matches rank before all others and come from the prefixes, k a key. Keys with fewer go on to distance 1, those
    that still lack some to 2, and so on; each step is written, so that the next reads how many a key has. Of what a key finds at one
    distance the k first paths are kept, before the shuffle where a task has more. ``compared``: gets the number of pairs of
    keys whose edits were counted at each distance.
    """
    scratch = Scratch(state.sparkSession, "fuzzy")
    names, cands = scratch.save(keyed(targets, target), "names"), scratch.save(candidates(state), "candidates")
    keys, held = names.select("t_key").distinct(), cands.select("c_key").distinct()
    first = Window.partitionBy("t_key").orderBy("note_path")
    found = [scratch.save(scored(first_of_prefix(keys, cands, k), 0), "prefixes")]
    for distance in range(1, max_distance + 1):
        has = found[-1].groupBy("t_key").agg(F.count(F.lit(1)).alias("n"))
        if distance == 1:
            keys = keys.join(has.hint("merge"), "t_key", "left").select("t_key", F.coalesce("n", F.lit(0)).alias("n"))
        else:
            keys = keys.join(has.withColumnRenamed("n", "more").hint("merge"), "t_key", "left").select("t_key", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        keys = scratch.save(keys.where(F.col("n") < k), "open")
        if keys.isEmpty():
            break
        pairs = near_pairs(keys.select("t_key"), held, distance)
        if compared is not None:
            pairs = scratch.save(pairs, "pairs")
            compared.append(pairs.count())
        at = scored(pairs, distance).where((F.col("score") == 1) & (F.col("distance") == distance)).join(cands.hint("merge"), "c_key")
        at = at.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k).drop("at")
        found.append(scratch.save(at.select(*found[0].columns), "found"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = Window.partitionBy("t_key").orderBy(F.desc("score"), "distance", "note_path")
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return names.join(ranked.hint("merge"), "t_key").select("target", "note_path", "page_id", "score", "distance", "rank")
