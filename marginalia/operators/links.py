"""The link graph: extraction, resolution by priority, backlinks, statistics and fuzzy repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.globs import basename
from ..scratch import Scratch
from .fuzzy import candidates, fuzzy_matches, fuzzy_topk

__all__ = ["candidates", "fuzzy_matches", "fuzzy_topk"]


def extract_links(notes: DataFrame, path: str = "path", body: str = "content") -> DataFrame:
    """An edge per link of a note: source_path, target, alias, heading, block, pos (order in the note)."""
    return notes.select(F.col(path).alias("source_path"), F.posexplode(text.links(F.col(body))).alias("pos", "l")).select("source_path", "pos", "l.*")


def extract_embeds(notes: DataFrame, path: str = "path", body: str = "content") -> DataFrame:
    """An edge per embed with its media flags and dimensions."""
    found = notes.select(F.col(path).alias("source_path"), F.posexplode(text.embeds(F.col(body))).alias("pos", "l")).select("source_path", "pos", "l.*")
    return found.select("*", text.embed_media(F.col("target")).alias("m"), text.dimensions(F.col("alias")).alias("d")).select("source_path", "pos", "target", "alias", "heading", "block", "m.*", "d.*")


def register(edges: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Link rows of new edges (source_path, target), one per pair; pairs already in ``links`` are left as they are."""
    new = edges.select("source_path", F.col("target").alias("target_name")).distinct()
    new = new.select("source_path", "target_name", F.lit(None).cast("string").alias("target_path"), F.lit(None).cast("string").alias("page_id"), F.lit(False).alias("resolved"))
    if links is None:
        return new
    return links.unionByName(new.join(links.select("source_path", "target_name"), ["source_path", "target_name"], "left_anti"))


def _targets(state: DataFrame) -> DataFrame:
    return state.where(F.col("page_id").isNotNull()).select("note_path", "page_id")


def _grams(text_: Column) -> Column:
    """All stretches of one to three characters."""
    size = F.length(text_)
    of = lambda q: F.when(size >= q, F.transform(F.sequence(F.lit(1), size - (q - 1)), lambda i: F.substr(text_, i, F.lit(q))))
    return F.flatten(F.array(*(F.coalesce(of(q), F.array().cast("array<string>")) for q in (1, 2, 3))))


def _rarest_gram_pairs(patterns: DataFrame, pages: DataFrame) -> DataFrame:
    """(target, norm, note_path, page_id): each pattern (target, norm) with the pages that hold the rarest of its literal stretches.

    A page that matches holds all of them. Only stretches of some pattern are taken from paths, and each pattern meets pages by one
    of its own; one that is all wildcards has but those that every path has, and matches them all.
    """
    literal = F.flatten(F.transform(F.split(F.lower(F.concat(F.lit("/"), "norm", F.lit(".md"))), "[%_]"), _grams))
    wanted = patterns.select("target", "norm", F.explode(F.array_distinct(literal)).alias("gram"))
    held = pages.select("note_path", "page_id", F.explode(F.array_distinct(_grams(F.lower("note_path")))).alias("gram"))
    held = held.join(wanted.select("gram").distinct().hint("merge"), "gram", "left_semi")
    counts = wanted.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
    rarest = counts.groupBy("target", "norm").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    return rarest.where("r.n > 0").select("target", "norm", F.col("r.gram").alias("gram")).join(held.hint("merge"), "gram").drop("gram")


def _wildcards(names: DataFrame, pages: DataFrame) -> DataFrame:
    """(target, note_path, page_id) of names (target, norm) with ``_`` or ``%`` and the paths whose end matches."""
    # ``_`` stands for one character, so what follows some slash of the path has the pattern's length, and begins as the pattern
    # does before its first wildcard (up to three letters are keys). Names with ``%`` meet pages by their rarest literal stretch.
    like = F.expr("note_path ilike concat('%/', replace(norm, '\\\\', '\\\\\\\\'), '.md')")
    any_length = F.contains("norm", F.lit("%"))
    head = F.least(F.instr("norm", F.lit("_")) - 1, F.lit(3))
    keys = names.where(F.contains("norm", F.lit("_")) & ~any_length).select("target", "norm", (F.length("norm") + 3).alias("size"), head.alias("n"), F.lower(F.substr("norm", F.lit(1), head)).alias("head"))
    parts = F.split("note_path", "/")
    tails = pages.withColumn("tail", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts) + 1), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/")))).where("tail <> ''")
    tails = tails.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({"size": F.length("tail"), "head": F.lower(F.substr("tail", F.lit(1), F.col("n")))})
    odd = keys.join(tails.hint("merge"), ["size", "n", "head"]).where(like).select("target", "note_path", "page_id")
    return odd.unionByName(_rarest_gram_pairs(names.where(any_length).select("target", "norm"), pages).where(like).select("target", "note_path", "page_id"))


def resolve(targets: DataFrame, state: DataFrame, aliases: DataFrame, target: str = "target_name") -> DataFrame:
    """(target, page_id, note_path) of each distinct target that resolves, by the first arm that finds a page, ties by path:

    1 the whole path, for targets with a slash; 2 the name: the path itself, or root ``name.md``, or any ``.../name.md`` (without
    regard to case, ``%`` and ``_`` standing for anything); 3 an alias equal to the raw target.

    The arms are equi-joins. The suffix arm joins on the lower-cased last path segment, then checks the whole; targets with
    wildcards are checked against the paths that share a length or a rare stretch with them, which is left out where no target has
    any. Distinct targets and pages are written once and read by all arms.
    """
    scratch = Scratch(targets.sparkSession, "resolve")
    names = targets.select(F.col(target).alias("target")).where("target is not null").distinct()
    names = scratch.save(names.withColumn("norm", text.normalise_target(F.col("target"))), "names")
    pages = scratch.save(_targets(state), "pages")
    # The whole path for targets with a slash is the first arm, the path itself or root ``name.md`` the second.
    whole = F.when(F.contains("target", F.lit("/")), 1).otherwise(2)
    direct = names.select("target", F.explode(F.array(F.struct(whole.alias("arm"), F.col("norm").alias("at")), F.struct(F.lit(2).alias("arm"), F.concat("norm", F.lit(".md")).alias("at")))).alias("k")).select("target", "k.*")
    direct = direct.join(pages.hint("merge"), F.col("at") == F.col("note_path")).select("target", "arm", "note_path", "page_id")
    wild = F.col("norm").rlike("[%_]")
    keyed = pages.withColumn("last", F.lower(basename(F.col("note_path"))))
    plain = names.where(~wild).withColumn("last", F.lower(F.concat(basename(F.col("norm")), F.lit(".md"))))
    nested = plain.join(keyed.hint("merge"), "last").where(F.lower("note_path").endswith(F.lower(F.concat(F.lit("/"), "norm", F.lit(".md"))))).select("target", F.lit(2).alias("arm"), "note_path", "page_id")
    odd = [] if names.where(wild).isEmpty() else [_wildcards(names, pages).select("target", F.lit(2).alias("arm"), "note_path", "page_id")]
    known = aliases.select("alias_name", "note_path").join(pages.hint("merge"), "note_path")
    named = names.join(known.hint("merge"), F.col("target") == F.col("alias_name")).select("target", F.lit(3).alias("arm"), "note_path", "page_id")
    found = reduce(DataFrame.unionByName, [direct, nested, *odd, named])
    best = found.groupBy("target").agg(F.min(F.struct("arm", "note_path", "page_id")).alias("b"))
    return best.select("target", "b.arm", "b.note_path", "b.page_id")


def resolve_all(links: DataFrame, state: DataFrame, aliases: DataFrame) -> DataFrame:
    """Links with unresolved ones resolved where a page is found: page id set, target path left as it is."""
    found = resolve(links.where(~F.col("resolved")), state, aliases).select(F.col("target").alias("target_name"), F.col("page_id").alias("new_page"))
    hit = ~F.col("resolved") & F.col("new_page").isNotNull()
    return links.join(found, "target_name", "left").select("source_path", "target_name", "target_path", F.when(hit, F.col("new_page")).otherwise(F.col("page_id")).alias("page_id"), (F.col("resolved") | hit).alias("resolved"))


def unresolved(links: DataFrame) -> DataFrame:
    return links.where(~F.col("resolved"))


def from_source(links: DataFrame, path: str) -> DataFrame:
    return links.where(F.col("source_path") == path)


def backlinks(links: DataFrame, paths: DataFrame) -> DataFrame:
    """(note_path, source_path, target_name): links to each path of ``paths`` by resolved path or by the note's name. The disjunction
    is a union of two equi-joins, each edge once."""
    wanted = paths.select(F.col("note_path"), text.note_name(F.col("note_path")).alias("name"))
    by_path = links.join(wanted, F.col("target_path") == F.col("note_path")).select("note_path", "source_path", "target_name")
    by_name = links.join(wanted, F.col("target_name") == F.col("name")).select("note_path", "source_path", "target_name")
    return by_path.unionByName(by_name).distinct()


def link_stats(links: DataFrame) -> DataFrame:
    return links.agg(F.count(F.lit(1)).alias("total"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"))


def unresolved_by_source(links: DataFrame) -> DataFrame:
    return unresolved(links).groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))


def any_resolved(links: DataFrame) -> DataFrame:
    """(source_path, any_resolved) with a page."""
    return links.groupBy("source_path").agg(F.bool_or(F.col("resolved") & (F.coalesce("page_id", F.lit("")) != "")).alias("any_resolved"))


def alias_lookup(aliases: DataFrame, state: DataFrame) -> DataFrame:
    """(alias_name, note_path, page_id): the first path by order of each alias that has a page."""
    found = aliases.select("alias_name", "note_path").join(_targets(state), "note_path")
    return found.groupBy("alias_name").agg(F.min(F.struct("note_path", "page_id")).alias("b")).select("alias_name", "b.note_path", "b.page_id")


def reverse_lookup(page_ids: DataFrame, state: DataFrame) -> DataFrame:
    return page_ids.select("page_id").join(state.select("page_id", "note_path"), "page_id").groupBy("page_id").agg(F.min("note_path").alias("note_path"))


# what fuzzy matches are for


def suggestions(links: DataFrame, state: DataFrame, k: int = 3) -> DataFrame:
    """(target, suggestions): paths, best first, of unresolved targets; targets without a match are left out."""
    best = fuzzy_topk(unresolved(links), state, k)
    return best.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "note_path"))), lambda x: x["note_path"]).alias("suggestions"))


def resolve_all_fuzzy(links: DataFrame, state: DataFrame, aliases: DataFrame) -> DataFrame:
    """Links with a ``how`` column (exact, fuzzy or null): unresolved ones by the page part of their target, else by the best fuzzy
    match, which also sets the target path."""
    open_ = unresolved(links).select("target_name", text.parse_target(F.col("target_name"))["page"].alias("page")).distinct()
    exact = resolve(open_, state, aliases, "page").select(F.col("target").alias("page"), F.col("page_id").alias("e_page"))
    missed = open_.join(exact, "page", "left_anti")
    fuzzy = fuzzy_topk(missed, state, 1, target="page").select(F.col("target").alias("page"), F.col("page_id").alias("f_page"), F.col("note_path").alias("f_path"))
    found = open_.join(exact, "page", "left").join(fuzzy, "page", "left").drop("page")
    rows = links.join(found, "target_name", "left")
    how = F.when(F.col("resolved"), None).when(F.col("e_page").isNotNull(), "exact").when(F.col("f_page").isNotNull(), "fuzzy")
    return rows.withColumn("how", how).select("source_path", "target_name", F.when(F.col("how") == "fuzzy", F.col("f_path")).otherwise(F.col("target_path")).alias("target_path"), F.coalesce(F.when(F.col("how") == "exact", F.col("e_page")).when(F.col("how") == "fuzzy", F.col("f_page")), F.col("page_id")).alias("page_id"), (F.col("resolved") | F.col("how").isNotNull()).alias("resolved"), "how")


def resolve_extended(targets: DataFrame, state: DataFrame, aliases: DataFrame, target: str = "target_name") -> DataFrame:
    """Per target its page, heading, block and where it leads: page_id, note_path, exact or fuzzy, and the distance."""
    parts = targets.select(F.col(target).alias("raw")).distinct().select("raw", text.parse_target(F.col("raw")).alias("p")).select("raw", "p.*")
    exact = resolve(parts, state, aliases, "page").select(F.col("target").alias("page"), F.col("page_id").alias("e_page"), F.col("note_path").alias("e_path"))
    missed = parts.join(exact, "page", "left_anti")
    fuzzy = fuzzy_topk(missed, state, 1, target="page").select(F.col("target").alias("page"), F.col("page_id").alias("f_page"), F.col("note_path").alias("f_path"), F.col("distance").alias("f_distance"))
    both = parts.join(exact, "page", "left").join(fuzzy, "page", "left")
    how = F.when(F.col("e_page").isNotNull(), "exact").when(F.col("f_page").isNotNull(), "fuzzy")
    return both.select(F.col("raw").alias("target"), "page", "heading", "block", F.coalesce("e_page", "f_page").alias("page_id"), F.coalesce("e_path", "f_path").alias("note_path"), how.alias("how"), F.when(how == "fuzzy", F.col("f_distance")).when(how == "exact", 0).alias("distance"))


def repair(links: DataFrame, state: DataFrame, dry_run: bool = True) -> DataFrame:
    """Best match of each unresolved link: what it would be, or was, repaired to."""
    best = fuzzy_topk(unresolved(links), state, 1).select(F.col("target").alias("target_name"), F.col("note_path").alias("new_path"), F.col("page_id").alias("new_page"), "score", "distance")
    return unresolved(links).join(best, "target_name").select("source_path", "target_name", "new_path", "new_page", "score", "distance", F.lit(not dry_run).alias("repaired"))
