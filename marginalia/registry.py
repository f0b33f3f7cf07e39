"""Registered queries of the notes engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as v
from .functions import globs, hashing, matching, text
from .operators import diff
from .operators import links as lk
from .operators import state as st
from .scratch import Scratch
from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query by its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _local(s: SparkSession, d: str) -> DataFrame:
    return diff.local_changes(v.note_hashes(s, d), v.sync_state(s, d))


def _all(s: SparkSession, d: str) -> DataFrame:
    return diff.all_changes(v.note_hashes(s, d), v.sync_state(s, d), v.remote_pages(s, d))


# hashing


@query(with_views("SELECT path AS note_path, body_hash AS content_hash, fm_hash AS frontmatter_hash, full_hash FROM hashes", "hashes"))
def content_hashes(s, d):
    return v.note_hashes(s, d).drop("mtime")


@query("SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_bodies(s, d):
    h = v.table(s, d, "documents").select("doc_id", hashing.raw_hash(F.col("text")).alias("text_hash"))
    return h.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


# diff


@query(with_views("SELECT path, old_path, type, direction, frontmatter_only FROM diff2", "diff2"))
def detect_local_changes(s, d):
    return _local(s, d).select("path", "old_path", "type", "direction", "frontmatter_only")


@query(with_views("SELECT type, count(*) AS n FROM diff2 GROUP BY type", "diff2"))
def change_counts_by_type(s, d):
    return diff.count_by(_local(s, d), "type")


@query(with_views("SELECT direction, count(*) AS n FROM diff3 GROUP BY direction", "diff3"))
def change_counts_by_direction(s, d):
    return diff.count_by(_all(s, d), "direction")


@query(with_views("SELECT path FROM diff2 WHERE frontmatter_only", "diff2"))
def frontmatter_only_changes(s, d):
    return _local(s, d).where("frontmatter_only").select("path")


@query(with_views("SELECT path, old_path FROM diff2 WHERE type = 'renamed'", "diff2"))
def renames(s, d):
    return diff.renames(v.note_hashes(s, d), v.sync_state(s, d)).select("path", "old_path")


@query(with_views("SELECT path FROM diff2 WHERE type = 'deleted'", "diff2"))
def deletions(s, d):
    return diff.by_type(_local(s, d), "deleted").select("path")


@query(with_views("SELECT note_path FROM state WHERE page_id <> '' AND status = 'synced' AND note_path NOT IN (SELECT path FROM hashes)", "state", "hashes"))
def deletion_candidates(s, d):
    return diff.vanished(v.note_hashes(s, d), v.sync_state(s, d)).select("note_path")


@query(with_views("SELECT path, old_path, type, direction FROM diff3", "diff3"))
def detect_all_changes(s, d):
    return _all(s, d).select("path", "old_path", "type", "direction")


@query(with_views("SELECT count(*) FILTER (type = 'conflict') > 0 AS has_conflicts FROM diff3", "diff3"))
def has_conflicts(s, d):
    return diff.has_conflicts(_all(s, d))


@query(with_views("SELECT path, type FROM diff3 WHERE direction = 'pull'", "diff3"))
def pull_direction(s, d):
    return diff.by_direction(_all(s, d), "pull").select("path", "type")


@query(with_views("SELECT s.note_path AS path, CASE WHEN s.status = 'conflict' THEN 'conflict' ELSE 'modified' END AS type FROM state s JOIN remote r ON r.page_id = s.page_id WHERE error IS NULL AND NOT archived AND last_edited > remote_mtime", "state", "remote"))
def remote_changes(s, d):
    return diff.remote_changes(v.sync_state(s, d), v.remote_pages(s, d)).select("path", "type")


_PULL = """SELECT path, page_id, action FROM (SELECT s.note_path AS path, s.page_id, CASE WHEN r.page_id IS NULL OR archived OR coalesce(error LIKE '%not found%', false) THEN 'delete'
    WHEN error IS NULL AND {edited} THEN 'pull' END AS action FROM state s LEFT JOIN remote r ON r.page_id = s.page_id WHERE s.page_id <> '') WHERE action IS NOT NULL"""


@query(with_views(_PULL.format(edited="last_edited > remote_mtime"), "state", "remote"))
def pull_candidates(s, d):
    return diff.pull_candidates(v.sync_state(s, d), v.remote_pages(s, d))


@query(with_views(_PULL.format(edited="true"), "state", "remote"))
def pull_all(s, d):
    return diff.pull_candidates(v.sync_state(s, d), v.remote_pages(s, d), pull_all=True)


@query(with_views("SELECT path, type FROM diff2 UNION ALL SELECT note_path, CASE WHEN coalesce(page_id, '') = '' THEN 'created' ELSE 'modified' END FROM state WHERE status = 'pending' AND note_path NOT IN (SELECT path FROM diff2)", "diff2", "state"))
def push_candidates(s, d):
    return diff.push_candidates(v.note_hashes(s, d), v.sync_state(s, d))


@query(with_views("SELECT path, CASE WHEN coalesce(page_id, '') = '' THEN 'created' ELSE 'modified' END AS type FROM hashes LEFT JOIN state ON path = note_path", "hashes", "state"))
def push_all(s, d):
    return diff.push_candidates(v.note_hashes(s, d), v.sync_state(s, d), push_all=True)


_PLAN = "SELECT path, type, CASE WHEN type = 'conflict' THEN {settled} ELSE direction END AS action FROM diff3"


@query(with_views(_PLAN.format(settled="CASE WHEN local_mtime > remote_mtime THEN 'push' ELSE 'pull' END"), "diff3"))
def sync_plan_newer(s, d):
    return diff.sync_plan(v.note_hashes(s, d), v.sync_state(s, d), v.remote_pages(s, d), "newer")


@query(with_views(_PLAN.format(settled="'push'"), "diff3"))
def sync_plan_ours(s, d):
    return diff.sync_plan(v.note_hashes(s, d), v.sync_state(s, d), v.remote_pages(s, d), "ours")


@query(with_views(_PLAN.format(settled="'pull'"), "diff3"))
def sync_plan_theirs(s, d):
    return diff.sync_plan(v.note_hashes(s, d), v.sync_state(s, d), v.remote_pages(s, d), "theirs")


@query(with_views(_PLAN.format(settled="'conflict'"), "diff3"))
def sync_plan_manual(s, d):
    return diff.sync_plan(v.note_hashes(s, d), v.sync_state(s, d), v.remote_pages(s, d), "manual")


@query(with_views("SELECT s.note_path AS path, CASE WHEN body_hash <> content_hash THEN CASE WHEN mtime > last_edited THEN 'keep' ELSE 'pull' END ELSE 'pull' END AS action FROM state s JOIN remote r ON r.page_id = s.page_id LEFT JOIN hashes h ON h.path = s.note_path WHERE error IS NULL AND NOT archived AND last_edited > remote_mtime", "state", "remote", "hashes"))
def poll_conflicts_newer(s, d):
    return diff.poll_conflicts(v.note_hashes(s, d), v.sync_state(s, d), v.remote_pages(s, d), "newer")


@query(with_views("""SELECT r.page_id, coalesce(nullif(title, ''), 'Untitled') AS title,
    coalesce(nullif(regexp_replace(trim(translate(coalesce(nullif(title, ''), 'Untitled'), '/:*?"<>|\\', '---------'), ' '), '^[.]+|[.]+$', '', 'g'), ''), 'Untitled') || '.md' AS path FROM remote r WHERE page_id NOT IN (SELECT page_id FROM state WHERE page_id <> '')""", "remote", "state"))
def discover_untracked(s, d):
    return diff.discover_untracked(v.sync_state(s, d), v.remote_pages(s, d))


@query(with_views("SELECT i.page_id, CASE WHEN r.page_id IS NULL THEN 'page not found: ' || i.page_id ELSE error END AS error FROM (SELECT DISTINCT page_id FROM state WHERE page_id <> '') i LEFT JOIN remote r ON r.page_id = i.page_id WHERE r.page_id IS NULL OR error IS NOT NULL", "state", "remote"))
def missing_pages(s, d):
    from .sources.remote import batch_metadata

    ids = v.sync_state(s, d).where("page_id <> ''").select("page_id").distinct()
    return batch_metadata(ids, v.remote_pages(s, d)).where("error is not null").select("page_id", "error")


@query(with_views("""SELECT CAST((SELECT count(*) FROM diff3 WHERE type = 'created') + (SELECT count(*) FROM state WHERE status = 'pending') AS BIGINT) AS new,
    (SELECT count(*) FROM diff3 WHERE type = 'modified' AND direction = 'push') AS modified, (SELECT count(*) FROM diff3 WHERE type = 'modified' AND direction = 'pull') AS to_pull,
    (SELECT count(*) FROM diff3 WHERE type = 'deleted') AS deleted, (SELECT count(*) FROM diff3 WHERE type = 'renamed') AS renamed, (SELECT count(*) FROM diff3 WHERE type = 'conflict') AS conflicts,
    (SELECT count(*) FROM state WHERE status = 'synced') AS synced, (SELECT count(*) FROM state WHERE status = 'pending') AS pending, (SELECT count(*) FROM link) AS links,
    (SELECT count(*) FROM link JOIN resolved ON target = target_name) AS resolved_links, (SELECT count(*) FROM link LEFT JOIN resolved ON target = target_name WHERE target IS NULL) AS unresolved_links""", "diff3", "state", "link", "resolved"))
def status_summary(s, d):
    resolved = _resolved(s, d)
    return diff.status_summary(_all(s, d), v.sync_state(s, d), resolved)


# links


def _resolved(s: SparkSession, d: str) -> DataFrame:
    links = Scratch(s, "links").save(_links(s, d), "links")
    return lk.resolve_all(links, v.sync_state(s, d), v.aliases(s, d))


def _links(s: SparkSession, d: str) -> DataFrame:
    """Links of the notes by the page their target names."""
    edges = lk.extract_links(v.notes(s, d)).withColumn("target", text.parse_target(F.col("target"))["page"])
    return lk.register(edges)


@query(with_views("SELECT source_path, CAST(pos AS BIGINT) AS pos, target, alias, heading FROM edge", "edge"))
def extract_links(s, d):
    return lk.extract_links(v.notes(s, d)).select("source_path", F.col("pos").cast("bigint").alias("pos"), "target", "alias", "heading")


@query(with_views("""SELECT path AS source_path, 'img-' || (doc_id // 3) || ['.png', '.pdf', '.mp3', '.webm', '.mkv', ''][doc_id % 6 + 1] AS target, doc_id % 6 = 0 AS image, doc_id % 6 = 1 AS pdf, doc_id % 6 IN (2, 3) AS audio, doc_id % 6 IN (3, 4) AS video,
    [100, 0, 50, 7, 0, 12][doc_id % 6 + 1]::BIGINT AS width, [200, 0, 0, 9, 0, 0][doc_id % 6 + 1]::BIGINT AS height FROM notes""", "notes"))
def extract_embeds(s, d):
    """Embeds of six kinds, with both dimensions, one, none, or an alias that is none."""
    ends = F.array(*map(F.lit, (".png|100x200", ".pdf", ".mp3|50", ".webm|7x9", ".mkv|wide", "|12x")))
    notes = v.notes(s, d).select("path", F.replace("content", F.lit(".png|100x200"), F.element_at(ends, (F.col("doc_id") % 6 + 1).cast("int"))).alias("content"))
    return lk.extract_embeds(notes).select("source_path", "target", "image", "pdf", "audio", "video", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"))


@query(r"""SELECT page_id, regexp_extract(h, '^[^#^]*') AS page, CASE WHEN contains(h, '#') THEN regexp_extract(h, '^[^#]*#([^^]*)', 1) ELSE '' END AS heading FROM (SELECT page_id, regexp_extract(url, '//[^/]*/(.*)$', 1) AS h FROM pages)""")
def link_parts(s, d):
    path = F.regexp_extract("url", "//[^/]*/(.*)$", 1)
    return v.table(s, d, "pages").select("page_id", text.parse_target(path).alias("p")).select("page_id", "p.page", "p.heading")


@query(with_views("SELECT source_path, target_name, page_id, target IS NOT NULL AS resolved FROM link LEFT JOIN resolved ON target = target_name", "link", "resolved"))
def resolve_links(s, d):
    return _resolved(s, d).select("source_path", "target_name", "page_id", "resolved")


@query(with_views("SELECT target, CAST(arm AS BIGINT) AS arm, note_path, page_id FROM resolved", "resolved"))
def resolution_arms(s, d):
    found = lk.resolve(_links(s, d), v.sync_state(s, d), v.aliases(s, d))
    return found.select("target", F.col("arm").cast("bigint").alias("arm"), "note_path", "page_id")


@query(with_views("SELECT source_path, target_name FROM link WHERE target_name NOT IN (SELECT target FROM resolved)", "link", "resolved"))
def unresolved_links(s, d):
    return lk.unresolved(_resolved(s, d)).select("source_path", "target_name")


@query(with_views("SELECT DISTINCT s.note_path, source_path, target_name FROM state s JOIN link ON target_name = regexp_replace(regexp_extract(note_path, '[^/]*$'), '[.]md$', '')", "state", "link"))
def backlinks(s, d):
    return lk.backlinks(_links(s, d), v.sync_state(s, d))


@query(with_views("SELECT count(*) AS total, count(target) AS resolved, count(*) - count(target) AS unresolved FROM link LEFT JOIN resolved ON target = target_name", "link", "resolved"))
def link_stats(s, d):
    return lk.link_stats(_resolved(s, d))


@query(with_views("SELECT source_path, count(*) AS n FROM link WHERE target_name NOT IN (SELECT target FROM resolved) GROUP BY source_path", "link", "resolved"))
def unresolved_by_source(s, d):
    return lk.unresolved_by_source(_resolved(s, d))


@query(with_views("SELECT source_path, count(target) > 0 AS any_resolved FROM link LEFT JOIN resolved ON target = target_name GROUP BY source_path", "link", "resolved"))
def newly_resolved_sources(s, d):
    return lk.any_resolved(_resolved(s, d))


@query(with_views("SELECT alias_name, note_path, page_id FROM alias JOIN page USING (note_path)", "alias", "page"))
def alias_lookup(s, d):
    return lk.alias_lookup(v.aliases(s, d), v.sync_state(s, d))


@query(with_views("SELECT page_id, min(note_path) AS note_path FROM remote JOIN state USING (page_id) GROUP BY page_id", "remote", "state"))
def reverse_lookup(s, d):
    return lk.reverse_lookup(v.remote_pages(s, d), v.sync_state(s, d))


@query("SELECT regexp_extract(href, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS links, count(DISTINCT page_id) AS sources FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1")
def html_link_degree(s, d):
    hrefs = v.table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))
    return hrefs.groupBy(F.regexp_extract("href", "^[a-z]+://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("links"), F.countDistinct("page_id").alias("sources"))


@query(with_views("SELECT target, note_path, page_id, CAST(score AS BIGINT) AS score, CAST(distance AS BIGINT) AS distance, rank FROM topk WHERE rank <= 3", "topk"))
def fuzzy_topk(s, d):
    best = lk.fuzzy_topk(_links(s, d), v.sync_state(s, d), 3)
    return best.select("target", "note_path", "page_id", F.col("score").cast("bigint").alias("score"), F.col("distance").cast("bigint").alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query(with_views("SELECT source_path, target_name, note_path AS new_path FROM link JOIN topk ON target = target_name WHERE rank = 1 AND target_name NOT IN (SELECT target FROM resolved)", "link", "topk", "resolved"))
def repair_links(s, d):
    return lk.repair(_resolved(s, d), v.sync_state(s, d)).select("source_path", "target_name", "new_path")


@query(with_views("SELECT target, string_agg(note_path, ',' ORDER BY rank) AS suggestions FROM topk WHERE rank <= 3 AND target NOT IN (SELECT target FROM resolved) GROUP BY target", "topk", "resolved"))
def link_suggestions(s, d):
    return lk.suggestions(_resolved(s, d), v.sync_state(s, d), 3).select("target", F.array_join("suggestions", ",").alias("suggestions"))


@query(with_views("SELECT CASE WHEN r.target IS NOT NULL THEN 'exact' WHEN k.target IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS how, count(*) AS n FROM link LEFT JOIN resolved r ON r.target = target_name LEFT JOIN (SELECT target FROM topk WHERE rank = 1) k ON k.target = target_name GROUP BY 1", "link", "resolved", "topk"))
def resolve_all_fuzzy_counts(s, d):
    found = lk.resolve_all_fuzzy(_links(s, d), v.sync_state(s, d), v.aliases(s, d))
    return found.groupBy(F.coalesce("how", F.lit("none")).alias("how")).agg(F.count(F.lit(1)).alias("n"))


@query(with_views("SELECT t.target, coalesce(r.note_path, k.note_path) AS note_path, CASE WHEN r.target IS NOT NULL THEN 'exact' WHEN k.target IS NOT NULL THEN 'fuzzy' END AS how FROM (SELECT DISTINCT target FROM edge) t LEFT JOIN resolved r USING (target) LEFT JOIN (SELECT target, note_path FROM topk WHERE rank = 1) k USING (target)", "edge", "resolved", "topk"))
def resolve_extended(s, d):
    return lk.resolve_extended(_links(s, d), v.sync_state(s, d), v.aliases(s, d)).select("target", "note_path", "how")


@query("SELECT r_name, n_name, levenshtein(lower(r_name), lower(n_name)) AS distance FROM region, nation WHERE levenshtein(lower(r_name), lower(n_name)) <= 6")
def name_distances(s, d):
    r, n = v.table(s, d, "region"), v.table(s, d, "nation")
    dist = matching.distance(F.lower("r_name"), F.lower("n_name"))
    # 5 regions and 25 nations: both sides are fixed by the schema.
    return n.join(F.broadcast(r), dist <= 6).select("r_name", "n_name", dist.cast("bigint").alias("distance"))


# state and history


@query(with_views("SELECT note_path, status FROM state WHERE status = 'conflict'", "state"))
def conflicts(s, d):
    return st.conflicts(v.sync_state(s, d)).select("note_path", "status")


@query(with_views("SELECT note_path, details FROM (SELECT *, row_number() OVER (PARTITION BY note_path ORDER BY ts DESC, seq DESC) AS k FROM history WHERE action = 'click') WHERE k = 1", "history"))
def latest_action(s, d):
    return st.latest_conflict(v.history(s, d), "click").select("note_path", "details")


@query(with_views("SELECT seq, note_path, action FROM history ORDER BY ts DESC, seq DESC LIMIT 50", "history"))
def history_topn(s, d):
    return st.recent_history(v.history(s, d), 50).select("seq", "note_path", "action")


@query(with_views("SELECT action, count(*) AS n FROM history WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 10 DAY GROUP BY action", "history"))
def history_retention(s, d):
    kept = st.retain_history(v.history(s, d), F.lit("2024-01-30").cast("timestamp_ntz"), F.expr("interval 10 days"))
    return diff.count_by(kept, "action")


@query(with_views("SELECT count(*) AS removed FROM history WHERE ts < TIMESTAMP '2024-01-30' - INTERVAL 10 DAY", "history"))
def history_expired(s, d):
    return st.expired_count(v.history(s, d), F.lit("2024-01-30").cast("timestamp_ntz"), F.expr("interval 10 days"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, -1, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def upsert_latest_order(s, d):
    base = v.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(-1).cast("bigint").alias("o_orderkey"), F.lit("none").alias("o_orderstatus"), F.lit("1970-01-01").cast("timestamp_ntz").alias("o_orderdate"))
    rows = v.table(s, d, "orders").select(*base.columns).withColumn("version", F.struct("o_orderdate", "o_orderkey"))
    return st.upsert_latest(base, rows, ["o_custkey"], "version").drop("o_orderdate")


@query(with_views("SELECT note_path, CASE WHEN note_path LIKE 'src1/%' THEN 'updated' ELSE status END AS status FROM state", "state"))
def upsert_state(s, d):
    state = v.sync_state(s, d)
    new = state.where(F.col("note_path").startswith("src1/")).withColumn("status", F.lit("updated"))
    return st.upsert(state, new, ["note_path"]).select("note_path", "status")


@query(with_views("SELECT note_path FROM state WHERE note_path NOT LIKE 'gone/%'", "state"))
def delete_state(s, d):
    state = v.sync_state(s, d)
    return st.delete(state, state.where(F.col("note_path").startswith("gone/")), ["note_path"]).select("note_path")


@query(with_views("SELECT source_path, target_name FROM link", "link"))
def insert_ignore_links(s, d):
    links = _links(s, d)
    half = links.where(F.pmod(F.xxhash64("source_path"), F.lit(2)) == 0)
    return st.insert_ignore(half, links.unionByName(links), ["source_path", "target_name"]).select("source_path", "target_name")


@query(with_views("SELECT coalesce(path, source_path) AS source_path, target_name FROM link LEFT JOIN (SELECT path, old_path FROM diff2 WHERE type = 'renamed') ON old_path = source_path", "link", "diff2"))
def rename_links(s, d):
    moves = diff.renames(v.note_hashes(s, d), v.sync_state(s, d)).select("old_path", F.col("path").alias("new_path"))
    return st.rename_paths(_links(s, d), moves, "source_path").select("source_path", "target_name")


@query(with_views("SELECT path, type FROM diff2 UNION ALL SELECT path, action FROM (" + _PULL.format(edited="last_edited > remote_mtime") + ")", "diff2", "state", "remote"))
def union_changes(s, d):
    pulls = diff.pull_candidates(v.sync_state(s, d), v.remote_pages(s, d)).select("path", F.col("action").alias("type"))
    return _local(s, d).select("path", "type").unionByName(pulls)


@query(with_views("SELECT path, CASE direction WHEN 'push' THEN 'archive_page' ELSE 'move_note' END AS action, CASE direction WHEN 'pull' THEN '_archive/' || regexp_extract(path, '[^/]*$') END AS \"to\" FROM diff3 WHERE type = 'deleted'", "diff3"))
def deletion_plan(s, d):
    return st.deletion_plan(_all(s, d)).select("path", "action", "to")


@query(with_views("SELECT path, 'conflict' AS type FROM diff3 WHERE type = 'conflict' UNION SELECT s.note_path, 'conflict' FROM state s JOIN remote r ON r.page_id = s.page_id WHERE s.status = 'conflict' AND error IS NULL AND NOT archived AND last_edited > remote_mtime", "diff3", "state", "remote"))
def merge_conflicts(s, d):
    return diff.merge_conflicts(_all(s, d), diff.remote_changes(v.sync_state(s, d), v.remote_pages(s, d))).select("path", "type")


# filters


@query(with_views("SELECT path FROM notes WHERE NOT (path LIKE 'src1/%' OR regexp_matches(path, '/en-[^/]*[.]md$') OR regexp_matches(path, '^src2[^/]*/de[^/]*$'))", "notes"))
def ignore_filter(s, d):
    return v.notes(s, d).where(~globs.ignored(F.col("path"), ["src1/**", "en-*.md", "src2*/de*"])).select("path")


@query(with_views("SELECT path FROM notes WHERE regexp_matches(path, '^src1[^/]/[^/]*-[0-9]*5[.]md$')", "notes"))
def glob_filter(s, d):
    return v.notes(s, d).where(globs.matches(F.col("path"), "src1?/*-*5.md")).select("path")


@query("SELECT part.p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')) AS match_key FROM part")
def match_keys(s, d):
    return v.table(s, d, "part").select("p_partkey", F.lower(matching.match_key(F.col("p_name"))).alias("match_key"))


# properties, queries, rich text, blocks


@query("""SELECT o_orderkey, coalesce(CAST(EXTRACT(year FROM d) AS BIGINT), 0) AS y, coalesce(CAST(EXTRACT(month FROM d) AS BIGINT), 0) AS m, coalesce(CAST(EXTRACT(day FROM d) AS BIGINT), 0) AS day FROM (
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_orderdate END AS d FROM orders)""")
def parse_dates(s, d):
    from .functions.dates import parse_date

    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    shown = F.when(k % 5 == 0, F.date_format(t, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(t, "MM/dd/yyyy")).when(k % 5 == 2, F.date_format(t, "MMMM d, yyyy")).when(k % 5 == 3, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(t, "M-d-yy"))
    day = v.table(s, d, "orders").select("o_orderkey", parse_date(shown).alias("d"))
    part = lambda f, n: F.coalesce(f("d").cast("bigint"), F.lit(0)).alias(n)
    return day.select("o_orderkey", part(F.year, "y"), part(F.month, "m"), part(F.dayofmonth, "day"))


@query("""SELECT p_partkey, p_name AS title, CASE WHEN p_size > 0 THEN CAST(p_size AS DOUBLE) ELSE 0 END AS size, p_size % 2 = 0 AS even, p_brand || ',' || p_type AS tags FROM part""")
def map_properties(s, d):
    from .operators import properties as p

    rules = (p.Rule("name", "Name", "title"), p.Rule("size", "Size", "number"), p.Rule("even", "Even", "checkbox"), p.Rule("tags", "Tags", "multi_select"), p.Rule("none", "None", "url"))
    fm = F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"), F.lit("even"), F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("no"))
    out = v.table(s, d, "part").select("p_partkey", p.to_properties(fm, F.array("p_brand", "p_type"), rules).alias("p"))
    get = lambda name, field: F.element_at("p", name)[field]
    return out.select("p_partkey", get("Name", "str").alias("title"), get("Size", "num").alias("size"), get("Even", "bool").alias("even"), F.array_join(get("Tags", "list"), ",").alias("tags"))


@query("""SELECT p_partkey, p_name AS name, p_brand AS brand, 'Brand,Name' AS keys FROM part""")
def properties_round_trip(s, d):
    from .operators import properties as p

    rules = (p.Rule("name", "Name", "title"), p.Rule("brand", "Brand", "select"))
    fm = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    props = v.table(s, d, "part").select("p_partkey", fm.alias("fm"), p.to_properties(fm, F.array().cast("array<string>"), rules).alias("p"))
    back = props.select("p_partkey", "fm", "p", p.to_frontmatter(F.col("p"), rules).alias("back"))
    return back.select("p_partkey", F.col("back")["name"].alias("name"), F.col("back")["brand"].alias("brand"), F.array_join(p.sorted_keys(F.col("p")), ",").alias("keys"))


@query("""SELECT item_id, CAST(n AS BIGINT) AS n, CASE item_id % 5 WHEN 1 THEN 'LIST' WHEN 2 THEN 'TASK' WHEN 3 THEN 'CALENDAR' ELSE 'TABLE' END AS first_type, 'JS' AS second_type, 'INLINE' AS last_type FROM (SELECT item_id, 3 AS n FROM benchmark)""")
def query_types(s, d):
    word = F.element_at(F.array(*map(F.lit, ("table", " list", "Task", "calendar", "select"))), (F.col("item_id") % 5 + 1).cast("int"))
    body = F.concat(F.lit("text `=this.file` more\n```dataviewjs\ndv.pages()\n```\n```dataview\n"), word, F.lit(" a\nfrom b\n```\n"))
    q = v.table(s, d, "benchmark").select("item_id", text.queries(body).alias("q"))
    return q.select("item_id", F.size("q").cast("bigint").alias("n"), F.col("q")[0]["type"].alias("first_type"), F.col("q")[1]["type"].alias("second_type"), F.col("q")[2]["type"].alias("last_type"))


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '**' || t || '**' WHEN 1 THEN '<u>~~`' || t || '`~~</u>' WHEN 2 THEN '[***==' || t || '==***](http://x/' || turn || ')' WHEN 3 THEN '[[' || t || ']]' ELSE '$' || t || '$' END || '!' AS md
    FROM (SELECT conv_id, turn, text AS t FROM conversations)""")
def rich_text_markdown(s, d):
    from .functions.richtext import markdown

    k = F.col("turn") % 5
    flag = lambda c, n: c.alias(n)
    first = F.struct(F.when(k == 3, "mention").when(k == 4, "equation").otherwise("text").alias("type"), F.col("text").alias("content"), F.when(k == 2, F.concat(F.lit("http://x/"), "turn")).alias("link"), F.lit("none").alias("page_id"), flag(k.isin(0, 2), "bold"), flag(k == 2, "italic"), flag(k == 1, "strike"), flag(k == 1, "underline"), flag(k == 1, "code"), F.when(k == 2, "yellow_background").alias("color"))
    null = F.lit(None).cast("string")
    last = F.struct(F.lit("text").alias("type"), F.lit("!").alias("content"), null.alias("link"), null.alias("page_id"), *(F.lit(False).alias(n) for n in ("bold", "italic", "strike", "underline", "code")), null.alias("color"))
    return v.table(s, d, "conversations").select("conv_id", "turn", markdown(F.array(first, last)).alias("md"))


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 3 AS batch_pos FROM conversations")
def block_batches(s, d):
    from .sources.remote import append_batches

    blocks = v.table(s, d, "conversations").select(F.col("conv_id").alias("page_key"), "turn", F.array(F.col("turn").cast("int")).alias("block_path"), F.lit(0).alias("depth"))
    return append_batches(blocks, 3).select(F.col("page_key").alias("conv_id"), "turn", "batch", "batch_pos")


_EMBEDS = "SELECT c_custkey AS source, (c_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS target FROM customer"


@query(f"""WITH RECURSIVE e AS ({_EMBEDS}), w AS (SELECT source AS root, target, 1 AS depth, [source, target] AS trail, source = target AS cycle FROM e
    UNION ALL SELECT root, e.target, depth + 1, list_append(trail, e.target), list_contains(trail, e.target) FROM w JOIN e ON e.source = w.target WHERE NOT cycle AND depth < 10)
    SELECT root, target, CAST(depth AS BIGINT) AS depth, cycle FROM w""")
def embed_closure(s, d):
    from .operators.embeds import embed_closure as closure

    customers = v.table(s, d, "customer")
    edges = customers.select(F.col("c_custkey").alias("source"), ((F.col("c_custkey") * 7 + 3) % customers.count()).alias("target"), F.lit(False).alias("media"))
    return closure(edges).select("root", "target", F.col("depth").cast("bigint").alias("depth"), "cycle")


@query("""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g""")
def debounce_sessions(s, d):
    from .streaming.events import debounce

    events = v.table(s, d, "events").select("user_id", "ts", F.col("event_type").alias("op"))
    return debounce(events, "30 minutes", "user_id").drop("op")


@query(with_views("SELECT path, CASE WHEN path LIKE 'src1/%' THEN 'one' WHEN regexp_matches(path, '^src2[^/]*/fr-[^/]*$') THEN 'french' ELSE 'default' END AS database FROM notes", "notes"))
def folder_mapping(s, d):
    from .sources.config import DEFAULTS, database_of

    config = DEFAULTS | {"remote": {"default_database": "default"}, "mappings": [{"path": "src1", "database": "one"}, {"path": "src2*/fr-*", "database": "french"}, {"path": "src1/*", "database": "late"}]}
    return v.notes(s, d).select("path", database_of(F.col("path"), config).alias("database"))


@query("SELECT item_id, '[!info]' AS head FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, '[query:' FROM benchmark WHERE item_id % 2 = 1")
def query_placeholders(s, d):
    shown = text.query_placeholder(F.concat(F.lit("list "), "item_id"), F.col("item_id") % 2 == 1)
    return v.table(s, d, "benchmark").select("item_id", F.regexp_extract(shown, r"(\[!info\]|\[query:)", 1).alias("head"))


@query()
def note_blocks(s, d):
    from .operators import blocks, extract

    parsed = extract.parse_notes(v.notes(s, d))
    return blocks.note_blocks(parsed).groupBy("type", "depth").agg(F.count(F.lit(1)).alias("n"))


@query()
def blocks_to_markdown(s, d):
    from .operators import blocks, extract

    raw = blocks.note_blocks(extract.parse_notes(v.notes(s, d)))
    found = lk.resolve(_links(s, d), v.sync_state(s, d), v.aliases(s, d))
    return blocks.blocks_markdown(blocks.render_links(raw, found), v.sync_state(s, d))


@query(with_views("SELECT path, 'Doc ' || doc_id AS title, lang || ',' || source AS tags, CAST(2 AS BIGINT) AS n_links, CAST(1 AS BIGINT) AS n_embeds FROM notes", "notes"))
def parse_notes(s, d):
    from .functions import frontmatter as fm
    from .operators import extract

    parsed = extract.parse_notes(v.notes(s, d))
    return parsed.select("path", fm.title(F.col("frontmatter")).alias("title"), F.array_join(fm.get_list(F.col("frontmatter"), "tags"), ",").alias("tags"), F.size("links").cast("bigint").alias("n_links"), F.size("embeds").cast("bigint").alias("n_embeds"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 1 THEN CAST(n_nationkey * 10 AS VARCHAR) END AS result, CASE WHEN n_nationkey % 2 = 0 THEN 'even' END AS error FROM nation")
def parallel_map(s, d):
    from .plans.runtime import parallel_map as run

    def ten(x):
        if x % 2 == 0:
            raise ValueError("even")
        return str(x * 10)

    return run(v.table(s, d, "nation").select("n_nationkey"), ten, "n_nationkey")


@query(with_views("SELECT path, replace(replace('[[' || lang || '-1|a]] [[Doc#H^b]] ![[x]]', '[[' || lang || '-1|', '[[one|'), '[[Doc#', '[[Title#') AS body FROM notes", "notes"))
def replace_links(s, d):
    lang = F.regexp_extract("path", "/([a-z]+)-", 1)
    body = F.concat(F.lit("[["), lang, F.lit("-1|a]] [[Doc#H^b]] ![[x]]"))
    names = F.create_map(F.concat(lang, F.lit("-1")), F.lit("one"), F.lit("Doc"), F.lit("Title"))
    return v.notes(s, d).select("path", text.replace_links(body, names).alias("body"))


@query("SELECT n_name, n_name AS target, 'a' || n_nationkey AS alias, CASE WHEN n_nationkey % 2 = 0 THEN 'H' ELSE '' END AS heading, n_nationkey % 3 = 0 AS is_embed FROM nation")
def parse_links(s, d):
    k = F.col("n_nationkey")
    raw = F.concat(F.when(k % 3 == 0, "!").otherwise(""), F.lit("[["), "n_name", F.when(k % 2 == 0, "#H").otherwise(""), F.lit("|a"), k, F.lit("]]"))
    return v.table(s, d, "nation").select("n_name", text.parse_link(raw).alias("p")).select("n_name", "p.target", "p.alias", "p.heading", "p.is_embed")


@query("SELECT n_name, '[[' || n_name || '#H|' || r_name || ']]' AS link, r_name AS shown FROM nation JOIN region ON n_regionkey = r_regionkey")
def format_links(s, d):
    joined = v.table(s, d, "nation").join(F.broadcast(v.table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", text.format_link(F.col("n_name"), F.col("r_name"), F.lit("H"), F.lit(""), F.lit(False)).alias("link"), text.display(F.col("n_name"), F.col("r_name")).alias("shown"))


@query("SELECT p_partkey, 'Name' AS name, 'title' AS type, p_name AS value FROM part UNION ALL SELECT p_partkey, 'Brand', 'select', p_brand FROM part")
def mapping_rules(s, d):
    from .operators.properties import rule_join

    fm = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("other"), F.lit("x"))
    rules = s.createDataFrame([("name", "Name", "title"), ("brand", "Brand", "select"), ("gone", "Gone", "url")], "key string, name string, type string")
    found = rule_join(v.table(s, d, "part").select(F.col("p_partkey").alias("path"), fm.alias("fm")), rules)
    return found.select(F.col("path").alias("p_partkey"), "name", "type", "value")


@query(with_views("SELECT page_id, title FROM remote WHERE contains(lower(title), 'title 1')", "remote"))
def search_pages(s, d):
    from .sources.remote import search

    return search(v.remote_pages(s, d), "Title 1").select("page_id", "title")


@query(with_views("SELECT page_id, archived OR page_id IN (SELECT page_id FROM state WHERE status = 'conflict' AND page_id IS NOT NULL) AS archived FROM remote", "remote", "state"))
def archive_pages(s, d):
    from .sources.remote import archive

    return archive(v.remote_pages(s, d), st.conflicts(v.sync_state(s, d)).where("page_id is not null")).select("page_id", "archived")


@query(with_views("SELECT page_id, coalesce(max('Renamed ' || s.note_path), max(title)) AS title FROM remote LEFT JOIN (SELECT page_id, note_path FROM state WHERE status = 'pending') s USING (page_id) GROUP BY page_id", "remote", "state"))
def update_titles(s, d):
    from .sources.remote import update_titles as update

    new = st.lookup(v.sync_state(s, d), "status", "pending").where("page_id is not null").select("page_id", F.concat(F.lit("Renamed "), "note_path").alias("title"))
    return update(v.remote_pages(s, d), new).select("page_id", "title")


@query("SELECT conv_id, count(*) AS blocks, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def full_pages(s, d):
    from .sources.remote import full_pages as pages

    rows = v.table(s, d, "conversations")
    blocks = rows.select(F.col("conv_id").alias("page_key"), F.array(F.col("turn").cast("int")).alias("block_path"), F.lit(0).alias("depth"), F.col("role").alias("type"), F.lit(None).cast("map<string,string>").alias("attrs"), F.lit(None).cast("string").alias("rich_text"))
    found = pages(rows.select(F.col("conv_id").alias("page_key")).distinct(), blocks.drop("attrs").withColumn("attrs", F.lit("")))
    return found.select(F.col("page_key").alias("conv_id"), F.size("blocks").cast("bigint").alias("blocks"), F.array_join(F.transform("blocks", lambda b: b["type"]), ",").alias("roles"))


@query("SELECT event_id, props FROM events WHERE false UNION ALL SELECT event_id, upper(event_type) || ':' || CAST(event_id % 7 AS VARCHAR) FROM events")
def frontmatter_values(s, d):
    from .functions import frontmatter as fm

    j = fm.variant(F.concat(F.lit('{"kind": "'), F.upper("event_type"), F.lit('", "n": '), F.col("event_id") % 7, F.lit(".5}")))
    typed = v.table(s, d, "events").select("event_id", j.alias("j"))
    return typed.select("event_id", F.concat(fm.get_string(F.col("j"), "kind"), F.lit(":"), fm.get_int(F.col("j"), "n")).alias("props"))


@query("SELECT c_custkey, 'b,c' AS keys, c_mktsegment AS c FROM customer")
def frontmatter_maps(s, d):
    from .functions import frontmatter as fm
    from .operators.properties import sorted_keys

    base = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    merged = fm.merge_maps(fm.delete_key(fm.set_key(base, "b", F.lit("3")), "a"), F.create_map(F.lit("c"), F.col("c_mktsegment")))
    return v.table(s, d, "customer").select("c_custkey", F.array_join(sorted_keys(merged), ",").alias("keys"), merged["c"].alias("c"))


from . import registry_more  # noqa: E402, F401
