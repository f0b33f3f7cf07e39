"""Further registered queries: text and hash functions, state tables, remote requests, plans, and notes as blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from . import views as v
from .functions import globs, hashing, text
from .operators import diff
from .operators import links as lk
from .operators import state as st
from .registry import _all, _links, _local, _resolved, query
from .views import with_views

NOW = "timestamp '2024-01-10 00:00:00'"


def _at():
    return F.expr(NOW)


# functions


@query("SELECT c_custkey, split_part(split_part(regexp_replace(raw, '[.]md$', ''), '#', 1), '^', 1) AS page FROM (SELECT c_custkey, c_name || CASE c_custkey % 5 WHEN 0 THEN '.md' WHEN 1 THEN '#Part' WHEN 2 THEN '^b1' WHEN 3 THEN '.md#Part' ELSE '#Part^b1' END AS raw FROM customer)")
def normalise_targets(s, d):
    end = F.element_at(F.array(*map(F.lit, (".md", "#Part", "^b1", ".md#Part", "#Part^b1"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return v.table(s, d, "customer").select("c_custkey", text.normalise_target(F.concat("c_name", end)).alias("page"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(c_mktsegment) || ',same,' END || 'same,n' || c_nationkey AS tags FROM customer")
def merge_tags(s, d):
    inline = F.when(F.col("c_custkey") % 3 != 0, F.array(F.lower("c_mktsegment"), F.lit("same")))
    return v.table(s, d, "customer").select("c_custkey", F.array_join(text.merge_tags(inline, F.array(F.lit("same"), F.concat(F.lit("n"), "c_nationkey"))), ",").alias("tags"))


@query(with_views("SELECT path, body_hash <> content_hash AS content, fm_hash <> frontmatter_hash AS frontmatter, body_hash <> content_hash OR fm_hash <> frontmatter_hash AS any FROM hashes JOIN state ON path = note_path", "hashes", "state"))
def changed_predicates(s, d):
    now = v.note_hashes(s, d).select("note_path", F.struct("content_hash", "frontmatter_hash").alias("new"))
    both = now.join(v.sync_state(s, d).select("note_path", hashing.state_hashes(F.col("content_hash"), F.col("frontmatter_hash")).alias("old")), "note_path")
    new, old = F.col("new"), F.col("old")
    return both.select(F.col("note_path").alias("path"), hashing.content_changed(new, old).alias("content"), hashing.frontmatter_changed(new, old).alias("frontmatter"), hashing.changed(new, old).alias("any"))


@query("SELECT p_partkey, regexp_full_match(replace(raw, '-', ''), '[0-9a-fA-F]{32}') AS is_uuid, p_brand || p_type AS title FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN md5(p_name) WHEN 1 THEN left(md5(p_name), 8) || '-' || substr(md5(p_name), 9) WHEN 2 THEN substr(md5(p_name), 2) ELSE p_name END AS raw FROM part)")
def titles_and_ids(s, d):
    k, h = F.col("p_partkey") % 4, F.md5(F.col("p_name"))
    raw = F.when(k == 0, h).when(k == 1, F.concat(F.left(h, F.lit(8)), F.lit("-"), F.substr(h, F.lit(9)))).when(k == 2, F.substr(h, F.lit(2))).otherwise(F.col("p_name"))
    runs = F.array(F.struct(F.col("p_brand").alias("content")), F.struct(F.col("p_type").alias("content")))
    return v.table(s, d, "part").select("p_partkey", text.is_uuid(raw).alias("is_uuid"), text.database_title(runs).alias("title"))


@query("SELECT event_id, e LIKE '%not found%' OR e LIKE '%Could not find%' OR e LIKE '%404%' AS missing FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'page not found: ' WHEN 1 THEN 'Could not find ' WHEN 2 THEN 'status ' ELSE 'Not Found ' END || event_id AS e FROM events)")
def not_found_errors(s, d):
    kind = F.element_at(F.array(*map(F.lit, ("page not found: ", "Could not find ", "status ", "Not Found "))), (F.col("event_id") % 4 + 1).cast("int"))
    return v.table(s, d, "events").select("event_id", text.is_not_found(F.concat(kind, "event_id")).alias("missing"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN 'exact' WHEN 3 THEN 'case-insensitive' WHEN 2 THEN 'prefix' WHEN 1 THEN 'fuzzy' ELSE 'none' END AS label,
    printf('  %-18s %4d note%s', 'Orders:', o_orderkey % 3, CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE 's' END) AS line,
    CASE WHEN x < 1 THEN printf('%dms', CAST(x * 1000 AS BIGINT)) WHEN x < 60 THEN printf('%.1fs', x) WHEN x < 3600 THEN printf('%dm%ds', CAST(floor(floor(x) / 60) AS BIGINT), CAST(floor(x) AS BIGINT) % 60) ELSE printf('%dh%dm', CAST(floor(floor(x) / 3600) AS BIGINT), CAST(floor(floor(x) / 60) AS BIGINT) % 60) END AS took
    FROM (SELECT o_orderkey, (o_orderkey % 17000) / 2.0 AS x FROM orders)""")
def labels_and_durations(s, d):
    k = F.col("o_orderkey")
    return v.table(s, d, "orders").select("o_orderkey", text.score_label(k % 5).alias("label"), text.status_line("Orders", k % 3).alias("line"), text.duration((k % 17000) / 2.0).alias("took"))


@query(with_views("SELECT p AS path FROM (SELECT CASE doc_id % 4 WHEN 0 THEN regexp_replace(path, '/', '/.') WHEN 1 THEN path || '.txt' ELSE path END AS p FROM notes) WHERE p LIKE '%.md' AND p NOT LIKE '%/.%' AND NOT regexp_matches(p, '^src1/[^/]*$') AND NOT regexp_matches(p, '(^|/)fr-1[^/]*$')", "notes"))
def watched_paths(s, d):
    from .streaming.events import wanted

    k = F.col("doc_id") % 4
    path = F.when(k == 0, F.regexp_replace("path", "/", "/.")).when(k == 1, F.concat("path", F.lit(".txt"))).otherwise(F.col("path"))
    return wanted(v.notes(s, d).select(path.alias("path")), ["src1/*", "fr-1*"])


@query(with_views("SELECT path, length(text) - length(replace(text, chr(10), '')) + 3 AS line, 'alias' AS alias, 'Part' AS heading FROM notes", "notes"))
def link_lines(s, d):
    from .operators import extract

    at = F.element_at(F.filter("links", lambda e: e["heading"] == "Part"), 1)
    return extract.note_edges(v.notes(s, d)).select("path", at["line"].cast("bigint").alias("line"), at["alias"].alias("alias"), at["heading"].alias("heading"))


@query(with_views("""SELECT path, unnest([{'kind': 'link', 'target': 'before ' || doc_id, 'line': 1}, {'kind': 'link', 'target': 'behind ' || doc_id, 'line': n + CASE doc_id % 3 WHEN 0 THEN 9 WHEN 1 THEN 7 ELSE 4 END},
    {'kind': 'embed', 'target': 'img-' || doc_id || '.png', 'line': n + CASE doc_id % 3 WHEN 0 THEN 9 WHEN 1 THEN 7 ELSE 4 END}, {'kind': 'tag', 'target': 'seen/' || lang, 'line': NULL}], recursive := true)
    FROM (SELECT *, length(text) - length(replace(text, chr(10), '')) AS n FROM notes)""", "notes"))
def edges_behind_code(s, d):
    """Links, embeds and tags in front of the text and behind code of three kinds, none of those in the code. A fence of four marks holds one of
    three, one of tildes one of backticks, and code in a line has a mark of its own inside; all go behind the note's whole text."""
    from .operators import extract

    k, doc = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    body = F.regexp_replace("content", r"(?s)\A---\n.*?\n---\n(.*)\n\nSee \[\[[^\n]*\n\z", "$1")
    hidden = F.concat(F.lit("[[hidden "), doc, F.lit("]] ![[hidden.png]] #hidden"))
    code = F.when(k == 0, F.concat(F.lit("````sql\n"), hidden, F.lit("\n```\n\n````"))).when(k == 1, F.concat(F.lit("~~~\n"), hidden, F.lit(" ```\n~~~"))).otherwise(F.concat(F.lit("`` ` "), hidden, F.lit(" ``")))
    behind = F.concat(F.when(k == 2, " ").otherwise("\n"), F.lit("[[behind "), doc, F.lit("|x]] ![["), F.lit("img-"), doc, F.lit(".png|10]] #seen/"), F.regexp_extract("path", "/([a-z]+)-", 1))
    content = F.concat(F.lit("---\na: [\n---\n[[before "), doc, F.lit("#h^b]]\n"), body, F.lit("\n\n"), code, behind, F.lit("\n"))
    found = extract.note_edges(v.notes(s, d).select("path", content.alias("content")))
    edge = lambda kind: lambda e: F.struct(F.lit(kind).alias("kind"), e["target"].alias("target"), e["line"].alias("line"))
    tag = lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("target"), F.lit(None).cast("int").alias("line"))
    return found.select("path", F.explode(F.concat(F.transform("links", edge("link")), F.transform("embeds", edge("embed")), F.transform("tags", tag))).alias("e")).select("path", "e.*")


@query(with_views("SELECT path, sha256(body) AS body_hash, doc_id % 3 = 1 AS failed FROM (SELECT doc_id, path, CASE doc_id % 3 WHEN 0 THEN body WHEN 1 THEN '---' || chr(10) || 'title: [' || chr(10) || '---' || chr(10) || body ELSE body END AS body FROM notes)", "notes"))
def split_frontmatter(s, d):
    """Notes with readable frontmatter, with broken frontmatter (an error, the content stays whole) and without."""
    from .operators import extract

    k = F.col("doc_id") % 3
    body = F.substring_index("content", "\n---\n", -1)
    body = F.substr("content", F.instr("content", F.lit("]\n---\n")) + 6)
    content = F.when(k == 0, F.col("content")).when(k == 1, F.concat(F.lit("---\ntitle: [\n---\n"), body)).otherwise(body)
    parsed = extract.parse_notes(v.notes(s, d).select("path", content.alias("content")))
    return parsed.select("path", F.sha2("body", 256).alias("body_hash"), F.col("error").isNotNull().alias("failed"))


@query(with_views("SELECT path, 'T' || doc_id AS title, lang AS kind FROM notes", "notes"))
def recovered_frontmatter(s, d):
    """Frontmatter that YAML refuses, read line by line."""
    from .functions import frontmatter as fm
    from .operators import extract

    lang = F.regexp_extract("path", "/([a-z]+)-", 1)
    content = F.concat(F.lit("---\ntitle: T"), "doc_id", F.lit("\nbad: [\nkind: "), lang, F.lit("\n---\nbody\n"))
    parsed = extract.parse_notes(v.notes(s, d).select("path", content.alias("content")), lenient=True)
    return parsed.select("path", fm.get_string(F.col("frontmatter"), "title").alias("title"), fm.get_string(F.col("frontmatter"), "kind").alias("kind"))


@query("SELECT n_nationkey, (n_nationkey + 9) - 1 > 20 AS failed FROM nation")
def frontmatter_depth(s, d):
    """Lists in lists: the outermost is at depth 0, and beyond depth 20 they are an error."""
    from .operators import extract

    levels = (F.col("n_nationkey") + 9).cast("int")
    content = F.concat(F.lit("---\na: "), F.repeat(F.lit("["), levels), F.repeat(F.lit("]"), levels), F.lit("\n---\nx\n"))
    parsed = extract.parse_notes(v.table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"), content.alias("content")))
    return parsed.select(F.col("path").cast("int").alias("n_nationkey"), F.col("error").isNotNull().alias("failed"))


# state


@query(with_views("SELECT note_path, page_id FROM state WHERE status = 'pending'", "state"))
def pending_by_status(s, d):
    return st.by_status(v.sync_state(s, d), "pending").select("note_path", "page_id")


@query(with_views("SELECT max(status = 'conflict') AS has_conflict FROM state WHERE note_path = (SELECT min(note_path) FROM state WHERE status = 'conflict') UNION ALL SELECT coalesce(max(status = 'conflict'), false) FROM state WHERE note_path = 'old/26.md'", "state"))
def conflict_flags(s, d):
    state = v.sync_state(s, d)
    first = st.conflicts(state).agg(F.min("note_path").alias("p")).first()["p"]
    return st.has_conflict(state, first or "").unionByName(st.has_conflict(state, "old/26.md"))


@query("SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 'region' FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)")
def upsert_config(s, d):
    nation, region = v.table(s, d, "nation"), v.table(s, d, "region")
    settings = nation.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    new = nation.where("n_nationkey % 2 = 0").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("r_name").alias("value"))
    return st.upsert(settings, new.unionByName(region.select(F.col("r_name").alias("key"), F.lit("region").alias("value"))), ["key"])


@query(with_views("SELECT path AS note_path, 'Doc ' || doc_id AS alias_name, CASE WHEN doc_id % 3 = 0 THEN 'alias' ELSE 'title' END AS alias_type FROM notes UNION ALL SELECT path, 'Also ' || doc_id, 'alias' FROM notes WHERE doc_id % 3 = 1", "notes"))
def upsert_aliases(s, d):
    n, k = v.notes(s, d), F.col("doc_id") % 3
    name = F.when(k == 0, F.concat(F.lit("Doc "), "doc_id")).when(k == 1, F.concat(F.lit("Also "), "doc_id")).otherwise("")
    new = n.select(F.col("path").alias("note_path"), name.alias("alias_name"), F.lit("alias").alias("alias_type"))
    return st.upsert_aliases(v.aliases(s, d), new.unionByName(new))


_FOUND = "SELECT note_path FROM state WHERE status = 'synced' AND length(note_path) % 5 = 0"


def _recorded(s, d):
    state = v.sync_state(s, d)
    found = state.where("status = 'synced' and length(note_path) % 5 = 0").select("note_path", F.col("content_hash").alias("local_hash"), F.lit("r").alias("remote_hash"), "local_mtime", "remote_mtime")
    unknown = found.limit(1).withColumn("note_path", F.lit("no such note"))
    return st.record_conflicts(state, v.history(s, d), found.unionByName(unknown), _at())


@query(with_views(f"SELECT note_path, CASE WHEN note_path IN ({_FOUND}) THEN 'conflict' ELSE status END AS status FROM state", "state"))
def recorded_conflicts(s, d):
    return _recorded(s, d)[0].select("note_path", "status")


@query(with_views(f"""SELECT note_path, content_hash, (SELECT max(seq) FROM history) AS before, (SELECT max(seq) FROM history) + 1 AS first, (SELECT max(seq) FROM history) + (SELECT count(*) FROM state WHERE note_path IN ({_FOUND})) AS last,
    (SELECT count(*) FROM state WHERE note_path IN ({_FOUND})) AS numbers FROM state WHERE note_path IN ({_FOUND})""", "state", "history"))
def conflict_history(s, d):
    """The rows added to the history; their numbers follow the last one without gaps."""
    old = v.history(s, d)
    added = _recorded(s, d)[1].where("action = 'conflict' and details like '%\"remote_hash\":\"r\"%'")
    last = old.agg(F.max("seq").alias("before"))
    given = added.agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.countDistinct("seq").alias("numbers"))
    return added.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(given)).select("note_path", "content_hash", "before", "first", "last", "numbers")


@query(with_views("SELECT note_path, CASE WHEN status = 'conflict' AND length(note_path) % 2 = 0 THEN 'synced' ELSE status END AS status FROM state", "state"))
def resolved_conflicts(s, d):
    state = v.sync_state(s, d)
    return st.resolve_conflicts(state, st.conflicts(state).where("length(note_path) % 2 = 0"), _at()).select("note_path", "status")


@query(with_views("""SELECT CASE k WHEN 2 THEN regexp_replace(note_path, '[.]md$', '') || '.conflict.md' ELSE note_path END AS path, CASE k WHEN 0 THEN 'push' ELSE 'write' END AS action,
    CASE k WHEN 1 THEN 'remote ' || note_path WHEN 2 THEN '---' || chr(10) || 'conflict: true' || chr(10) || 'original: ' || note_path || chr(10) || 'source: remote' || chr(10) || 'detected: 2024-01-10T00:00:00Z' || chr(10) || '---' || chr(10) || chr(10) || 'remote ' || note_path END AS content
    FROM (SELECT note_path, length(note_path) % 3 AS k FROM state WHERE status = 'conflict') WHERE note_path IN (SELECT path FROM notes)""", "state", "notes"))
def conflict_choices(s, d):
    from .plans.verbs import resolve_conflict

    found = st.conflicts(v.sync_state(s, d)).select("note_path", F.element_at(F.array(*map(F.lit, ("local", "remote", "both"))), (F.length("note_path") % 3 + 1).cast("int")).alias("keep"))
    remote = found.select("note_path", F.concat(F.lit("remote "), "note_path").alias("markdown"))
    return resolve_conflict(v.notes(s, d), remote, found, _at()).select("path", "action", "content")


# remote requests


@query(with_views("SELECT page_id, last_edited > 1704067200 + 86400 * 5 AS recent FROM remote JOIN (SELECT DISTINCT page_id FROM state) USING (page_id) WHERE error IS NULL", "remote", "state"))
def known_metadata(s, d):
    from .sources.remote import known_metadata as known

    ids = v.sync_state(s, d).select("page_id").where("page_id is not null").distinct()
    return known(ids, v.remote_pages(s, d)).select("page_id", (F.col("last_edited") > F.timestamp_seconds(F.lit(v.EPOCH + 86400 * 5))).alias("recent"))


@query(with_views("""SELECT i.page_id, CASE WHEN last_edited > 1704067200 + 3600 * 350 THEN 'cache' ELSE 'fetched' END AS origin, CASE WHEN last_edited > 1704067200 + 3600 * 350 THEN 'cached' WHEN r.page_id IS NULL THEN 'page not found: ' || i.page_id ELSE error END AS error
    FROM (SELECT DISTINCT page_id FROM state WHERE page_id <> '') i LEFT JOIN remote r USING (page_id)""", "state", "remote"))
def cached_metadata(s, d):
    """The cache holds all remote pages, fetched when they were edited; what is older than the limit is fetched again."""
    from .sources.remote import cached_metadata as cached

    remote = v.remote_pages(s, d)
    cache = remote.select("page_id", "last_edited", "archived", F.lit("cached").alias("error"), F.col("last_edited").alias("fetched_at"))
    ids = v.sync_state(s, d).where("page_id <> ''").select("page_id").distinct()
    now = F.timestamp_seconds(F.lit(v.EPOCH + 3600 * 700))
    found, _ = cached(ids, cache, remote, now, F.expr("interval 350 hours"))
    return found.select("page_id", F.when(F.col("fetched_at") == now, "fetched").otherwise("cache").alias("origin"), "error")


def _turns(s, d):
    """Conversations as blocks: even turns at the top, odd ones below the turn before."""
    rows = v.table(s, d, "conversations")
    t = F.col("turn").cast("int")
    path = F.when(t % 2 == 0, F.array(t)).otherwise(F.array(t - 1, t))
    kind = F.when(t % 4 == 0, "toggle").when(t % 4 == 2, "code").otherwise("paragraph")
    return rows.select(F.col("conv_id").alias("page_key"), path.alias("block_path"), (F.size(path) - 1).alias("depth"), kind.alias("type"), "text")


#: Conversations, a hundred a page: every fourth turn is a block of the page, the turns up to the next one are its children.
_PAGED = """WITH top AS (SELECT 'page-' || conv_id // 100 AS parent_id, conv_id || '-' || turn AS block_id, conv_id, turn FROM conversations WHERE turn % 4 = 0),
    low AS (SELECT c.conv_id || '-' || (c.turn - c.turn % 4) AS parent_id, c.conv_id || '-' || c.turn AS block_id, c.conv_id, c.turn, top.parent_id AS page_id FROM conversations c JOIN top ON top.block_id = c.conv_id || '-' || (c.turn - c.turn % 4) WHERE c.turn % 4 <> 0),
    blocks AS (SELECT parent_id AS page_id, parent_id, block_id, 0 AS depth, row_number() OVER (PARTITION BY parent_id ORDER BY conv_id, turn) - 1 AS pos FROM top
        UNION ALL SELECT page_id, parent_id, block_id, 1, row_number() OVER (PARTITION BY parent_id ORDER BY turn) - 1 FROM low)"""


def _workspace(s, d):
    """Exports the conversations as blocks and the documents as pages of a database a source; where they lie."""
    from .scratch import Scratch
    from .sources import paged

    scratch = Scratch(s, "workspace")
    t = F.col("turn")
    name = lambda turn: F.concat("conv_id", F.lit("-"), turn)
    rows = v.table(s, d, "conversations").select("conv_id", "turn", "role", "text", name(t).alias("block_id"), name(t - t % 4).alias("top"))
    parents = rows.where(t % 4 != 0).select(F.col("top").alias("block_id")).distinct().withColumn("has_children", F.lit(True))
    page = F.concat(F.lit("page-"), F.floor(F.col("conv_id") / 100))
    blocks = rows.join(parents, "block_id", "left").select("block_id", F.when(t % 4 == 0, page).otherwise(F.col("top")).alias("parent_id"), F.col("role").alias("type"), "text", F.coalesce("has_children", F.lit(False)).alias("has_children"), (F.col("conv_id") * 1000 + t).alias("at"))
    paged.export_rows(blocks, f"{scratch.base}/blocks", "parent_id", "at", scratch)
    docs = v.table(s, d, "documents")
    pages = docs.select(F.coalesce("source", F.lit("none")).alias("database_id"), F.concat(F.lit("page-"), "doc_id").alias("page_id"), F.concat(F.lit("Doc "), "doc_id").alias("title"), F.col("lang").alias("tag"), (F.col("doc_id") % 19 == 0).alias("archived"), F.col("doc_id").alias("at"))
    paged.export_rows(pages, f"{scratch.base}/pages", "database_id", "at", scratch)
    return scratch.base


def _trees(s, d):
    from .sources import paged

    base = _workspace(s, d)
    ids = v.table(s, d, "conversations").select(F.concat(F.lit("page-"), F.floor(F.col("conv_id") / 100)).alias("page_id")).distinct()
    return paged.fetch_trees(ids, lambda: paged.Export(base))


@query(_PAGED + "SELECT page_id, parent_id, block_id, depth, pos, (pos // 100 + 1)::INT AS request FROM blocks")
def paged_children(s, d):
    """All blocks of all pages by requests of a hundred, level by level."""
    return _trees(s, d).where("block_id is not null").select("page_id", "parent_id", "block_id", "depth", "pos", "request")


@query(_PAGED + ", per AS (SELECT page_id, parent_id, count(*) AS n FROM blocks GROUP BY page_id, parent_id) SELECT page_id, sum(n)::BIGINT AS blocks, sum((n + 99) // 100)::BIGINT AS requests FROM per GROUP BY page_id")
def page_requests(s, d):
    from .sources.paged import request_counts

    return request_counts(_trees(s, d))


@query("""SELECT database_id, page_id, title, ((row_number() OVER (PARTITION BY database_id ORDER BY doc_id) - 1) // 100 + 1)::INT AS request FROM (
    SELECT coalesce(source, 'none') AS database_id, doc_id, 'page-' || doc_id AS page_id, 'Doc ' || doc_id AS title FROM documents WHERE lang = 'en' AND doc_id % 19 <> 0)""")
def database_query(s, d):
    """The English pages of every database that aren't archived; both filters go with the requests, so pages are of what is wanted."""
    from .sources import paged

    pages = paged.query_pages(s, _workspace(s, d), wanted={"tag": "en", "archived": False})
    return pages.select("database_id", "page_id", "title", "request")


@query(_PAGED + " SELECT parent_id AS page_id, (pos // 100)::INT AS batch, count(*) AS blocks, 1::BIGINT AS sends FROM blocks WHERE depth = 0 GROUP BY ALL")
def sent_requests(s, d):
    """The blocks of all pages sent in batches of a hundred, and sent again: how often each request left."""
    from .sources import sink
    from .sources.remote import append_batches

    t = F.col("turn")
    page = F.concat(F.lit("page-"), F.floor(F.col("conv_id") / 100))
    top = v.table(s, d, "conversations").where(t % 4 == 0).select(page.alias("page_key"), F.concat("conv_id", F.lit("-"), t).alias("block_id"), F.array("conv_id", t).alias("block_path"), F.lit(0).alias("depth"))
    requests = sink.append_requests(append_batches(top), "page_key").repartition(2)
    sink.register(s)
    from .scratch import Scratch

    base = Scratch(s, "sent").base
    out = requests.write.format("workspace_requests").mode("append").options(service="marginalia.sources.sink:Outbox", path=f"{base}/outbox", ledger=f"{base}/ledger", perSecond="1000", writers="2")
    out.save()
    out.save()
    left = s.read.schema(sink.REQUEST).json(f"{base}/outbox").withColumn("b", F.from_json("body", "page string, children array<string>"))
    sends = left.groupBy("request_id", "b").agg(F.count(F.lit(1)).alias("sends"))
    done = sink.ledger(s, f"{base}/ledger").where("state = 'done'")
    return sends.join(done, "request_id").select(F.col("b.page").alias("page_id"), F.split("request_id", ":")[1].cast("int").alias("batch"), F.size("b.children").cast("bigint").alias("blocks"), "sends")


@query("SELECT conv_id AS page_key, turn FROM conversations WHERE turn % 2 = 1 AND turn - 1 = 2")
def child_blocks(s, d):
    from .sources.remote import children

    return children(_turns(s, d), [2]).select("page_key", F.element_at("block_path", -1).cast("bigint").alias("turn"))


@query("SELECT conv_id AS page_key, turn, turn % 4 = 0 AND EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn = c.turn + 1) AS has_children FROM conversations c")
def block_children_flags(s, d):
    from .sources.remote import has_children

    return has_children(_turns(s, d)).select("page_key", F.element_at("block_path", -1).cast("bigint").alias("turn"), "has_children")


@query("SELECT conv_id AS page_key, count(*) AS blocks FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id")
def deleted_blocks(s, d):
    from .sources.remote import delete_blocks

    blocks = _turns(s, d)
    return delete_blocks(blocks, blocks.where("page_key % 3 = 0")).groupBy("page_key").agg(F.count(F.lit(1)).alias("blocks"))


@query("SELECT conv_id AS page_key, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE count(*) END AS blocks, CASE WHEN conv_id % 3 = 0 THEN 'new' ELSE 'old' END AS source FROM conversations GROUP BY conv_id")
def replaced_blocks(s, d):
    from .sources.remote import replace_blocks

    blocks = _turns(s, d).withColumn("text", F.lit("old"))
    new = blocks.where("page_key % 3 = 0").groupBy("page_key").agg(F.array(F.lit(0)).alias("block_path"), F.lit(0).alias("depth"), F.lit("paragraph").alias("type"), F.lit("new").alias("text"))
    return replace_blocks(blocks, new).groupBy("page_key").agg(F.count(F.lit(1)).alias("blocks"), F.min("text").alias("source"))


@query("SELECT c_custkey AS page_key, 'database_id' AS parent_type, 'db1' AS parent, 'Name,Segment' AS names, CAST(ceil((c_custkey % 350) / 100.0) AS BIGINT) AS append_requests FROM customer UNION ALL SELECT c_custkey, 'page_id', 'p1', 'title', CAST(ceil((c_custkey % 350) / 100.0) AS BIGINT) FROM customer")
def create_requests(s, d):
    from .operators import properties as p
    from .sources.remote import create_requests as create

    rules = (p.Rule("name", "Name", "title"), p.Rule("segment", "Segment", "select"))
    fm = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    pages = v.table(s, d, "customer").select(F.col("c_custkey").alias("page_key"), p.to_properties(fm, F.array().cast("array<string>"), rules).alias("properties"), F.array_repeat(F.lit(0), (F.col("c_custkey") % 350).cast("int")).alias("blocks"))
    both = create(pages, database_id="db1").unionByName(create(pages, parent_page="p1"))
    return both.select("page_key", "parent_type", "parent", F.array_join(p.sorted_keys(F.col("properties")), ",").alias("names"), F.col("append_requests").cast("bigint").alias("append_requests"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'rich_text' WHEN 1 THEN 'checked,rich_text' WHEN 2 THEN 'language,rich_text' ELSE '' END AS fields FROM part")
def block_updates(s, d):
    from .operators.properties import sorted_keys
    from .sources.remote import block_update

    kind = F.element_at(F.array(*map(F.lit, ("paragraph", "to_do", "code", "divider"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    attrs = F.create_map(*[F.lit(x) for n in ("rich_text", "checked", "language", "url") for x in (n, "1")])
    return v.table(s, d, "part").select("p_partkey", F.array_join(sorted_keys(block_update(kind, attrs)), ",").alias("fields"))


# plans


@query(with_views("SELECT CASE WHEN error IS NOT NULL THEN 'failed' WHEN archived THEN 'delete' ELSE 'pull' END AS outcome, count(*) AS n FROM remote GROUP BY 1", "remote"))
def run_summary(s, d):
    from .plans.runtime import run_summary as summary

    return summary(v.remote_pages(s, d).select(F.when(F.col("archived"), "delete").otherwise("pull").alias("action"), "error"))


@query("SELECT o_orderkey, CASE WHEN t > 0 THEN 100.0 * n / t ELSE 0 END AS percent, CASE WHEN n > 0 AND e > 0 THEN n / e END AS rate, CASE WHEN n > 0 AND e > 0 THEN (t - n) / (n / e) END AS eta FROM (SELECT o_orderkey, CAST(o_orderkey % 5 AS DOUBLE) AS n, CAST(o_orderkey % 7 AS DOUBLE) AS t, CAST(o_orderkey % 4 AS DOUBLE) AS e FROM orders)")
def progress(s, d):
    from .plans.runtime import progress as shown

    k = F.col("o_orderkey")
    p = shown((k % 5).cast("double"), (k % 7).cast("double"), (k % 4).cast("double"))
    return v.table(s, d, "orders").select("o_orderkey", p["percent"].alias("percent"), p["rate"].alias("rate"), p["eta_seconds"].alias("eta"))




@query(with_views("SELECT path, CASE WHEN status = 'conflict' THEN 'conflict' ELSE 'push' END AS action FROM hashes h LEFT JOIN state s ON path = note_path WHERE doc_id % 4 = 0 AND (s.note_path IS NULL OR fm_hash <> frontmatter_hash OR body_hash <> content_hash)", "hashes", "state"))
def file_syncs(s, d):
    """What bursts of events on every fourth note start."""
    from .streaming.events import debounce, sync_files

    events = v.notes(s, d).where("doc_id % 4 = 0").select("path", F.lit("write").alias("op"), F.col("mtime").alias("ts"))
    return sync_files(v.note_hashes(s, d), v.sync_state(s, d), debounce(events.unionByName(events)))


@query(with_views("SELECT s.note_path AS path, 'page ' || s.page_id AS content, s.page_id FROM state s JOIN remote r ON r.page_id = s.page_id WHERE s.page_id <> '' AND NOT archived AND error IS NULL AND last_edited > remote_mtime", "state", "remote"))
def pulled_files(s, d):
    from .streaming.events import pull_files

    plan = diff.pull_candidates(v.sync_state(s, d), v.remote_pages(s, d))
    shown = v.remote_pages(s, d).select(F.col("page_id").alias("page_key"), F.concat(F.lit("page "), "page_id").alias("markdown"))
    return pull_files(plan, shown, _at()).select("path", "content", "page_id")


def _initial(s, d):
    from .plans.verbs import init

    return init(v.notes(s, d))


@query(with_views("SELECT path AS note_path, body_hash AS content_hash, fm_hash AS frontmatter_hash, 'pending' AS status FROM hashes", "hashes"))
def init_state(s, d):
    return _initial(s, d).state.select("note_path", "content_hash", "frontmatter_hash", "status")


@query(with_views("SELECT source_path, count(*) AS links FROM link WHERE target_name NOT LIKE 'img-%' GROUP BY source_path", "link"))
def init_links(s, d):
    return _initial(s, d).links.groupBy("source_path").agg(F.count(F.lit(1)).alias("links"))


@query(with_views("SELECT note_path, alias_name, 'title' AS alias_type FROM alias", "alias"))
def init_aliases(s, d):
    return _initial(s, d).aliases.select("note_path", "alias_name", "alias_type")


@query(with_views("SELECT page_id, title FROM remote WHERE lower(title) = 'title 10'", "remote"))
def find_database(s, d):
    from .plans.verbs import find_database as find

    return find(v.remote_pages(s, d), "TITLE 10").select("page_id", "title")


def _vault(s, d):
    from .plans.verbs import Vault

    return Vault(v.notes(s, d), v.sync_state(s, d), _links(s, d), v.aliases(s, d), v.remote_pages(s, d))


@query(with_views("SELECT path, type FROM (SELECT path, type FROM diff2 UNION ALL SELECT note_path, CASE WHEN coalesce(page_id, '') = '' THEN 'created' ELSE 'modified' END FROM state WHERE status = 'pending' AND note_path NOT IN (SELECT path FROM diff2)) WHERE type <> 'conflict' AND path NOT IN (SELECT note_path FROM state WHERE status = 'conflict') AND regexp_matches(path, '^[^/]*/en-[^/]*$')", "diff2", "state"))
def push_verb(s, d):
    from .plans.verbs import push

    return push(_vault(s, d), pattern="*/en-*").select("path", "type")


@query(with_views("""SELECT s.note_path AS path, s.page_id, CASE WHEN r.page_id IS NULL OR archived OR coalesce(error LIKE '%not found%', false) THEN 'delete' ELSE 'pull' END AS action FROM state s LEFT JOIN remote r ON r.page_id = s.page_id
    WHERE s.page_id <> '' AND s.status <> 'conflict' AND (r.page_id IS NULL OR archived OR coalesce(error LIKE '%not found%', false) OR (error IS NULL AND last_edited > remote_mtime)) AND regexp_matches(s.note_path, '^[^/]*/en-[^/]*$')""", "state", "remote"))
def pull_verb(s, d):
    from .plans.verbs import pull

    return pull(_vault(s, d), pattern="*/en-*").select("path", "page_id", "action")


@query(with_views("SELECT path, type, CASE WHEN type = 'conflict' THEN 'conflict' ELSE direction END AS action FROM diff3", "diff3"))
def sync_verb(s, d):
    from .plans.verbs import sync

    return sync(_vault(s, d))


@query(with_views("SELECT s.note_path, page_id, c.n IS NOT NULL AS known FROM state s LEFT JOIN (SELECT note_path, count(*) AS n FROM history WHERE action = 'conflict' GROUP BY 1) c USING (note_path) WHERE status = 'conflict'", "state", "history"))
def conflict_report(s, d):
    from .plans.verbs import conflict_report as report

    return report(_vault(s, d), v.history(s, d)).select("note_path", "page_id", F.col("conflict").isNotNull().alias("known"))


# notes as blocks

#: A note with every kind of block; ``@`` stands for the row's name.
SAMPLE = """# Head @

Para **bold** and *it* `co` ~~no~~ [link](http://x/y) ==hi== [[Page|shown]] ![[pic.png]] ![[doc.pdf]] `=this.x`

- one @
  - two
1. first
- [x] done

```sql
select @
```

> quoted @

> [!warning] Title
> inside

---

| a | b |
|---|---|
| @ | 2 |

$$
x = 1
$$

![alt](http://x/@.png)

![](local/@.png)

### Deep
"""
#: What it becomes: type, depth, text, attribute. Written down by hand from the rules.
EXPECTED = [
    ("heading_1", 0, "Head @", ""), ("paragraph", 0, "Para bold and it co no link hi [[Page]] [🖼️ pic.png] [📄 doc.pdf] [dv: this.x]", ""), ("bulleted_list_item", 0, "one @", ""),
    ("bulleted_list_item", 1, "two", ""), ("numbered_list_item", 0, "first", ""), ("to_do", 0, "done", "true"), ("code", 0, "select @", "sql"), ("quote", 0, "quoted @", ""),
    ("callout", 0, "Title\ninside", "⚠️"), ("divider", 0, "", ""), ("table", 0, "", "2"), ("table_row", 1, "", ""), ("table_cell", 2, "a", ""), ("table_cell", 2, "b", ""),
    ("table_row", 1, "", ""), ("table_cell", 2, "@", ""), ("table_cell", 2, "2", ""), ("equation", 0, "", "x = 1"), ("image", 0, "alt", "http://x/@.png"),
    ("callout", 0, "Local Image\nThis file is only on the note's own machine.\nlocal/@.png", "🖼️"), ("heading_3", 0, "Deep", ""),
]
#: Styled runs of the paragraph: content, style.
STYLES = [("bold", "bold"), ("it", "italic"), ("co", "code"), ("no", "strike"), ("link", "http://x/y"), ("hi", "yellow_background"), ("[[Page]]", "red"), ("[🖼️ pic.png]", "gray_background"), ("[📄 doc.pdf]", "blue_background"), ("[dv: this.x]", "code purple_background")]
MARKDOWN = """# Head @

Para **bold** and *it* `co` ~~no~~ [link](http://x/y) ==hi== [[Page]] [🖼️ pic.png] [📄 doc.pdf] `[dv: this.x]`

- one @
  - two
1. first
- [x] done
```sql
select @
```

> quoted @

---

| a | b |
| --- | --- |
| @ | 2 |

$$
x = 1
$$

![alt](http://x/@.png)

### Deep

"""


def _sql_text(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _sample_blocks(s, d):
    from .operators import blocks

    body = F.replace(F.lit(SAMPLE), F.lit("@"), F.concat(F.lit("part"), "p_partkey"))
    return blocks.note_blocks(v.table(s, d, "part").select(F.col("p_partkey").alias("path"), body.alias("body")))


_ROWS = ", ".join(f"({i}, {_sql_text(k)}, {depth}, {_sql_text(t)}, {_sql_text(a)})" for i, (k, depth, t, a) in enumerate(EXPECTED))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS page_key, CAST(i AS BIGINT) AS at, type, CAST(depth AS BIGINT) AS depth, replace(t, '@', 'part' || p_partkey) AS text, replace(a, '@', 'part' || p_partkey) AS attr FROM part, (VALUES {_ROWS}) AS e(i, type, depth, t, a)")
def sample_blocks(s, d):
    """Every kind of block of a sample note for each part: order, depth, text and the attribute that matters."""
    from pyspark.sql import Window

    attr = reduce(lambda a, b: F.coalesce(a, b), [F.element_at("attrs", n) for n in ("checked", "language", "icon", "width", "expression", "url")])
    at = F.row_number().over(Window.partitionBy("page_key").orderBy("block_path")) - 1
    return _sample_blocks(s, d).select("page_key", at.cast("bigint").alias("at"), "type", F.col("depth").cast("bigint").alias("depth"), F.array_join(F.transform("rich_text", lambda r: r["content"]), "").alias("text"), F.coalesce(attr, F.lit("")).alias("attr"))


_STYLES = ", ".join(f"({_sql_text(t)}, {_sql_text(k)})" for t, k in STYLES)


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS page_key, t AS content, style FROM part, (VALUES {_STYLES}) AS e(t, style)")
def sample_styles(s, d):
    """The styled runs of the sample's paragraph, with their colours."""
    runs = _sample_blocks(s, d).where("type = 'paragraph'").select("page_key", F.explode("rich_text").alias("r"))
    flags = [F.when(F.col(f"r.{n}"), n) for n in ("bold", "italic", "code", "strike")]
    return runs.select("page_key", F.col("r.content").alias("content"), F.concat_ws(" ", *flags, "r.link", "r.color").alias("style")).where("style <> ''")


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS page_key, replace({_sql_text(MARKDOWN)}, '@', 'part' || p_partkey) AS markdown FROM part")
def sample_markdown(s, d):
    """The sample's blocks, but for its callouts, as markdown again."""
    from .operators.blocks import blocks_markdown

    return blocks_markdown(_sample_blocks(s, d).where("type <> 'callout'"))


@query(with_views("SELECT count(*) AS mentions FROM (SELECT DISTINCT source_path, target FROM edge WHERE target LIKE 'Doc %' OR target LIKE '%-%') e JOIN resolved r USING (target) WHERE target NOT LIKE 'img-%'", "edge", "resolved"))
def rendered_mentions(s, d):
    """Links in blocks that became mentions of pages."""
    from .operators import blocks, extract

    raw = blocks.note_blocks(extract.parse_notes(v.notes(s, d)))
    shown = blocks.render_links(raw, lk.resolve(_links(s, d), v.sync_state(s, d), v.aliases(s, d)))
    runs = shown.select("page_key", F.explode("rich_text").alias("r")).where("r.type = 'mention'")
    return runs.select("page_key", "r.page_id", "r.content").distinct().agg(F.count(F.lit(1)).alias("mentions"))


#: A customer embeds those of half and a third of its number; some pairs embed each other.
_NESTED = """WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM (SELECT c_custkey AS source, c_custkey // 2 AS target FROM customer UNION ALL SELECT c_custkey, c_custkey // 3 FROM customer
        UNION ALL SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 50 = 17 UNION ALL SELECT c_custkey, c_custkey - 1 FROM customer WHERE c_custkey % 50 = 18)),
    walk AS (SELECT source AS root, target, 1 AS depth FROM e UNION SELECT root, e.target, depth + 1 FROM walk JOIN e ON e.source = walk.target WHERE depth < 10),
    reach AS (SELECT root, target, min(depth) AS depth FROM walk GROUP BY root, target)"""


def _nested(s, d):
    c = v.table(s, d, "customer").select(F.col("c_custkey").alias("c"))
    targets = F.array(F.expr("c div 2"), F.expr("c div 3"), F.when(F.col("c") % 50 == 17, F.col("c") + 1).when(F.col("c") % 50 == 18, F.col("c") - 1))
    return c.select(F.col("c").alias("source"), F.explode(targets).alias("target"), F.lit(False).alias("media")).where("target is not null")


@query(_NESTED + " SELECT root, target, depth FROM reach")
def embed_reach(s, d):
    from .operators import embeds

    return embeds.embed_reach(_nested(s, d))


@query(_NESTED + """ SELECT root, min(depth)::INT AS depth FROM (SELECT r.root, r.depth + c.depth AS depth FROM reach r JOIN reach c ON c.root = r.target AND c.target = r.target
    UNION ALL SELECT root, depth FROM reach WHERE root = target) WHERE depth <= 10 GROUP BY root""")
def embed_repeats(s, d):
    """At which depth a customer's embeds first come back to one on their way."""
    from .operators import embeds

    return embeds.first_repeats(_nested(s, d))


@query("""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g""")
def debounce_timers(s, d):
    """All events replayed as a stream; the last burst of each user comes out by its timer."""
    import time

    from .scratch import Scratch
    from .streaming.timers import debounce_timers as bursts

    base = Scratch(s, "debounce").base
    table = v.table(s, d, "events")
    stream = s.readStream.schema(table.schema).parquet(f"{d}/events.parquet*").select("user_id", "ts", F.col("event_type").alias("op"))
    out = bursts(stream, 1800, 0.5, key="user_id").writeStream.format("parquet").option("path", f"{base}/bursts").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").start()
    todo = table.count()
    try:
        while out.isActive and (todo > 0 or out.lastProgress is None or sum(o.numRowsTotal for o in out.lastProgress.stateOperators)):
            time.sleep(0.2)
            todo = table.count() - sum(p.numInputRows for p in out.recentProgress) if todo > 0 else todo
        if out.exception():
            raise out.exception()
    finally:
        out.stop()
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return s.read.parquet(f"{base}/bursts").select("user_id", ntz("first_ts"), ntz("last_ts"), "events")


@query("""WITH t AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, 'list ' || repeat('é', doc_id % 4) AS word, strlen('é `=this.é` ') AS before FROM documents),
    b AS (SELECT *, before + n + 1 AS start_pos, before + n + 1 + strlen('```dataview' || chr(10) || word || chr(10) || '```') AS end_pos FROM t)
    SELECT doc_id, 0 AS nth, 'LIST' AS type, word AS raw, start_pos, end_pos FROM b
    UNION ALL SELECT doc_id, 1, 'INLINE', 'this.é', strlen('é '), strlen('é `=this.é`') FROM b
    UNION ALL SELECT doc_id, 2, 'INLINE', 'b', end_pos + 1, end_pos + 1 + strlen('`=b`') FROM b""")
def query_offsets(s, d):
    """Byte offsets of queries before, behind and far behind each document's text, all with letters of several bytes."""
    docs = v.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("list "), F.repeat(F.lit("é"), (F.col("doc_id") % 4).cast("int"))).alias("word"))
    body = F.concat(F.lit("é `=this.é` "), "text", F.lit("\n```dataview\n"), "word", F.lit("\n```\n`=b`"))
    found = docs.select("doc_id", F.posexplode(text.located_queries(body)).alias("nth", "q"))
    return found.select("doc_id", "nth", "q.type", "q.raw", F.col("q.start_pos").cast("bigint").alias("start_pos"), F.col("q.end_pos").cast("bigint").alias("end_pos"))


@query(with_views("""SELECT note_path, page_id, sum(resolved)::BIGINT AS resolved, sum(renamed)::BIGINT AS renamed FROM (
        SELECT source_path AS note_path, 1 AS resolved, 0 AS renamed FROM link WHERE target_name NOT IN (SELECT target FROM resolved) AND target_name IN (
            SELECT t.target FROM (SELECT DISTINCT target FROM edge) t JOIN diff2 n ON n.type = 'created' AND (n.path = t.target OR n.path = t.target || '.md' OR lower(n.path) LIKE '%/' || lower(t.target) || '.md')
            UNION SELECT alias_name FROM alias JOIN diff2 n ON n.type = 'created' AND n.path = note_path)
        UNION ALL SELECT source_path, 0, 1 FROM link JOIN resolved r ON r.target = target_name WHERE r.page_id IN (SELECT o.page_id FROM diff2 d JOIN state o ON o.note_path = d.old_path)) u
    JOIN (SELECT note_path, page_id FROM state WHERE page_id <> '' AND note_path NOT IN (SELECT old_path FROM diff2 WHERE old_path IS NOT NULL)
        UNION ALL SELECT path, 'made-' || path FROM diff2 WHERE type = 'created'
        UNION ALL SELECT d.path, o.page_id FROM diff2 d JOIN state o ON o.note_path = d.old_path) p USING (note_path) GROUP BY note_path, page_id""", "link", "edge", "resolved", "alias", "diff2", "state"))
def pages_to_render(s, d):
    """After a push that made pages for new notes and moved renamed ones: the notes whose links changed by that."""
    from .operators import relink
    from .scratch import Scratch

    state, aliases = v.sync_state(s, d), v.aliases(s, d)
    changes = Scratch(s, "push").save(_local(s, d).where("type in ('created', 'renamed')").select("type", "path", "old_path", "page_id"), "changes")
    created = changes.where("type = 'created'").select(F.col("path").alias("note_path"), F.concat(F.lit("made-"), "path").alias("page_id"))
    moves = changes.where("type = 'renamed'").select("old_path", "path", "page_id")
    after, _, _ = st.apply_renames(state, _links(s, d), aliases, moves.withColumnRenamed("path", "new_path"), _at())
    return relink.pages_to_render(_resolved(s, d), created, moves, relink.with_pages(after, created), aliases)


@query(with_views("SELECT o.page_id, regexp_replace(regexp_extract(d.path, '[^/]*$'), '[.][^.]*$', '') AS title FROM diff2 d JOIN state o ON o.note_path = d.old_path", "diff2", "state"))
def renamed_titles(s, d):
    from .operators import relink

    return relink.rename_titles(_local(s, d).where("type = 'renamed'"))
