"""Notes, state, remote pages, links and blocks derived from the test tables, as DataFrames and, for the oracle, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import diff
from .operators import links as link_ops

EPOCH = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    content = F.concat(
        F.lit("---\ntitle: Doc "), d, F.lit("\ntags: ["), "lang", F.lit(", "), "source", F.lit("]\n---\n"), "text",
        F.lit("\n\nSee [["), "lang", F.lit("-"), F.expr("(7 * doc_id + 3) div 5"), F.lit("]] and [[Doc "), F.expr("(11 * doc_id + 5) div 8"), F.lit("#Part|alias]] ![[img-"), F.expr("doc_id div 3"), F.lit(".png|100x200]]\n"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("-"), d, F.lit(".md")).alias("path"), content.alias("content"), F.timestamp_seconds(EPOCH + d * 60).alias("mtime"))


def note_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.fingerprints(notes(spark, sf_dir))


def sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    n = diff.fingerprints(notes(spark, sf_dir), keep=("doc_id",))
    when = F.timestamp_seconds(EPOCH + (d % 500) * 3600)
    none = F.lit(None).cast("string")
    row = lambda path, page, body, front, status: [path.alias("note_path"), page.alias("page_id"), none.alias("parent_id"), body.alias("content_hash"), front.alias("frontmatter_hash"), F.timestamp_seconds(EPOCH + d * 30).alias("local_mtime"), when.alias("remote_mtime"), when.alias("last_sync"), none.alias("sync_direction"), status.alias("status")]
    status = F.when(d % 11 == 0, "conflict").when(d % 11 == 1, "pending").otherwise("synced")
    tracked = n.where(d % 13 != 0).select(*row(F.col("note_path"), F.when(d % 17 != 0, F.concat(F.lit("page-"), d)), F.when(d % 7 == 0, "stale").otherwise(F.col("content_hash")), F.when(d % 10 == 1, "stale").otherwise(F.col("frontmatter_hash")), status))
    moved = n.where(d % 26 == 0).select(*row(F.concat(F.lit("old/"), d, F.lit(".md")), F.concat(F.lit("ghost-"), d), F.col("full_hash"), F.lit(""), F.lit("synced")))
    gone = n.where(d % 40 == 7).select(*row(F.concat(F.lit("gone/"), d, F.lit(".md")), F.concat(F.lit("gone-"), d), F.concat(F.lit("gone-"), d), F.lit(""), F.when(d % 80 == 7, "synced").otherwise("pending")))
    return tracked.unionByName(moved).unionByName(gone)


def remote_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    edited = F.timestamp_seconds(EPOCH + (d * 37 % 700) * 3600)
    tracked = docs.where(d % 23 != 0).select(F.concat(F.lit("page-"), d).alias("page_id"), edited.alias("last_edited"), (d % 19 == 0).alias("archived"), F.when(d % 29 == 0, F.concat(F.lit("page not found: "), d)).alias("error"), F.concat(F.lit("Title "), d).alias("title"))
    new = docs.where(d % 31 == 3).select(F.concat(F.lit("new-"), d).alias("page_id"), edited.alias("last_edited"), F.lit(False).alias("archived"), F.lit(None).cast("string").alias("error"), F.when(d % 2 == 0, F.concat(F.lit(" ..a/b: "), d, F.lit("?."))).alias("title"))
    return tracked.unionByName(new)


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select(F.col("path").alias("note_path"), F.concat(F.lit("Doc "), "doc_id").alias("alias_name"), F.lit("title").alias("alias_type"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_ops.register(link_ops.extract_links(notes(spark, sf_dir)))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("note-"), "user_id").alias("note_path"), F.col("event_type").alias("action"), "ts", F.lit(None).cast("string").alias("content_hash"), F.col("props").alias("details"))


def _sql_norm(x: str) -> str:
    lf = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return rf"trim(regexp_replace(regexp_replace({lf}, '(?m)[ \t]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160))"


#: The same views in SQL, each on those before it.
SQL = {
    "notes": """SELECT doc_id, source || '/' || lang || '-' || doc_id || '.md' AS path, lang, source, text,
        'title: Doc ' || doc_id || chr(10) || 'tags: [' || lang || ', ' || source || ']' AS fm,
        text || chr(10) || chr(10) || 'See [[' || lang || '-' || ((7 * doc_id + 3) // 5) || ']] and [[Doc ' || ((11 * doc_id + 5) // 8) || '#Part|alias]] ![[img-' || (doc_id // 3) || '.png|100x200]]' || chr(10) AS body,
        1704067200 + doc_id * 60 AS mtime FROM documents""",
    "hashes": f"""SELECT doc_id, path, mtime, CASE WHEN b = '' THEN '' ELSE sha256(b) END AS body_hash, sha256(fm) AS fm_hash, sha256(fm || chr(10) || b) AS full_hash
        FROM (SELECT *, {_sql_norm("body")} AS b FROM notes)""",
    "state": """SELECT path AS note_path, CASE WHEN doc_id % 17 <> 0 THEN 'page-' || doc_id END AS page_id,
            CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE body_hash END AS content_hash, CASE WHEN doc_id % 10 = 1 THEN 'stale' ELSE fm_hash END AS frontmatter_hash,
            1704067200 + (doc_id % 500) * 3600 AS remote_mtime, 1704067200 + doc_id * 30 AS local_mtime,
            CASE doc_id % 11 WHEN 0 THEN 'conflict' WHEN 1 THEN 'pending' ELSE 'synced' END AS status FROM hashes WHERE doc_id % 13 <> 0
        UNION ALL SELECT 'old/' || doc_id || '.md', 'ghost-' || doc_id, full_hash, '', 1704067200 + (doc_id % 500) * 3600, 1704067200 + doc_id * 30, 'synced' FROM hashes WHERE doc_id % 26 = 0
        UNION ALL SELECT 'gone/' || doc_id || '.md', 'gone-' || doc_id, 'gone-' || doc_id, '', 1704067200 + (doc_id % 500) * 3600, 1704067200 + doc_id * 30, CASE WHEN doc_id % 80 = 7 THEN 'synced' ELSE 'pending' END FROM hashes WHERE doc_id % 40 = 7""",
    "remote": """SELECT 'page-' || doc_id AS page_id, 1704067200 + (doc_id * 37 % 700) * 3600 AS last_edited, doc_id % 19 = 0 AS archived,
            CASE WHEN doc_id % 29 = 0 THEN 'page not found: ' || doc_id END AS error, 'Title ' || doc_id AS title FROM documents WHERE doc_id % 23 <> 0
        UNION ALL SELECT 'new-' || doc_id, 1704067200 + (doc_id * 37 % 700) * 3600, false, NULL, CASE WHEN doc_id % 2 = 0 THEN ' ..a/b: ' || doc_id || '?.' END FROM documents WHERE doc_id % 31 = 3""",
    "alias": "SELECT path AS note_path, 'Doc ' || doc_id AS alias_name FROM notes",
    "edge": """SELECT path AS source_path, 0 AS pos, lang || '-' || ((7 * doc_id + 3) // 5) AS target, '' AS alias, '' AS heading FROM notes
        UNION ALL SELECT path, 1, 'Doc ' || ((11 * doc_id + 5) // 8), 'alias', 'Part' FROM notes
        UNION ALL SELECT path, 2, 'img-' || (doc_id // 3) || '.png', '100x200', '' FROM notes""",
    "link": "SELECT DISTINCT source_path, target AS target_name FROM edge",
    "page": "SELECT note_path, page_id FROM state WHERE page_id IS NOT NULL",
    "resolved": """SELECT t AS target, r.arm, r.note_path, r.page_id FROM (
            SELECT t, arm, note_path, page_id, row_number() OVER (PARTITION BY t ORDER BY arm, note_path) AS k FROM (
                SELECT t, 2 AS arm, note_path, page_id FROM (SELECT DISTINCT target AS t FROM edge) JOIN page ON note_path = t OR note_path = t || '.md' OR lower(note_path) LIKE '%/' || lower(t) || '.md'
                UNION ALL SELECT t, 3, note_path, page_id FROM (SELECT DISTINCT target AS t FROM edge) JOIN alias ON alias_name = t JOIN page USING (note_path))) r WHERE k = 1""",
    "diff1": """SELECT h.path, CAST(NULL AS VARCHAR) AS old_path, CASE WHEN status = 'conflict' THEN 'conflict' ELSE 'modified' END AS type, CASE WHEN status = 'conflict' THEN 'both' ELSE 'push' END AS direction,
                fm_hash <> frontmatter_hash AND body_hash = content_hash AS frontmatter_only, mtime AS local_mtime
            FROM hashes h JOIN state s ON h.path = s.note_path WHERE fm_hash <> frontmatter_hash OR body_hash <> content_hash
        UNION ALL SELECT n.path, o.note_path, 'renamed', 'push', false, mtime FROM
            (SELECT path, full_hash, mtime, row_number() OVER (PARTITION BY full_hash ORDER BY path) AS r FROM hashes WHERE path NOT IN (SELECT note_path FROM state)) n
            JOIN (SELECT note_path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY note_path) AS r FROM state WHERE page_id <> '' AND status = 'synced' AND note_path NOT IN (SELECT path FROM hashes)) o ON full_hash = content_hash AND n.r = o.r""",
    "diff2": """SELECT * FROM diff1
        UNION ALL SELECT path, NULL, 'created', 'push', false, mtime FROM hashes WHERE path NOT IN (SELECT note_path FROM state) AND path NOT IN (SELECT path FROM diff1)
        UNION ALL SELECT note_path, NULL, 'deleted', 'push', false, NULL FROM state WHERE page_id <> '' AND status = 'synced' AND note_path NOT IN (SELECT path FROM hashes) AND note_path NOT IN (SELECT old_path FROM diff1 WHERE old_path IS NOT NULL)""",
    "seen": """SELECT note_path AS path, r.page_id, last_edited, archived, content_hash, frontmatter_hash FROM state s JOIN remote r ON r.page_id = s.page_id
        WHERE s.page_id <> '' AND error IS NULL AND (archived OR last_edited > remote_mtime)""",
    "diff3": """SELECT d.path, old_path, CASE WHEN s.path IS NULL THEN type ELSE 'conflict' END AS type, CASE WHEN s.path IS NULL THEN direction ELSE 'both' END AS direction, d.local_mtime AS local_mtime,
                CASE WHEN s.path IS NOT NULL THEN last_edited WHEN old_path IS NULL AND type <> 'created' AND type <> 'deleted' THEN remote_mtime END AS remote_mtime
            FROM diff2 d LEFT JOIN seen s ON d.path = s.path LEFT JOIN state t ON t.note_path = d.path
        UNION ALL SELECT s.path, NULL, CASE WHEN archived THEN 'deleted' WHEN body_hash IS NOT NULL AND (body_hash <> content_hash OR fm_hash <> frontmatter_hash) THEN 'conflict' ELSE 'modified' END,
                CASE WHEN NOT archived AND body_hash IS NOT NULL AND (body_hash <> content_hash OR fm_hash <> frontmatter_hash) THEN 'both' ELSE 'pull' END, NULL, last_edited
            FROM seen s LEFT JOIN hashes h ON h.path = s.path WHERE s.path NOT IN (SELECT path FROM diff2)""",
    "history": "SELECT event_id AS seq, 'note-' || user_id AS note_path, event_type AS action, ts, props AS details FROM events",
    "mkey": "SELECT note_path, page_id, trim(regexp_replace(lower(regexp_replace(regexp_extract(note_path, '[^/]*$'), '[.]md$', '')), '[^a-z0-9]+', ' ', 'g')) AS c FROM state WHERE page_id <> ''",
    "tkey": "SELECT DISTINCT target AS t, trim(regexp_replace(lower(regexp_replace(regexp_extract(target, '[^/]*$'), '[.]md$', '')), '[^a-z0-9]+', ' ', 'g')) AS k FROM edge",
    "scored": """SELECT t, note_path, page_id, CASE WHEN k = c THEN 4 WHEN starts_with(c, k) THEN 2 WHEN levenshtein(k, c) <= 3 THEN 1 ELSE 0 END AS score,
            CASE WHEN k = c THEN 0 WHEN starts_with(c, k) THEN strlen(c) - strlen(k) ELSE levenshtein(k, c) END AS distance FROM tkey, mkey""",
    "topk": "SELECT t AS target, note_path, page_id, score, distance, row_number() OVER (PARTITION BY t ORDER BY score DESC, distance, note_path) AS rank FROM scored WHERE score > 0",
}


def with_views(body: str, *names: str) -> str:
    """A query over the views named and those before them that they need."""
    needed: list[str] = []
    order = list(SQL)

    def need(name: str) -> None:
        import re

        for other in order[: order.index(name)]:
            if other not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b|,\s*{other}\b", SQL[name]):
                need(other)
        if name not in needed:
            needed.append(name)

    for n in names:
        need(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in sorted(needed, key=order.index)) + "\n" + body
