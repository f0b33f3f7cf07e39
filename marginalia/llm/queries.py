"""The registered queries of the training-data operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, embedding_dedup, exact_dedup, html_text, line_dedup, mixing, quality_cnn, quality_rules, sharding, simhash, spelling, warc
from .common import Scratch, input_table

BPE_RANKS = "byte_bpe_50k.tiktoken"


def op1_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives and reads them back: type, length and digest of each page's payload."""
    scratch = Scratch(spark, "warc")
    path = scratch.path("archive")
    warc.write_warc(input_table(spark, sf_dir, "pages"), path, scratch)
    read = warc.read_warc(spark, path, scratch)
    response = F.col("record_type") == "response"
    digest = F.when(response, F.sha2("payload", 256)).otherwise(F.col("digest"))
    size = F.when(response, F.octet_length("payload")).otherwise(F.col("stated_bytes")).cast("long")
    return read.select(F.col("record_id").cast("long").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the component of each under links of at most 2 differing bits."""
    return simhash.near_duplicates(input_table(spark, sf_dir, "documents"))


def op3_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays of each group of equal texts, for every document."""
    return exact_dedup.exact_duplicates(input_table(spark, sf_dir, "documents"))


def op4_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of equal row counts that keep equal texts together."""
    return sharding.shard_documents(input_table(spark, sf_dir, "documents"), 16)


def op5_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(input_table(spark, sf_dir, "pages"))


def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, sources weighing 5, 2, 1 in turn."""
    mixed = mixing.mix(input_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of three lines, or of fifty words, deleted from all documents but the first that holds them."""
    clean = line_dedup.dedup_lines(input_table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "removed_lines", "runs", F.sha2("clean_text", 256).alias("clean_sha256"))


def op8_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of all rules for every document."""
    return quality_rules.apply_rules(input_table(spark, sf_dir, "documents")).drop("rejected_by")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the text decoded from them."""
    return bpe.encode_documents(input_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document by a network that learns from at most 4000 labelled rows outside the held-out third."""
    docs = input_table(spark, sf_dir, "documents")
    net = quality_cnn.train(quality_cnn.training_rows(docs, input_table(spark, sf_dir, "labels")))
    return quality_cnn.score_documents(docs, net).select("doc_id", quality_cnn.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors of 64 components after ten rounds, with squared distances and inertias."""
    return clustering.cluster(input_table(spark, sf_dir, "embeddings"))


def op12_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every vector at a cosine of 0.9 or more, and the component it is in."""
    return embedding_dedup.near_vectors(input_table(spark, sf_dir, "embeddings"))


def op13_errata_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, near words, and the form that a rare word is probably meant to be."""
    return spelling.spelling_variants(input_table(spark, sf_dir, "documents"))


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds of ``op11_hamerly``, written out one after the other."""

    def assigned(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (SELECT r, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (
            SELECT r, c, list_sum(list_transform(list_zip(v.q, c{n}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{n}) GROUP BY r)"""

    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < 131072)) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS c, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT {k}))",
        assigned(0),
    ]
    for n in range(1, rounds + 1):
        steps.append(f"""c{n} AS MATERIALIZED (SELECT c, coalesce(m.q, c{n - 1}.q) AS q FROM c{n - 1} LEFT JOIN (
            SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS q FROM (
                SELECT c, i, sum(q[i]) AS s, count(*) AS n FROM a{n - 1} JOIN v USING (r), (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i) GROUP BY c) m USING (c))""")
        steps.append(assigned(n))
    return "WITH " + ",\n".join(steps) + f"""
        SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_chain": op1_warc_chain,
    "op2_simhash": op2_simhash,
    "op3_block_naming": op3_block_naming,
    "op4_label_propagation": op4_label_propagation,
    "op5_tag_ratio": op5_tag_ratio,
    "op6_cube_mix": op6_cube_mix,
    "op7_line_runs": op7_line_runs,
    "op8_rule_cascade": op8_rule_cascade,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality_cnn": op10_quality_cnn,
    "op11_hamerly": op11_hamerly,
    "op12_itq": op12_itq,
    "op13_errata_trie": op13_errata_trie,
}

ORACLE: dict[str, str] = {
    "op1_warc_chain": """
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest,
                     min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
    """,
    "op3_block_naming": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_rule_cascade": r"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
        g AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
        rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
        line AS (SELECT r, l FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
        dup AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS d FROM line GROUP BY r),
        f AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(d, 0) AS n_dup_lines,
                     coalesce(rep.n, 0) AS n_repeat_words, coalesce(dup.n, 0) AS n_lines,
                     length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS capitals
              FROM t JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 20 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines
                    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * capitals > letters) AS kept
        FROM b
    """,
    "op11_hamerly": _clusters_sql(),
    "op13_errata_trie": r"""
        WITH RECURSIVE poly AS (SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) x(i))),
        run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents),
        same AS (SELECT doc_id, run, count(*) AS n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS b FROM run GROUP BY doc_id, run),
        crc AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(b) // 2), lambda i: ('0x' || b[2 * i + 1:2 * i + 2])::BIGINT)),
                    lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS h FROM same, poly),
        cut AS (SELECT n, CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM crc),
        words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        gap AS MATERIALIZED (SELECT word, n, i, word[1:i] || word[i + 2:] AS k FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        longer AS (SELECT DISTINCT gap.word, gap.n, words.word AS other, words.n AS other_n FROM gap JOIN words ON k = words.word),
        near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gap a JOIN gap b USING (i, k) WHERE a.word <> b.word
            UNION ALL FROM longer UNION ALL SELECT other, other_n, word, n FROM longer),
        best AS (SELECT word, count(*) AS n_near, arg_min(other, {'m': -other_n, 'w': other}) AS other, max(other_n) AS other_n FROM near GROUP BY word),
        forms AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
        walk AS (SELECT word, word AS root, form AS nxt FROM forms UNION ALL SELECT walk.word, nxt, forms.form FROM walk JOIN forms ON forms.word = nxt)
        SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN walk ON walk.word = forms.word AND nxt IS NULL
    """,
}
