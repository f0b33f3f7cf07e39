"""Spelling variants by an errata trie over a heavy-path decomposition, as joins.

The words make a trie: its nodes are their prefixes, and a node's size is the number of words under it. The edge to the largest
child of a node is heavy, all others are light, as is the end of a word at a node that has children. A word goes down at most
log2(words) light edges, since each leaves at most half of the words.

Merging small into large means that a word moves only where it leaves a heavy path. At each light edge, from node ``x`` by
character ``c`` to the rest ``s`` (the word is ``x c s``), with heavy child ``h``, it is looked up at three places:

* ``x h s``: its character replaced by the heavy one;
* ``x s``: its character skipped (if ``s`` doesn't begin with ``c``, so that a run of one character loses its last one);
* ``x h c s``: the heavy character skipped in the other word.

Light words also meet each other: those with equal ``x`` and ``s`` are one edit apart, whatever their ``c``. Where what a word
becomes ends at another word's end, the two are one edit apart, and every such pair is found in exactly one way: the paths of two
words part at one node, where one of the two edges is light. (An edge of a run of equal characters parts at the run's end.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No letter, so it stands for any character in the names of merged nodes.
ANY = "*"


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, drop_one_in: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): letter runs, A-Z lower-cased, of whole texts; every ``drop_one_in``-th by hash loses one character first.

    A null id is written as nothing in the hash.
    """
    # Runs too short to give a word are not taken; a run that is long enough is matched from its first letter on.
    runs = F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(f"[a-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    found = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    # In steps, so that each value is computed once.
    hashed = found.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def light_edges(words: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, heavy) of light nodes: the heavy character of their parent; and (node, heavy) of all nodes with children."""
    size = F.length("word")
    nodes = words.select(F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: F.substr("word", F.lit(1), i))).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("words"))
    last = F.length("node")
    nodes = nodes.select("node", "words", F.substr("node", F.lit(1), last - 1).alias("parent"), F.substr("node", last).alias("c"))
    nodes = scratch.save(nodes, "nodes")
    # The largest child; of equal ones that of the smallest character.
    heavy = scratch.save(nodes.groupBy("parent").agg(F.min(F.struct((-F.col("words")).alias("m"), "c")).getField("c").alias("heavy")), "heavy")
    light = nodes.join(heavy, "parent").where("c <> heavy").select("node", "heavy")
    return scratch.save(light, "light"), heavy.withColumnRenamed("parent", "node")


def one_edit_pairs(words: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b) of words one edit apart at least one of which moved onto the other's path, each pair once; and (word, merged) of light
    words in merged nodes, which are one edit apart wherever ``merged`` is equal."""
    light, heavy = light_edges(words, scratch)
    whole = F.col("word")
    down = words.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length(whole)), lambda i: F.substr(whole, F.lit(1), i))).alias("node"))
    at = F.length("node")
    moved = down.join(light, "node").select("word", "heavy", F.substr("node", F.lit(1), at - 1).alias("x"), F.substr("node", at).alias("c"), F.substr("word", at + 1).alias("s"))
    moved = scratch.save(moved, "moved")
    asked = F.array(
        F.concat("x", "heavy", "s"),
        F.when(~F.col("s").startswith(F.col("c")), F.concat("x", "s")),
        F.concat("x", "heavy", "c", "s"),
    )
    # A word that ends where others go on has a light end: only the heavy character can be skipped.
    ends = words.join(heavy, F.col("word") == F.col("node")).select("word", F.concat("word", "heavy").alias("other"))
    lookups = moved.select("word", F.explode(asked).alias("other")).where("other is not null").unionByName(ends)
    pairs = lookups.join(words.select(F.col("word").alias("other")), "other").select(F.col("word").alias("a"), F.col("other").alias("b"))
    return scratch.save(pairs, "pairs"), moved.select("word", F.concat("x", F.lit(ANY), "s").alias("merged"))


def _best(n: Column | str, word: Column | str) -> Column:
    """Least of these: the largest n, then the smallest word in code-point order."""
    return F.struct((-F.col(n)).alias("m"), F.col(word).alias("w"))


def variants(words: DataFrame, factor: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n); see ``spelling_variants``."""
    scratch = scratch or Scratch(words.sparkSession, "spelling")
    pairs, merged = one_edit_pairs(words, scratch)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = words.select(F.col("word").alias("b"), "n")
    near = both.join(counts, "b").groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("k"), F.min(_best("n", "b")).alias("best"))
    # Words in a merged node have different characters at one place, so there are no more of them than characters.
    met = merged.join(words, "word")
    group = Window.partitionBy("merged")
    met = met.withColumns({"k": F.count(F.lit(1)).over(group) - 1, "r": F.row_number().over(group.orderBy(F.desc("n"), "word"))})
    first, second = (F.min(F.when(F.col("r") == i, _best("n", "word"))).over(group) for i in (1, 2))
    met = met.select("word", "k", F.when(F.col("r") == 1, second).otherwise(first).alias("best")).where("k > 0")
    near = near.unionByName(met).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    out = words.join(near, "word", "left").withColumn("far", F.coalesce(-F.col("best.m") >= factor * F.col("n"), F.lit(False)))
    out = scratch.save(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("far"), F.col("best.w")).alias("form"), F.when(F.col("far"), -F.col("best.m")).alias("form_n")), "forms")
    # Each step multiplies n by the factor at least, so paths are short, and halve with each round.
    hops = scratch.save(out.where("form is not null").select("word", F.col("form").alias("root")), "hops")
    while True:
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("later"))
        step = scratch.save(hops.join(onward, "root", "left").select("word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("went")), "hops")
        scratch.drop(hops)
        hops = step.select("word", "root")
        hops._scratch_path = step._scratch_path
        if step.where("went").isEmpty():
            break
    return out.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, factor: int = 5, drop_one_in: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of ``word_counts``: word, form (its near word of largest n, the smallest in code-point order of equals, if that
    n is ``factor`` times the word's at least, else null), root (the last of the forms that follow each other from the word), n,
    n_near (how many words are one inserted, deleted or replaced code point away), form_n.

    Null and empty texts have no words; no words, no rows. Rows that repeat count as often as they come. Only the two named
    columns are read.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(word_counts(docs, least_length, least_count, drop_one_in, id_col, text_col), "words")
    return variants(words, factor, scratch)
