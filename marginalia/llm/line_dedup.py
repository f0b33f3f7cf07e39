"""Line dedup over a suffix array of line-id sequences, built by distributed prefix doubling.

Lines become ids, and each document a sequence of ids. Only suffixes whose first line occurs twice or more can begin a
repeated run, so all others leave at once. Prefix doubling ranks the suffixes by their first line, then by the pair of ranks
one line apart (two lines), then two lines apart (four), until all ranks are unique; the unique ones leave each time.

The intervals of the suffix array with a longest common prefix of m lines are found from the deepest level back: at a level
of 2**j lines, suffixes of equal rank form an interval, and the suffixes of an interval of m lines that agree on the next
2**j form one of m + 2**j inside it. In its parent an interval is then one item, its first place, so there are fewer than
two items a suffix in all, whatever the runs' lengths, and every suffix is an item other than the first of one interval
only: the longest run that begins there and at an earlier place too.

An interval whose copies don't all follow the same line is a *maximal repeated run*. Runs of ``min_lines`` lines or of
``min_words`` words are worth deleting. The first place (by document id, then position) stays, and later copies go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"


def _sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, h, lines, words) per document; lines are 128-bit ids."""
    text = text_or_empty(text_col)
    lines = F.split(text, "\n")
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("h"), F.transform(lines, lambda x: F.unhex(F.md5(x))).alias("ids"), F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"))


def _left(column: str = "left") -> Column:
    """The line before all of a group's places, -1 if it isn't the same everywhere."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise(F.lit(-1).cast("long"))


def _ranked(df: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Order-preserving integer ranks of the distinct keys that occur twice or more, joined to their rows, with n, how often they
    occur, and later, whether the row is not the first."""
    names = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "pos")).alias("first")).where("n > 1")
    names = scratch.save(names.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return df.join(names, keys).withColumn("later", F.struct("d", "pos") != F.col("first")).drop("first")


def _at(column: str, steps: int) -> Column:
    """The column's value ``steps`` lines on in the same document, null if that line isn't among the rows."""
    return F.first(column).over(Window.partitionBy("d").orderBy("pos").rangeBetween(steps, steps))


class Runs:
    """The suffix array's levels and intervals over all rows of ``docs``.

    ``keys`` (d, doc, h) numbers the documents in order; ``items`` (fd, fp, m, d, pos, copies, left) are the intervals' items:
    an interval is known by its first place (fd, fp) and its common lines m.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, min_words: int = 50):
        self.scratch, self.min_lines, self.min_words = scratch, min_lines, min_words
        seqs = _sequences(docs, id_col, text_col).dropDuplicates(["doc", "h"]).orderBy("doc", "h").withColumn("d", F.monotonically_increasing_id())
        seqs = scratch.save(seqs, "sequences")
        self.keys = seqs.select("d", "doc", "h")
        places = seqs.select("d", F.posexplode(F.arrays_zip("ids", "words")).alias("pos", "line")).select("d", "pos", F.col("line.ids").alias("id"), F.col("line.words").cast("long").alias("words"))
        first = _ranked(places, ["id"], scratch).drop("id")
        self.lines = scratch.save(first.withColumn("left", F.coalesce(_at("rank", -1), F.lit(-1).cast("long"))), "level-0")
        self.levels = [self.lines.drop("words")]
        while not self.levels[-1].isEmpty():
            step = 1 << (len(self.levels) - 1)
            pairs = self.levels[-1].select("d", "pos", "left", F.col("rank").alias("a"), _at("rank", step).alias("b")).where("b is not null")
            self.levels.append(scratch.save(_ranked(pairs, ["a", "b"], scratch).drop("a", "b"), f"level-{len(self.levels)}"))
        self.levels.pop()
        self.items = self._intervals()

    def _roots(self, j: int) -> DataFrame:
        """Places of repeated runs of 2**j lines; of those that share twice as many only the first, for all of them."""
        here = self.levels[j]
        if j == 0 and self.min_lines > 1:  # single lines count by their words only
            here = here.join(self.lines.where(F.col("words") >= self.min_words).select("d", "pos"), ["d", "pos"], "left_semi")
        here = here.select("d", "pos", "rank", "left")
        if j + 1 < len(self.levels):
            deeper = self.levels[j + 1]
            left = deeper.groupBy("rank").agg(_left().alias("all_left"))
            known = deeper.select("d", "pos", "later", "n", F.col("rank").alias("deep"))
            firsts = known.where("not later").join(left.withColumnRenamed("rank", "deep"), "deep")
            here = here.join(known.where("later").select("d", "pos"), ["d", "pos"], "left_anti").join(firsts.select("d", "pos", "n", "all_left"), ["d", "pos"], "left")
            here = here.select("d", "pos", "rank", F.coalesce("all_left", "left").alias("left"), F.coalesce("n", F.lit(1).cast("long")).alias("copies"))
        else:
            here = here.withColumn("copies", F.lit(1).cast("long"))
        none = F.lit(-1).cast("long")
        return here.select(none.alias("fd"), none.cast("int").alias("fp"), F.lit(0).alias("m"), "d", "pos", "copies", "left", "rank")

    def _intervals(self) -> DataFrame:
        names = ["fd", "fp", "m", "d", "pos", "copies", "left"]
        items = None
        for j in range(len(self.levels) - 1, -1, -1):
            step = 1 << j
            found = self._roots(j)
            if items is not None:
                ahead = self.levels[j].select(F.col("d").alias("d2"), F.col("pos").alias("p2"), "rank")
                known = items.join(ahead, (F.col("d") == F.col("d2")) & (F.col("pos") + F.col("m") == F.col("p2")), "left")
                found = found.unionByName(known.select(*names, "rank"))
            found = self.scratch.save(found, "found")
            inner = found.where("rank is not null").groupBy("fd", "fp", "m", "rank").agg(F.min(F.struct("d", "pos")).alias("first"), F.count(F.lit(1)).alias("k"), F.sum("copies").alias("all"), _left().alias("all_left"))
            # Written, so that the join has an exchange on both sides and a hot interval can be split.
            inner = self.scratch.save(inner.where("k > 1").drop("k"), "inner")
            joined = found.join(inner, ["fd", "fp", "m", "rank"], "left")
            deeper = joined.where("first is not null").select(F.col("first.d").alias("fd"), F.col("first.pos").alias("fp"), (F.col("m") + step).alias("m"), "d", "pos", "copies", "left")
            stay = joined.where("first is null and m > 0").select(*names)
            stands = inner.where("m > 0").select("fd", "fp", "m", F.col("first.d").alias("d"), F.col("first.pos").alias("pos"), F.col("all").alias("copies"), F.col("all_left").alias("left"))
            past, items = items, self.scratch.save(deeper.unionByName(stay).unionByName(stands), "items")
            for table in (found, inner, past):
                self.scratch.drop(table)
        if items is None:
            none = F.lit(None)
            items = self.lines.where("false").select(F.col("d").alias("fd"), F.col("pos").alias("fp"), F.col("pos").alias("m"), "d", "pos", none.cast("long").alias("copies"), "left")
        return items

    def _worth(self, runs: DataFrame) -> DataFrame:
        """Of ``runs`` (m, d, pos) those of enough lines, or of enough words."""
        kept = runs.where(F.col("m") >= self.min_lines)
        for size in range(1, self.min_lines):
            ahead = F.sum("words").over(Window.partitionBy("d").orderBy("pos").rangeBetween(0, size - 1))
            wordy = self.lines.select("d", "pos", ahead.alias("w")).where(F.col("w") >= self.min_words).select("d", "pos")
            kept = kept.unionByName(runs.where(F.col("m") == size).join(wordy, ["d", "pos"], "left_semi"))
        return kept

    def maximal(self) -> DataFrame:
        """Maximal repeated runs worth deleting: lines, copies, doc and start of the first."""
        runs = self.items.groupBy("fd", "fp", "m").agg(F.count(F.lit(1)).alias("k"), F.sum("copies").alias("copies"), _left().alias("left")).where("k > 1 and left = -1")
        runs = self._worth(runs.select("m", F.col("fd").alias("d"), F.col("fp").alias("pos"), "copies"))
        return runs.join(self.keys, "d").select(F.col("m").alias("lines"), "copies", "doc", F.col("pos").alias("start"))

    def later_copies(self) -> DataFrame:
        """(doc, h, runs) of documents with lines to delete; runs: array of start, end (exclusive), in order and apart."""
        later = self._worth(self.items.where("d <> fd or pos <> fp"))
        # A copy that overlaps the first one keeps the lines they share.
        start = F.when(F.col("d") == F.col("fd"), F.greatest("pos", F.col("fp") + F.col("m"))).otherwise(F.col("pos"))
        gone = later.select("d", start.alias("start"), (F.col("pos") + F.col("m")).alias("end")).where("start < end")
        # Stretches of a document merge where they touch; they are fewer than its lines.
        order = Window.partitionBy("d").orderBy("start", "end")
        reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        gone = gone.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
        gone = gone.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        gone = gone.groupBy("d", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        gone = gone.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
        return gone.join(self.keys, "d").select("doc", "h", "runs")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """Per row of ``docs``: its id, n_lines, removed_lines, runs ("start-end" line numbers from 0, end exclusive, or empty) and clean_text.

    At every place, the longest run that begins there and at an earlier place goes if it is long enough, but for lines that lie
    in the earliest copy of that run: ``a b a b a b`` becomes ``a b a b``, five equal lines become three. So every line that
    goes still stands at an earlier place. Lines of a first copy may themselves be part of a later copy of another run.

    Null text counts as empty: one empty line. Null ids sort first, so their lines stay before others'. Rows of equal id and
    text are one document and come out alike. An empty table gives an empty one. Only the two named columns are read.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    runs = Runs(docs, scratch, id_col, text_col, min_lines, min_words).later_copies()
    runs = scratch.save(runs.select(F.col("doc").alias("__doc"), F.col("h").alias("__h"), F.col("runs").alias("__runs")), "runs")
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col), text.alias("text"), F.xxhash64(text).alias("h"))
    # Documents meet their runs by a sort-merge join at every size; runs grow with the documents.
    rows = rows.join(runs.hint("merge"), F.col(id_col).eqNullSafe(F.col("__doc")) & (F.col("h") == F.col("__h")), "left")
    lines = F.split("text", "\n")
    # What lies between the runs.
    ends, starts = F.concat(F.array(F.lit(0)), F.col("__runs.end")), F.concat(F.col("__runs.start"), F.array(F.size(lines)))
    between = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"]))
    clean = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(between), "\n"))
    removed = F.coalesce(F.aggregate("__runs", F.lit(0), lambda acc, r: acc + r["end"] - r["start"]), F.lit(0)).cast("long")
    shown = F.coalesce(F.array_join(F.transform("__runs", lambda r: F.concat_ws("-", r["start"], r["end"])), ","), F.lit(""))
    return rows.select(id_col, F.size(lines).cast("long").alias("n_lines"), removed.alias("removed_lines"), shown.alias("runs"), clean.alias("clean_text"))
