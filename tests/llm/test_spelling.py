import collections
import math
import random
import re
import zlib

import pytest

from marginalia.llm import spelling
from marginalia.llm.common import Scratch

from .helpers import awkward_rows, frame


def brute_counts(rows, least_length, least_count, drop):
    counts = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, factor=5):
    near = {a: [b for b in counts if b != a and abs(len(a) - len(b)) < 2 and one_edit(a, b)] for a in counts}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best is not None and counts[best] >= factor * counts[a] else None

    def root(a):
        while form[a] is not None:
            a = form[a]
        return a

    return sorted(((a, form[a], root(a), n, len(near[a]), counts.get(form[a])) for a, n in counts.items()), key=str)


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("alphabet", "longest", "size", "seed"), [("ab", 6, 90, 1), ("abc", 5, 200, 2), ("aéz", 4, 80, 3), ("abcdefgh", 4, 600, 4), ("a", 9, 9, 5)])
def test_pairs_forms_and_roots_equal_brute_force(spark, alphabet, longest, size, seed):
    """Short words over few letters are near each other everywhere, with runs of equal letters and words that begin others."""
    rng = random.Random(seed)
    counts = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))): 5 ** rng.randint(0, 6) + rng.randint(0, 1) for _ in range(size)}
    words = spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.variants(words)) == brute(counts)


def test_documents_with_every_awkward_row(spark):
    rows = awkward_rows() + [(5000 + i, "Spelling spelling SPELLING spelling Spelling speling Straße straße Écoleé écoleé ×÷×÷×÷ no-break_word", None, None, None) for i in range(400)]
    got = rows_of(spelling.spelling_variants(frame(spark, rows)))
    assert got == brute(brute_counts(rows, 6, 5, 199)) and any(r[1] for r in got)
    got = rows_of(spelling.spelling_variants(frame(spark, rows), least_length=3, least_count=2, drop_one_in=7))
    assert got == brute(brute_counts(rows, 3, 2, 7))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "", None, None, None), (2, "1234 --", None, None, None)], [(3, "lonely " * 5, None, None, None)]])
def test_no_words_no_rows(spark, rows):
    assert rows_of(spelling.spelling_variants(frame(spark, rows))) == brute(brute_counts(rows, 6, 5, 199))


def test_a_word_moves_only_at_light_edges(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 30))) for _ in range(1500)})
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    _, merged = spelling.one_edit_pairs(table, Scratch(spark, "spelling-test"))
    moves = collections.Counter(r["word"] for r in merged.collect())
    assert max(moves.values()) <= math.log2(len(words)) and sum(moves.values()) < sum(map(len, words)) / 4
