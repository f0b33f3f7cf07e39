import random
import re

import pytest

from marginalia.llm import line_dedup
from marginalia.llm.common import Scratch

from .helpers import awkward_rows, frame


def lcp(x, p, y, q):
    n = 0
    while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
        n += 1
    return n


def brute(rows, min_lines, min_words):
    """All pairs of places: at each the longest run that also begins earlier goes, but for what lies in its earliest copy."""
    docs = {}
    for r in rows:
        docs[(r[0], r[1] or "")] = (r[1] or "").split("\n")
    order = sorted(docs, key=lambda k: (k[0] is not None, k[0] or 0))
    by_line = {}
    for k in order:
        for p in range(len(docs[k])):
            by_line.setdefault(docs[k][p], []).append((k, p))
    gone = {k: set() for k in docs}
    for k in order:
        for p in range(len(docs[k])):
            earlier = by_line[docs[k][p]]
            lengths = [(lcp(docs[k], p, docs[q], o), q, o) for q, o in earlier[: earlier.index((k, p))]]
            size = max((n for n, _, _ in lengths), default=0)
            words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in docs[k][p : p + size])
            if size >= min_lines or (size and words >= min_words):
                _, q, o = next(x for x in lengths if x[0] >= size)
                gone[k].update(x for x in range(p, p + size) if q != k or x >= o + size)
    return gone, docs


def brute_maximal(rows, min_lines, min_words):
    """(lines, copies, first document, start) of all repeated runs that no line before or after goes on everywhere."""
    docs = {}
    for r in rows:
        docs[(r[0], r[1] or "")] = (r[1] or "").split("\n")
    places = {}
    for k in sorted(docs, key=lambda k: (k[0] is not None, k[0] or 0)):
        for p in range(len(docs[k])):
            for e in range(p + 1, len(docs[k]) + 1):
                places.setdefault(tuple(docs[k][p:e]), []).append((k, p))
    out = []
    for run, at in places.items():
        if len(at) < 2 or not (len(run) >= min_lines or sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in run) >= min_words):
            continue
        before = {docs[k][p - 1] if p else (k, "start") for k, p in at}
        after = {docs[k][p + len(run)] if p + len(run) < len(docs[k]) else (k, "end") for k, p in at}
        if len(before) > 1 and len(after) > 1:
            out.append(str((len(run), len(at), at[0][0][0], at[0][1])))
    return sorted(out)


@pytest.mark.parametrize(("min_lines", "min_words"), [(3, 50), (4, 6), (5, 9), (2, 10**9), (1, 1)])
def test_equals_brute_force(spark, min_lines, min_words):
    rng = random.Random(min_lines)
    lines = ["a b c", "d", "e f", "", "g", "w " * 60]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))), "s", "", "") for i in range(25)]
    block = "\n".join(f"line {k} of a passage" for k in range(14))
    rows += [(100 + i, f"own {i}\n{block}\nend {i}", "s", "", "") for i in range(4)]
    rows += [r for r in awkward_rows() if len(r[1] or "") < 3000 and r[0] is not None and r not in rows]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows = [(i, *r[1:]) for i, r in enumerate(rows)] + [(None, "a b c\nd\ne f", None, None, None)]
    rows.append(rows[3])
    gone, docs = brute(rows, min_lines, min_words)
    got = line_dedup.dedup_lines(frame(spark, rows), min_lines=min_lines, min_words=min_words).collect()
    assert len(got) == len(rows)
    want = sorted(str((r[0], len(docs[(r[0], r[1] or "")]), len(gone[(r[0], r[1] or "")]), "\n".join(x for i, x in enumerate(docs[(r[0], r[1] or "")]) if i not in gone[(r[0], r[1] or "")]))) for r in rows)
    assert sorted(str((r["doc_id"], r["n_lines"], r["removed_lines"], r["clean_text"])) for r in got) == want


    runs = line_dedup.Runs(frame(spark, rows), Scratch(spark, "test-runs"), min_lines=min_lines, min_words=min_words).maximal().collect()
    assert sorted(str(tuple(r)) for r in runs) == brute_maximal(rows, min_lines, min_words)


def test_overlapping_copies_keep_a_full_one(spark):
    rows = [(1, "a\nb\na\nb\na\nb", "", "", ""), (2, "z\nz\nz\nz\nz", "", "", ""), (3, "a\nb\na\nb", "", "", "")]
    got = {r["doc_id"]: r["clean_text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: "a\nb\na\nb", 2: "z\nz\nz", 3: ""}


def test_long_document(spark):
    """Twenty thousand lines, twice: as many runs as would take minutes at the square of lines and runs."""
    lines = [f"line {i % 7919} {i // 5}" for i in range(19_998)]
    odd = [x if i % 9 else f"other {i}" for i, x in enumerate(lines)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, [(1, "\n".join(lines), "", "", ""), (2, "\n".join(odd), "", "", "")])).collect()}
    assert got[1]["removed_lines"] == 0 and got[2]["clean_text"] == "\n".join(x for x in odd if x.startswith("other"))


def test_empty_table(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
