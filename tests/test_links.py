import itertools
import random

import pytest

from marginalia import schema
from marginalia.operators import links


def state_of(spark, pages):
    return spark.createDataFrame([(p, i, None, "h", "", None, None, None, None, "synced") for p, i in pages.items()], schema.SYNC_STATE)


def links_of(spark, rows):
    return spark.createDataFrame([(s, t, None, None, False) for s, t in rows], schema.LINKS)


PAGES = {"Note.md": "1", "work/Deep.md": "2", "work/deep/Deep.md": "3", "a_b.md": "4", "x/aXb.md": "5", "NoPage.md": None, "q.md#H.md": "6", "dir/Case.md": "7"}


@pytest.mark.parametrize(
    ("target", "page"),
    [("Note", "1"), ("Note#Part", "1"), ("Note.md", "1"), ("Deep", "2"), ("deep/Deep", "3"), ("work/Deep", "2"), ("NoPage", None), ("a_b", "4"), ("A Title", "2"), ("a title", None), ("case", "7"), ("CASE", "7"), ("missing", None), ("note", None)],
)
def test_resolve_arms(spark, target, page):
    state = state_of(spark, PAGES)
    aliases = spark.createDataFrame([("work/Deep.md", "A Title", "title"), ("NoPage.md", "Hidden", "title")], schema.PAGE_ALIASES)
    got = links.resolve(links_of(spark, [("s.md", target)]), state, aliases).collect()
    assert [r["page_id"] for r in got] == ([page] if page else [])


def test_wildcards_in_targets(spark):
    state = state_of(spark, {"x/aXb.md": "5"})
    none = spark.createDataFrame([], schema.PAGE_ALIASES)
    assert links.resolve(links_of(spark, [("s", "a_b"), ("s", "a%")]), state, none).count() == 2


def test_wildcards_equal_brute_force_without_a_nested_loop(spark):
    import re

    rng = random.Random(4)
    name = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    pages = {f"{name('ab', 2)}/{name('abC.é', 6)}.md": str(i) for i in range(120)} | {"x/100%.md": "p", "x/a\\\\b.md": "q", "top.md": "r"}
    targets = sorted({name("abC%_.é", 5) for _ in range(80)} | {"%", "%%", "_%", "%é%", "zzz%", "100%", "a\\\\%", "x/%"})
    state, none = state_of(spark, pages), spark.createDataFrame([], schema.PAGE_ALIASES)
    found = links.resolve(links_of(spark, [("s", t) for t in targets]), state, none)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

    def fits(t, path):
        t = t.removesuffix(".md")
        if path in (t, f"{t}.md"):
            return True
        like = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in f"%/{t.lower()}.md")
        return re.fullmatch(like, path.lower(), re.S) is not None

    want = {t: min((p for p in pages if fits(t, p)), default=None) for t in targets}
    assert {r["target"]: r["note_path"] for r in found.collect()} == {t: p for t, p in want.items() if p}


def test_registry_and_stats(spark):
    state = state_of(spark, {"T.md": "p"})
    none = spark.createDataFrame([], schema.PAGE_ALIASES)
    table = links_of(spark, [("a.md", "T"), ("b.md", "T"), ("c.md", "T"), ("c.md", "U")])
    assert links.register(spark.createDataFrame([("a.md", "T"), ("a.md", "T"), ("d.md", "T")], "source_path string, target string"), table).count() == 5
    done = links.resolve_all(table, state, none)
    assert [tuple(r) for r in links.link_stats(done).collect()] == [(4, 3, 1)]
    assert [tuple(r) for r in links.unresolved_by_source(done).collect()] == [("c.md", 1)]
    assert {r["source_path"] for r in links.backlinks(done, state).collect()} == {"a.md", "b.md", "c.md"}
    assert {r["source_path"]: r["any_resolved"] for r in links.any_resolved(done).collect()} == {"a.md": True, "b.md": True, "c.md": True}
    assert links.from_source(done, "c.md").count() == 2


def python_match(t, c, limit=3):
    import re

    key = lambda s: re.sub(r"[^a-z0-9]+", " ", s.rsplit("/", 1)[-1].removesuffix(".md").lower()).strip()
    t, c = key(t), key(c)
    if t == c:
        return 4, 0
    if c.startswith(t):
        return 2, len(c) - len(t)
    row = list(range(len(c) + 1))
    for i, a in enumerate(t, 1):
        row, old = [i], row
        for j, b in enumerate(c, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (a != b)))
    d = row[-1] if t and c else max(len(t), len(c))
    return (1, d) if d <= limit else (0, d)


def test_fuzzy_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12)))
    names = sorted({word() for _ in range(60)} | {"ServiceClass", "Architecture", "Notes", "a", "", "ab"})
    targets = [n[: rng.randint(0, len(n))] + rng.choice(["", "x"]) + n[rng.randint(0, len(n)) :] for n in names] + ["ServiceClas", "Architcture", "SrviceClass", "Noet", ""]
    pages = {f"d/{n}.md": str(i) for i, n in enumerate(names)}
    got = {(r["target"], r["note_path"]): (r["score"], r["distance"]) for r in links.fuzzy_matches(links_of(spark, [("s", t) for t in targets]), state_of(spark, pages)).collect()}
    want = {}
    for t, p in itertools.product(set(targets), pages):
        m = python_match(t, p)
        if m[0]:
            want[t, p] = m
    assert got == want


def test_topk_and_repair(spark):
    state = state_of(spark, {"work/ServiceClass.md": "1", "work/ServiceClasses.md": "2", "work/Architecture.md": "3", "MyNote.md": "4"})
    table = links_of(spark, [("s.md", "ServiceClas"), ("s.md", "Architcture"), ("s.md", "MyNot"), ("s.md", "nothing like it")])
    best = {r["target"]: r["note_path"] for r in links.fuzzy_topk(table, state, 1).collect()}
    assert best == {"ServiceClas": "work/ServiceClass.md", "Architcture": "work/Architecture.md", "MyNot": "MyNote.md"}
    assert {r["target_name"]: (r["new_path"], r["repaired"]) for r in links.repair(table, state).collect()}["MyNot"] == ("MyNote.md", False)
    none = spark.createDataFrame([], schema.PAGE_ALIASES)
    fuzzy = {r["target_name"]: (r["how"], r["target_path"], r["resolved"]) for r in links.resolve_all_fuzzy(table, state, none).collect()}
    assert fuzzy["MyNot"] == ("fuzzy", "MyNote.md", True) and fuzzy["nothing like it"] == (None, None, False)
    wide = {r["target"]: (r["page"], r["heading"], r["how"]) for r in links.resolve_extended(links_of(spark, [("s", "MyNot#H"), ("s", "MyNote^b")]), state, none).collect()}
    assert wide == {"MyNot#H": ("MyNot", "H", "fuzzy"), "MyNote^b": ("MyNote", "", "exact")}


@pytest.mark.parametrize("k", [1, 3])
def test_topk_equals_all_matches(spark, k):
    rng = random.Random(9)
    names = sorted({"".join(rng.choice("abc1 ") for _ in range(rng.randint(1, 9))).strip() for _ in range(80)} - {""})
    state = state_of(spark, {f"{d}/{n}.md": f"{d}{n}" for n in names for d in ("x", "y")})
    table = links_of(spark, [("s", n[:-1] + "z") for n in names] + [("s", n) for n in names[:20]] + [("s", ""), ("s", "no such name")])
    best = {}
    for r in links.fuzzy_matches(table, state).collect():
        best.setdefault(r["target"], []).append((-r["score"], r["distance"], r["note_path"]))
    want = {(t, i + 1, p) for t, rows in best.items() for i, (_, _, p) in enumerate(sorted(rows)[:k])}
    assert {(r["target"], r["rank"], r["note_path"]) for r in links.fuzzy_topk(table, state, k).collect()} == want
