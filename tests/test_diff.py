import datetime as dt

import pytest

from marginalia import schema
from marginalia.operators import diff

T0 = dt.datetime(2024, 1, 1)


def hashes(spark, notes):
    df = spark.createDataFrame([(p, c, T0) for p, c in notes.items()], "path string, content string, mtime timestamp")
    return diff.fingerprints(df)


def state_of(spark, rows):
    """rows: path -> (content the state remembers, options)."""
    contents = hashes(spark, {p: c for p, (c, _) in rows.items()})
    by = {r["note_path"]: r for r in contents.collect()}
    out = []
    for p, (_, o) in rows.items():
        h = by[p]
        body = h["full_hash"] if o.get("full") else h["content_hash"]
        out.append((p, o.get("page", f"page-{p}"), None, body, "" if o.get("full") else h["frontmatter_hash"], None, o.get("remote", T0), o.get("remote", T0), None, o.get("status", "synced")))
    return spark.createDataFrame(out, schema.SYNC_STATE)


def remote_of(spark, rows):
    return spark.createDataFrame([(f"page-{p}", t, False if not a else True, e) for p, t, a, e in rows], "page_id string, last_edited timestamp, archived boolean, error string")


def run(df):
    return {r["path"]: (r["type"], r["direction"]) for r in df.collect()}


FM = "---\ntitle: A\n---\n"


def test_local_changes(spark):
    notes = hashes(spark, {"new-name.md": "moved text", "new-note.md": "new", "existing.md": "changed", "fm.md": "---\ntitle: B\n---\nbody", "body.md": FM + "other body", "same.md": FM + "same", "space.md": "a  \n\n\n\nb\n", "empty.md": "", "clash.md": "x2"})
    state = state_of(spark, {"old-name.md": ("moved text", {"full": True}), "deleted.md": ("gone", {}), "pending.md": ("gone", {"status": "pending"}), "nopage.md": ("gone", {"page": None}), "existing.md": ("was", {}), "fm.md": (FM + "body", {}), "body.md": (FM + "body", {}), "same.md": (FM + "same", {}), "space.md": ("a\n\nb", {}), "clash.md": ("x", {"status": "conflict"})})
    changes = diff.local_changes(notes, state)
    assert run(changes) == {"new-name.md": ("renamed", "push"), "new-note.md": ("created", "push"), "empty.md": ("created", "push"), "existing.md": ("modified", "push"), "fm.md": ("modified", "push"), "body.md": ("modified", "push"), "clash.md": ("conflict", "both"), "deleted.md": ("deleted", "push")}
    rows = {r["path"]: r for r in changes.collect()}
    assert rows["fm.md"]["frontmatter_only"] and not rows["body.md"]["frontmatter_only"]
    assert rows["new-name.md"]["old_path"] == "old-name.md" and rows["new-name.md"]["page_id"] == "page-old-name.md"


def test_renames_are_one_to_one(spark):
    notes = hashes(spark, {"n1.md": "t", "n2.md": "t", "n3.md": "t"})
    state = state_of(spark, {"o1.md": ("t", {}), "o2.md": ("t", {})})
    pairs = {(r["old_path"], r["path"]) for r in diff.renames(notes, state).collect()}
    assert pairs == {("o1.md", "n1.md"), ("o2.md", "n2.md")}
    empty = diff.renames(hashes(spark, {"e.md": ""}), state_of(spark, {"f.md": (FM, {})}))
    assert [(r["old_path"], r["path"]) for r in empty.collect()] == [("f.md", "e.md")]


@pytest.mark.parametrize(
    ("note", "edited", "archived", "error", "want"),
    [("changed", 0, False, None, ("modified", "push")), ("same", 3600, False, None, ("modified", "pull")), ("changed", 3600, False, None, ("conflict", "both")), ("same", 0, True, None, ("deleted", "pull")), ("changed", 0, True, None, ("conflict", "both")), ("same", 0.5, False, None, None), ("same", 3600, False, "boom", None), (None, 3600, False, None, ("deleted", "push"))],
)
def test_all_changes(spark, note, edited, archived, error, want):
    notes = hashes(spark, {"a.md": note} if note else {"z.md": "z"})
    state = state_of(spark, {"a.md": ("same", {})})
    got = run(diff.all_changes(notes, state, remote_of(spark, [("a.md", T0 + dt.timedelta(seconds=edited), archived, error)])))
    if note is None:
        want = ("conflict", "both")  # deleted here, edited there
    assert got.get("a.md") == want


def test_plans(spark):
    notes = hashes(spark, {"a.md": "mine", "b.md": "same"})
    state = state_of(spark, {"a.md": ("same", {}), "b.md": ("same", {}), "c.md": ("same", {"status": "pending", "page": None})})
    remote = remote_of(spark, [("a.md", T0 + dt.timedelta(hours=1), False, None), ("b.md", T0 + dt.timedelta(hours=1), False, None)])
    for strategy, action in [("ours", "push"), ("theirs", "pull"), ("newer", "pull"), ("manual", "conflict")]:
        got = {r["path"]: r["action"] for r in diff.sync_plan(notes, state, remote, strategy).collect()}
        assert got == {"a.md": action, "b.md": "pull"}
    assert {r["path"]: r["type"] for r in diff.push_candidates(notes, state).collect()} == {"a.md": "modified", "c.md": "created"}
    assert {r["path"]: r["action"] for r in diff.pull_candidates(state, remote).collect()} == {"a.md": "pull", "b.md": "pull"}
    assert {r["path"]: r["action"] for r in diff.poll_conflicts(notes, state, remote).collect()} == {"a.md": "conflict", "b.md": "pull"}
    one = diff.status_summary(diff.all_changes(notes, state, remote), state, spark.createDataFrame([("a", "b", None, None, False)], schema.LINKS)).collect()[0]
    assert (one["new"], one["conflicts"], one["to_pull"], one["pending"], one["unresolved_links"]) == (1, 1, 1, 1, 1)


def test_empty_sides(spark):
    none = spark.createDataFrame([], schema.SYNC_STATE)
    notes = hashes(spark, {"a.md": "x"})
    assert run(diff.local_changes(notes, none)) == {"a.md": ("created", "push")}
    assert diff.local_changes(notes.limit(0), none).count() == 0
    assert not diff.has_conflicts(diff.local_changes(notes, none)).collect()[0][0]
