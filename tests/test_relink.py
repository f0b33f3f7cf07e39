"""The second pass of a push."""

import pytest
from pyspark.sql import functions as F

from marginalia import schema
from marginalia.operators import links as lk
from marginalia.operators import relink

from .test_links import state_of


def table(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize(("path", "title"), [("a/b/New Name.md", "New Name"), ("v1.2.md", "v1.2"), ("plain", "plain"), ("a.b/c", "c"), (".md", "")])
def test_titles_from_paths(spark, path, title):
    moves = table(spark, [("old.md", path, "p1"), ("x.md", "y.md", ""), ("x.md", "z.md", None)], "old_path string, path string, page_id string")
    assert [tuple(r) for r in relink.rename_titles(moves).collect()] == [("p1", title)]


def test_only_pages_with_changed_links(spark):
    state = state_of(spark, {"a.md": "pa", "b.md": "pb", "new/moved.md": "pm", "t.md": "pt", "nopage.md": None})
    rows = [
        ("a.md", "Fresh", None, None, False), ("a.md", "t", None, "pt", True),  # one link newly leads somewhere
        ("b.md", "moved", None, "pm", True), ("b.md", "Alias", None, None, False),  # one to a renamed page, one by an alias of a new one
        ("old/moved.md", "Fresh", None, None, False),  # the source itself moved
        ("nopage.md", "Fresh", None, None, False),  # nothing to update
        ("t.md", "missing", None, None, False), ("t.md", "a", None, "pa", True),  # nothing changed
    ]
    links = table(spark, rows, schema.LINKS)
    created = table(spark, [("x/Fresh.md", "pf")], "note_path string, page_id string")
    aliases = table(spark, [("x/Fresh.md", "Alias", "title"), ("a.md", "missing", "title")][:1], schema.PAGE_ALIASES)
    moves = table(spark, [("old/moved.md", "new/moved.md", "pm")], "old_path string, path string, page_id string")
    got = relink.pages_to_render(links, created, moves, relink.with_pages(state, created), aliases)
    assert {tuple(r) for r in got.collect()} == {("a.md", "pa", 1, 0), ("b.md", "pb", 1, 1), ("new/moved.md", "pm", 1, 0)}
    none = created.limit(0)
    assert relink.pages_to_render(links, none, moves.limit(0), state, aliases).count() == 0


def test_pages_of_a_first_pass_enter_the_state(spark):
    state = state_of(spark, {"a.md": None, "b.md": "pb"})
    after = relink.with_pages(state, table(spark, [("a.md", "pa"), ("c.md", "pc")], "note_path string, page_id string"))
    assert {(r["note_path"], r["page_id"], r["status"]) for r in after.collect()} == {("a.md", "pa", "synced"), ("b.md", "pb", "synced"), ("c.md", "pc", "synced")}


def test_what_several_steps_read_is_made_once(spark):
    """Each link, each move and each page is made once, however many steps look at it."""
    made = spark.sparkContext.accumulator(0)

    def counted(value):
        made.add(1)
        return value

    once = lambda df, name: df.withColumn(name, F.udf(counted, "string")(name))
    links = table(spark, [("a.md", "Fresh", None, None, False), ("a.md", "t", None, "pt", True), ("b.md", "x/y", None, None, False)], schema.LINKS)
    created = table(spark, [("x/Fresh.md", "pf")], "note_path string, page_id string")
    aliases = table(spark, [("x/Fresh.md", "Alias", "title")], schema.PAGE_ALIASES)
    moves = table(spark, [("old.md", "t.md", "pt")], "old_path string, path string, page_id string")
    state = state_of(spark, {"a.md": "pa", "t.md": "pt"})
    assert relink.pages_to_render(once(links, "source_path"), created, once(moves, "path"), state, aliases).count() == 1
    assert made.value == 4
    before = made.value
    assert lk.resolve(links, once(state, "note_path"), aliases).count() == 1
    assert made.value - before == 2


@pytest.mark.parametrize("pattern", ["Fre_h", "F%h", "%", "______"])
def test_wildcards_alone_and_beside_plain_names(spark, pattern):
    """The steps for wildcards are left out only where there are none."""
    state = state_of(spark, {"x/Fresh.md": "pf", "t.md": "pt"})
    aliases = table(spark, [("t.md", "Alias", "title")], schema.PAGE_ALIASES)
    got = lk.resolve(table(spark, [("Alias",), (pattern,), ("t",)], "target_name string"), state, aliases)
    want = {"Fre_h": "pf", "F%h": "pf", "%": "pf"}
    assert {r["target"]: r["page_id"] for r in got.collect()} == {"Alias": "pt", "t": "pt"} | ({pattern: want[pattern]} if pattern in want else {})
