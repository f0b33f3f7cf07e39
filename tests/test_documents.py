import pytest
from pyspark.sql import functions as F

from marginalia.functions import markdown as md
from marginalia.functions import richtext
from marginalia.operators import blocks, embeds, extract, properties

NOTE = """---
title: My Note
tags: [one, two]
aliases: Other
---
# Head #no

Text with [[A/B.md#h^b|al]] #inline-tag and `[[code]]`.

```
[[fenced]] #not
```

![[img.png|100x200]] #second/tag
second line [[C]]
"""


def test_parse_note(spark):
    texts = {"n": NOTE, "broken": "---\na: [1\n---\nx [[y]]", "open": "---\nopen"}
    df = spark.createDataFrame(list(texts.items()), "path string, content string")
    n = {r["path"]: r for r in extract.parse_notes(df).drop("frontmatter").collect()}
    assert [tuple(x) for x in n["n"]["links"]] == [("A/B.md", "al", "h", "b", 3), ("C", "", "", "", 9)]
    assert [(x["target"], x["alias"], x["line"]) for x in n["n"]["embeds"]] == [("img.png", "100x200", 9)]
    assert n["n"]["tags"] == ["no", "inline-tag", "second/tag", "one", "two"]
    assert n["broken"]["error"] and n["broken"]["links"] == [] and n["broken"]["body"] == texts["broken"]
    lenient = {r["path"]: r for r in extract.parse_notes(df, lenient=True).drop("frontmatter").collect()}
    assert lenient["broken"]["error"] is None and lenient["broken"]["body"] == "x [[y]]" and lenient["open"]["body"] == "---\nopen"


def test_parse_notes(spark):
    df = spark.createDataFrame([("n.md", NOTE), ("bad.md", "---\nx"), ("null.md", None)], "path string, content string")
    got = {r["path"]: r for r in extract.parse_notes(df).select("path", "error", F.size("links").alias("n")).collect()}
    assert got["bad.md"]["error"] and got["n.md"]["n"] == 2 and got["null.md"]["n"] == 0
    names = {(r["alias_name"], r["alias_type"]) for r in extract.page_aliases(extract.parse_notes(df)).collect()}
    assert names == {("My Note", "title"), ("Other", "alias")}


@pytest.mark.parametrize(
    ("source", "types"),
    [
        ("# a\n## b\n### c\n#### d", ["heading_1", "heading_2", "heading_3", "heading_3"]),
        ("a\nb\n\nc", ["paragraph", "paragraph"]),
        ("- a\n  - b\n    - c\n- d", ["bulleted_list_item"] * 4),
        ("1. a\n2. b", ["numbered_list_item"] * 2),
        ("- [ ] a\n- [x] b", ["to_do", "to_do"]),
        ("> q\n> r", ["quote"]),
        ("> [!tip]+ T\n> body", ["callout"]),
        ("```go\nx\n```", ["code"]),
        ("---", ["divider"]),
        ("$$\nx\n$$", ["equation"]),
        ("| a | b |\n|---|---|\n| 1 |", ["table", "table_row", "table_cell", "table_cell", "table_row", "table_cell", "table_cell"]),
        ("![a](http://x/y.png)", ["image"]),
        ("![a](y.png)", ["callout"]),
        ("```dataview\nLIST\n```", ["callout"]),
        ("", []),
    ],
)
def test_block_types(source, types):
    assert [b.type for _, b in md.flat(md.parse(source))] == types


@pytest.mark.parametrize("source", ["# T\n\n", "a **b** *c* ~~d~~ `e` [l](http://x) ==h== $m$\n\n", "- a\n  - b\n    - c\n", "- [x] a\n- [ ] b\n", "> q\n\n", "```py\nx\n\ny\n```\n\n", "---\n\n", "$$\nx\n$$\n\n", "| a | b |\n| --- | --- |\n| 1 | x\\|y |\n\n", "![a](http://u/i.png)\n\n", "1. a\n1. b\n"])
def test_round_trip(source):
    assert md.render(md.parse(source)) == source


def test_code_is_cut_safely():
    code = "é" * 1500 + "\n" + "x" * 1990 + "\n" + "y" * 30
    parts = md.split_code(code)
    assert "".join(parts) == code and all(len(p.encode()) <= 2000 for p in parts)
    assert parts[1].endswith("\n")


def test_inline_runs():
    assert [(r["content"], r["bold"], r["italic"]) for r in md.inline("a **b *c* d** _e_ x_y_z")] == [("a ", False, False), ("b ", True, False), ("c", True, True), (" d ", True, False)][:3] + [(" d", True, False), (" ", False, False), ("e", False, True), (" x_y_z", False, False)]
    assert [(r["type"], r["content"], r["color"]) for r in md.inline("[[T|s]] [[U]]", {"T": "p"}.get)] == [("mention", "s", None), ("text", " ", None), ("text", "[[U]]", "red")]
    assert md.inline("[[U]]", style="skip") == [] and md.inline("[[a/U.md]]", style="text")[0]["content"] == "U"
    assert md.inline("![[x.pdf]]")[0]["content"] == "[📄 x.pdf]" and md.inline("`=q`")[0]["content"] == "[dv: q]"
    assert md.callout_type("💡") == "note" and md.callout_type("🔴") == "danger" and md.callout_type("?") == "note"


def test_blocks_and_back(spark):
    source = "# T\n\nsee [[Target]] and [[None]]\n\n- a\n  - b\n- c\n\n"
    notes = spark.createDataFrame([("n.md", source), ("e.md", "")], "path string, body string")
    flat = blocks.note_blocks(notes)
    resolved = spark.createDataFrame([("Target", "pg")], "target string, page_id string")
    linked = blocks.render_links(flat, resolved)
    kinds = [r["type"] for row in linked.where("type = 'paragraph'").collect() for r in row["rich_text"]]
    assert kinds == ["text", "mention", "text", "text"] or kinds == ["text", "mention", "text"]
    paths = spark.createDataFrame([("pg", "dir/Target.md")], "page_id string, note_path string")
    out = {r["page_key"]: r["markdown"] for r in blocks.blocks_markdown(linked, paths).collect()}
    assert out == {"n.md": source.replace("[[Target]]", "[[dir/Target]]")[:-1]}
    native = linked.where("type = 'paragraph'").select(richtext.markdown(F.col("rich_text")).alias("m")).collect()[0]["m"]
    assert native == "see [[Target]] and [[None]]"


def test_notes_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(text):
        read.add(1)
        return text

    source = "plain\n\nsee [[Target]]\n\n```py\n*x*\n```\n\n"
    notes = spark.createDataFrame([(f"{i}.md", source) for i in range(5)], "path string, body string").withColumn("body", F.udf(count)("body"))
    resolved = spark.createDataFrame([("Target", "pg")], "target string, page_id string")
    # Of two notes with one page the first by path is named.
    paths = spark.createDataFrame([("pg", "b.md"), ("pg", "a.md"), (None, "c.md")], "page_id string, note_path string")
    out = blocks.blocks_markdown(blocks.render_links(blocks.note_blocks(notes), resolved), paths).collect()
    assert {(r["page_key"], r["markdown"]) for r in out} == {(f"{i}.md", source.replace("[[Target]]", "[[a]]")) for i in range(5)}
    assert len(out) == 5 and read.value == 5


@pytest.mark.parametrize("text", ["", "a  \nb \nc\\\nd   \n", " ** a **b** `c` ``d` e`` _f_ g_h_ ~~i~~ ==j== $k$ $ l", "![[a.png|b]] [[c|d]] ![e](f) [g](h) <http://i> [[j", "\\* `=k` ! [ = == ~ <  \n  \n"])
def test_marks_are_tried_where_they_begin(text):
    assert [m.span() for m in md._marks(text)] == [m.span() for m in md._INLINE.finditer(text)]


@pytest.mark.parametrize("block", ["title: Doc 1\ntags: [en, src1]", "a: b\na: c\n", "a: true", "Null: x", "a: [x, null]", "a: [x,y]", "a: 1", "a: b: c", "a: b\n c", "a:  b ", "a: b # c", "[a]: b", "a"])
def test_plain_frontmatter_is_what_yaml_makes_of_it(block):
    import yaml

    from marginalia.functions import frontmatter as fm

    plain = fm._plain_mapping(block)
    assert plain is None or plain == yaml.load(block, fm._Loader)
    assert (plain is not None) == (block in ("title: Doc 1\ntags: [en, src1]", "a: b\na: c\n"))


def test_properties(spark):
    rules = (properties.Rule("title", "Name", "title"), properties.Rule("tags", "Tags", "multi_select"), properties.Rule("done", "Done", "checkbox"), properties.Rule("n", "N", "number"), properties.Rule("d", "D", "date"), properties.Rule("bad", "Bad", "date"), properties.Rule("u", "U", "rich_text", F.upper))
    row = ({"title": "T", "done": "yes", "n": "2.5", "d": "2024-12-25", "bad": "never", "u": "up"}, ["x", "y"])
    df = spark.createDataFrame([row], "fm map<string,string>, tags array<string>").select("fm", "tags", properties.to_properties(F.col("fm"), F.col("tags"), rules).alias("p"))
    p = df.collect()[0]["p"]
    assert set(p) == {"Name", "Tags", "Done", "N", "D", "U"} and p["Tags"]["list"] == ["x", "y"] and p["Done"]["bool"] and p["N"]["num"] == 2.5 and p["D"]["date"].day == 25 and p["U"]["str"] == "UP"
    back = df.select(properties.to_frontmatter(F.col("p"), rules[:4]).alias("b")).collect()[0]["b"]
    assert back == {"title": "T", "tags": '["x","y"]', "done": "true", "n": "2.5", "d": "2024-12-25T00:00:00Z", "u": "UP"}
    own = spark.createDataFrame([({"tags": '["z"]'}, ["x"])], "fm map<string,string>, tags array<string>")
    assert own.select(properties.to_properties(F.col("fm"), F.col("tags"), rules).alias("p")).collect()[0]["p"]["Tags"]["list"] == ["z"]
    shown = spark.createDataFrame([({"b": "[\"x\",\"y\"]", "a": "v: w"},)], "fm map<string,string>").select(properties.render_frontmatter(F.col("fm")).alias("y"), properties.render_frontmatter(F.col("fm"), compat=True).alias("c")).collect()[0]
    assert shown["y"] == '---\na: "v: w"\nb: ["x","y"]\n---\n\n' and shown["c"] == "---\na: v: w\nb: [x y]\n---\n\n"
    assert properties.type_of("bool") == "checkbox" and properties.type_of("bool", aliases=False) == "rich_text" and properties.type_of("odd") == "rich_text"


def test_embed_closure(spark):
    edges = spark.createDataFrame([("a", "b", False), ("b", "c", False), ("c", "b", False), ("a", "i.png", True), ("s", "s", False), *[(f"d{i}", f"d{i + 1}", False) for i in range(15)]], "source string, target string, media boolean")
    got = {(r["root"], r["target"], r["depth"]): r["cycle"] for r in embeds.embed_closure(edges).collect()}
    assert got["a", "c", 2] is False and got["a", "b", 3] is True and got["s", "s", 1] is True and got["a", "i.png", 1] is False
    assert max(d for r, _, d in got if r == "d0") == 10
    assert {r["root"] for r in embeds.too_deep(edges).collect()} == {f"d{i}" for i in range(5)}
    assert {r["root"] for r in embeds.cycles(edges).collect()} == {"a", "b", "c", "s"}
