"""Notes read by expressions, against plain readings line by line."""

import random
import re

from pyspark.sql import functions as F

from marginalia.functions import frontmatter as fm
from marginalia.functions import notes as nt
from marginalia.operators import extract


def plain_parts(body):
    """Links, embeds and tags by a walk over the lines."""
    lines, fence, masked = body.split("\n"), None, []
    for line in lines:
        if fence:
            close = re.fullmatch(r" {0,3}([`~]+)[ \t\r]*", line)
            if close and set(close[1]) == {fence[0]} and len(close[1]) >= len(fence):
                fence = None
            masked.append("")
        elif m := re.match(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})", line):
            fence = m[1]
            masked.append("")
        else:
            masked.append(line)
    blocks, previous = [], None
    for number, line in enumerate(masked, 1):
        inner, quoted = (re.sub(r"^( {0,3}> ?)+", "", x or "") for x in (line, previous))
        new = previous is None or not quoted.strip() or re.match(r" {0,3}#{1,6}(\s|$)", quoted) or re.match(r"\s*(#{1,6}\s|[-*+]\s|\d{1,9}[.)]\s|\|)", inner) or (inner != line and quoted == previous)
        if inner.strip() and new:
            blocks.append((number, []))
        if blocks:
            blocks[-1][1].append(line)
        previous = line
    links, embeds, tags = [], [], []
    for number, held in blocks:
        text, at, out = "\n".join(held), 0, ""
        runs = [(m.start(), m.end()) for m in re.finditer("`+", text)]
        while runs:
            start, end = runs.pop(0)
            close = next((r for r in runs if r[1] - r[0] == end - start), None)
            if close:
                out, at = out + text[at:start] + " ", close[1]
                runs = [r for r in runs if r[0] >= at]
        out += text[at:]
        for m in re.finditer(r"(!?)\[\[([^\[\]|]+)(?:\|([^\[\]]+))?\]\]", out):
            (embeds if m[1] else links).append((m[2], m[3] or "", number))
        tags += re.findall(r"(?<![\w#&/\[])#((?=[\w/-]*[^\W\d])[\w/-]+)", re.sub(r"!?\[\[[^\[\]|]+(?:\|[^\[\]]+)?\]\]", " ", out))
    return links, embeds, tags


def read(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").select("i", nt.note_parts(F.col("body")).alias("p")).select("i", "p.*")
    edges = lambda found: [(e["target"], e["alias"], e["line"]) for e in found]
    return {r["i"]: (edges(r["links"]), edges(r["embeds"]), list(r["tags"])) for r in df.collect()}


def test_random_notes(spark):
    rng = random.Random(5)
    pieces = ["[[a]]", "![[b|2]]", "#tag", "`", "``", "x", " ", " ", "\n", "\n", "\n", "\n\n", "\n```\n", "\n````\n", "\n~~~\n", "\n```go\n", "\n- ", "\n> ", "\n# ", "\n  ", "\n1. ", "| ", "é#ü", "[[c\nd|e]]", "#12", "😀"]
    bodies = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    got = read(spark, bodies)
    for i, body in enumerate(bodies):
        assert got[i] == plain_parts(body), body


def test_cases(spark):
    bodies = {
        None: ([], [], []),
        "": ([], [], []),
        "```\n[[a]]": ([], [], []),
        "```x``` [[a]]": ([("a", "", 1)], [], []),
        "~~~~\n```\n~~~\n[[a]]\n~~~~\n[[b]]": ([("b", "", 6)], [], []),
        "# h\n[[a]]\n[[b]]": ([("a", "", 2), ("b", "", 2)], [], []),
        "> q\n> [[a]]\n>\n> [[b]]": ([("a", "", 1), ("b", "", 4)], [], []),
        "`open\n\n[[a]] `": ([("a", "", 3)], [], []),
        "[[a\n\nb]]": ([], [], []),
        "```\r\n[[a]]\r\n```\r\n[[b]]": ([("b", "", 4)], [], []),
    }
    got = read(spark, list(bodies))
    assert [got[i] for i in range(len(bodies))] == list(bodies.values())


def test_long_note(spark):
    n = 20_000
    body = "\n\n".join(f"line [[t{i}]] ``` #x{i}" for i in range(n)) + "\n\n```\n" + "[[no]]\n" * n
    links, embeds, tags = read(spark, [body])[0]
    assert links == [(f"t{i}", "", 2 * i + 1) for i in range(n)] and not embeds and len(tags) == n


def test_frontmatter_as_the_parser_cuts_it(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["---\n", "---\r\n", "---", "a: 1\n", "\n", "\r\n", "x"]) for _ in range(rng.randrange(0, 9))) for _ in range(600)]
    for lenient in (False, True):
        cut = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", nt.split_frontmatter(F.col("c"), lenient).alias("f")).select("i", "f.*")
        for r in cut.collect():
            try:
                assert (r["block"], r["body"], r["unclosed"]) == (*fm.split(texts[r["i"]], lenient), False), texts[r["i"]]
            except fm.FrontmatterError:
                assert r["unclosed"] and r["body"] == texts[r["i"]]


def test_edges_need_no_python(spark):
    df = spark.createDataFrame([("p", "---\na: [\n---\n[[x]] #t")], "path string, content string")
    edges = extract.note_edges(df)
    assert [(r["links"][0]["target"], r["tags"]) for r in edges.collect()] == [("x", ["t"])]
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    parsed = extract.parse_notes(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in parsed and "ArrowEvalPython" in parsed


def test_notes_of_one_file_are_dealt_out(spark, tmp_path):
    """A table in one row group is one task's to read, but not to parse."""
    from marginalia.operators import blocks

    spark.range(40).selectExpr("id AS path", "concat('- a ', id) AS body").coalesce(1).write.parquet(f"{tmp_path}/notes")
    made = blocks.note_blocks(spark.read.parquet(f"{tmp_path}/notes")).withColumn("task", F.spark_partition_id())
    assert made.count() == 40 and made.select("task").distinct().count() > 1


def test_pages_of_few_bytes_are_rendered_in_several_tasks(spark):
    """Adaptive plans would gather them into one task."""
    from marginalia.operators import blocks

    made = blocks.note_blocks(spark.range(40).selectExpr("id AS path", "concat('- a ', id) AS body"))
    pages = blocks.blocks_markdown(made).withColumn("task", F.spark_partition_id())
    assert pages.count() == 40 and pages.select("task").distinct().count() > 1
