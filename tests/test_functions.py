import pytest
from pyspark.sql import functions as F

from marginalia.functions import dates, globs, hashing, matching, text
from marginalia.functions import frontmatter as fm


def column(spark, values, f, *more):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    width = len(rows[0]) - 1
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"c{k} string" for k in range(width)))
    return [r[0] for r in df.select("i", f(*(F.col(f"c{k}") for k in range(width)), *more).alias("o")).orderBy("i").select("o").collect()]


def test_normalise(spark):
    pairs = [("a  \nb\t\n", "a\nb"), ("a\r\nb", "a\nb"), ("a\rb", "a\nb"), ("a\n\n\n\nb", "a\n\nb"), ("\n x \n", "x"), ("", ""), (" \t\n", ""), (" x ", "x"), ("a  b", "a  b")]
    assert column(spark, [a for a, _ in pairs], hashing.normalise) == [b for _, b in pairs]
    assert column(spark, [b for _, b in pairs], hashing.normalise) == [b for _, b in pairs]


def test_hashes(spark):
    known = "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"
    assert column(spark, ["hello world", " hello world\r\n", "", None], hashing.fingerprint) == [known, known, "", ""]
    got = column(spark, ["---\na: 1\n---\nbody\n", "body", "---\na: 1\n---", "---\nopen\nbody", ""], hashing.hash_triple)
    empty = [(r["content_hash"] == "", r["frontmatter_hash"] == "", r["full_hash"] == "") for r in got]
    assert empty == [(False, False, False), (False, True, False), (True, False, False), (False, True, False), (True, True, True)]
    assert got[0]["content_hash"] == got[1]["content_hash"] == got[1]["full_hash"] != got[0]["full_hash"]


@pytest.mark.parametrize(
    ("patterns", "path", "hit"),
    [([], "any/path.md", False), (["ignore.md"], "ignore.md", True), (["*.tmp"], "file.tmp", True), (["templates/*"], "templates/note.md", True), (["skip.md"], "deep/nested/skip.md", True), (["*.tmp"], "file.md", False), (["*.tmp", "*.bak", "skip.md"], "file.bak", True), (["a/**"], "a/b.md", True), (["a/**"], "a/b/c.md", False), (["n[a-c]?e.md"], "x/nb1e.md", True)],
)
def test_ignore(spark, patterns, path, hit):
    assert column(spark, [path], lambda c: globs.ignored(c, patterns)) == [hit]


def test_path_filters(spark):
    paths = ["work/project/notes.md", "work/meeting.md", "personal/journal.md", "archive/old.md"]
    for pattern, n in [("work/*.md", 1), ("personal/*.md", 1), ("*.md", 0), ("nonexistent/*.md", 0), ("archive/*.md", 1), ("", 0)]:
        assert sum(column(spark, paths, lambda c, p=pattern: globs.matches(c, p))) == n
    watched = ["file.tmp", "notes.tmp", "drafts/wip.md", "templates", "other/templates", "notes.md", "work/project.md", ".x.md"]
    assert column(spark, watched, lambda c: globs.markdown_event(c, ["*.tmp", "drafts/*", "templates"])) == [False] * 5 + [True, True, False]


def test_link_parts(spark):
    cases = {"Page": ("Page", "", ""), "Page.md": ("Page", "", ""), "Page#Heading": ("Page", "Heading", ""), "Page^block-id": ("Page", "", "block-id"), "Page#Heading^block-id": ("Page", "Heading", "block-id"), "folder/Page#Section": ("folder/Page", "Section", ""), "work/notes/Architecture.md#Overview": ("work/notes/Architecture", "Overview", ""), "a^b^c": ("a", "", "b^c")}
    assert [tuple(r) for r in column(spark, list(cases), text.parse_target)] == list(cases.values())
    assert column(spark, ["A.md#H", "A.md", "A#H^b", "A^b#c"], text.normalise_target) == ["A.md", "A", "A", "A"]


def test_parse_single_link(spark):
    cases = {"[[Page]]": ("Page", "", "", "", False), "[[Page|Al]]": ("Page", "Al", "", "", False), "[[P#H|A]]": ("P", "A", "H", "", False), "[[f/P#H^b|A]]": ("f/P", "A", "H", "b", False), "![[i.png|100]]": ("i.png", "100", "", "", True), "not a link": None, "[[a|b|c]]": ("a|b", "c", "", "", False)}
    assert [r and tuple(r) for r in column(spark, list(cases), text.parse_link)] == list(cases.values())


def test_extraction(spark):
    body = "See [[A]], [[B/C.md#h|al]] and ![[img.png|10x20]]\n`=this.x`\n```dataview\nLIST from a\n```\n```dataviewjs\njs\n```"
    assert [(x["target"], x["alias"], x["heading"]) for x in column(spark, [body], text.links)[0]] == [("A", "", ""), ("B/C.md", "al", "h"), ("img.png", "10x20", "")]
    assert [x["target"] for x in column(spark, [body], text.embeds)[0]] == ["img.png"]
    assert [(q["raw"], q["type"], q["inline"]) for q in column(spark, [body], text.queries)[0]] == [("LIST from a", "LIST", False), ("js", "JS", False), ("this.x", "INLINE", True)]
    assert column(spark, [body, "none"], text.contains_query) == [True, False]


def test_media_and_dimensions(spark):
    assert [tuple(r) for r in column(spark, ["a.PNG", "b.pdf", "c.webm", "d.mp4", "e"], text.embed_media)] == [(True, False, False, False), (False, True, False, False), (False, False, True, True), (False, False, False, True), (False,) * 4]
    assert [tuple(r) for r in column(spark, ["", "100", "100x200", "800x600", "invalid", "100xinvalid"], text.dimensions)] == [(0, 0), (100, 0), (100, 200), (800, 600), (0, 0), (100, 0)]


def test_names(spark):
    pairs = {"Work/Project": "Work-Project", "...Hidden": "Hidden", "...": "Untitled", "": "Untitled", ' a:b*c?"d<e>f|g\\ ': "a-b-c--d-e-f-g-"}
    assert column(spark, list(pairs), text.sanitise_filename) == list(pairs.values())
    assert column(spark, [("a/B.md", ""), ("a/B", "al")], text.display) == ["B", "al"]
    assert column(spark, ["0.25", "12.34", "245", "7620"], text.duration) == ["250ms", "12.3s", "4m5s", "2h7m"]
    assert column(spark, ["550e8400-e29b-41d4-a716-446655440000", "x"], text.is_uuid) == [True, False]


def test_distance_and_match(spark):
    cases = {("", ""): 0, ("abc", ""): 3, ("abc", "abd"): 1, ("abc", "ab"): 1, ("kitten", "sitting"): 3, ("Saturday", "Sunday"): 3, ("ServiceClass", "ServiceClas"): 1, ("", "é"): 2, ("é", "e"): 1}
    assert column(spark, list(cases), matching.distance) == list(cases.values())
    scores = {("Note", "Note"): 4, ("note", "Note"): 3, ("Service", "ServiceClass"): 2, ("SrviceClass", "ServiceClass"): 1, ("Completely", "Different"): 0, ("Noet", "Notes"): 1, ("", "any"): 2}
    assert [r["score"] for r in column(spark, list(scores), lambda a, b: matching.match(a, b, 2))] == list(scores.values())
    assert column(spark, ["service-class", "service_class", "Service.Class", "  a   b "], matching.match_key) == ["service class"] * 3 + ["a b"]


def test_dates(spark):
    good = ["2024-12-25", "2024/12/25", "12/25/2024", "Dec 25, 2024", "December 25, 2024", "2024-12-25T00:00:00Z", "2024-12-25T10:30:00"]
    got = column(spark, [*good, "not a date", "1/5/2025", "2024-13-01"], dates.parse_date)
    assert all((d.year, d.month, d.day) == (2024, 12, 25) for d in got[: len(good)]) and got[len(good) :] == [None] * 3


def test_frontmatter_split():
    assert fm.split("---\na: 1\n---\nbody") == ("a: 1", "body")
    assert fm.split("---\r\na: 1\r\n---\r\nbody") == ("a: 1", "body")
    assert fm.split("---\n---\nbody") == ("", "body")
    assert fm.split("---\na: 1\n---") == ("a: 1", "")
    assert fm.split("no") == (None, "no")
    assert fm.split("---\nopen", lenient=True) == (None, "---\nopen")
    with pytest.raises(fm.FrontmatterError):
        fm.split("---\nopen")
    assert fm.split_public("---\nx: 1\n---") == ("x: 1", "") and fm.split_public("---\nopen") == (None, "---\nopen")


def test_yaml():
    assert fm.parse("a: yes\nb: true\nc: [1, x]\nd: 2024-01-02") == {"a": "yes", "b": True, "c": [1, "x"], "d": __import__("datetime").date(2024, 1, 2)}
    assert fm.parse("a: [1\nb: two\n# c: 3\n- d\ntext: |\n  one\n  two\ne:", lenient=True) == {"a": "[1", "b": "two", "text": "one\ntwo", "e": ""}
    deep = "".join("  " * i + f"k{i}:\n" for i in range(25)) + "  " * 25 + "x: 1"
    with pytest.raises(fm.FrontmatterError):
        fm.parse(deep)
    with pytest.raises(fm.FrontmatterError):
        fm.parse("a: [1")
    assert fm.merge({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3}
    assert fm.parse(fm.split(fm.serialise({"t": "x: y", "l": [1, 2]}, "b"))[0]) == {"t": "x: y", "l": [1, 2]}


def test_typed_access(spark):
    v = lambda f: lambda c: f(fm.variant(c))
    j = ['{"s": "x", "l": ["a", "b"], "one": "z", "n": 3.7, "b": true, "d": "2024-12-25"}']
    assert column(spark, j, v(lambda c: fm.get_string(c, "s"))) == ["x"] and column(spark, j, v(lambda c: fm.get_string(c, "no"))) == [""]
    assert column(spark, j, v(lambda c: fm.get_list(c, "l"))) == [["a", "b"]] and column(spark, j, v(lambda c: fm.get_list(c, "one"))) == [["z"]] and column(spark, j, v(lambda c: fm.get_list(c, "no"))) == [[]]
    assert column(spark, j, v(lambda c: fm.get_int(c, "n"))) == [3] and column(spark, j, v(lambda c: fm.get_int(c, "s"))) == [0]
    assert column(spark, j, v(lambda c: fm.get_bool(c, "b"))) == [True] and column(spark, j, v(lambda c: fm.get_bool(c, "s"))) == [False]
    assert column(spark, j, v(lambda c: fm.get_time(c, "d")))[0].year == 2024 and column(spark, j, v(lambda c: fm.has(c, "x"))) == [False]


def test_query_offsets_are_bytes_of_the_whole_match(spark):
    """Every match's bytes, cut out by its offsets, are its fence or quotes with what it holds."""
    from marginalia.functions import text

    bodies = ["", "no query", "`=a``=b`", "漢字 `=x` and `=漢` end", "```dataview\nlist é\n```\n`=y`\n```dataviewjs\ndv.é()\n```\n```dataview\ntask\n```", "```dataview\nopen", "`=a` `=a` `=a`"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    for r in df.select("body", text.located_queries(df["body"]).alias("q"), text.queries(df["body"]).alias("plain")).collect():
        data = r["body"].encode()
        for q in r["q"]:
            cut = data[q["start_pos"] : q["end_pos"]].decode()
            fence = "```dataviewjs\n%s\n```" if q["type"] == "JS" else "`=%s`" if q["inline"] else "```dataview\n%s\n```"
            assert cut == fence % q["raw"]
        assert [(q["raw"], q["type"], q["inline"]) for q in r["q"]] == [(q["raw"], q["type"], q["inline"]) for q in r["plain"]]
        assert len({q["start_pos"] for q in r["q"]}) == len(r["q"])
