import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from marginalia import schema
from marginalia.operators import diff, state
from marginalia.plans import runtime, verbs
from marginalia.sources import config, remote, vault
from marginalia.sources.state_store import StateStore
from marginalia.streaming import events

T0 = dt.datetime(2024, 1, 1)


def state_of(spark, rows):
    return spark.createDataFrame([(p, i, None, "h", "", None, None, None, None, s) for p, i, s in rows], schema.SYNC_STATE)


def test_upserts(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, state.upsert(base, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    latest = spark.createDataFrame([("b", 3, 1), ("b", 9, 2), ("c", 4, 1)], "k string, v int, ver int")
    assert sorted(map(tuple, state.upsert_latest(base, latest, ["k"], "ver").collect())) == [("a", 1), ("b", 9), ("c", 4)]
    assert sorted(map(tuple, state.insert_ignore(base, latest.drop("ver"), ["k"]).select("k").collect())) == [("a",), ("b",), ("c",)]
    assert state.delete(base, base.where("k = 'a'"), ["k"]).count() == 1


def test_conflicts_and_history(spark):
    st = state_of(spark, [("a.md", "1", "synced"), ("b.md", "2", "synced")])
    history = spark.createDataFrame([(5, "a.md", "push", T0, "h", None)], schema.SYNC_HISTORY)
    found = spark.createDataFrame([("a.md", "l", "r", T0, T0), ("zz.md", "l", "r", T0, T0)], "note_path string, local_hash string, remote_hash string, local_mtime timestamp, remote_mtime timestamp")
    now = F.lit("2024-02-01").cast("timestamp")
    st, history = state.record_conflicts(st, history, found, now)
    assert [r["note_path"] for r in state.conflicts(st).collect()] == ["a.md"] and state.has_conflict(st, "a.md").collect()[0][0]
    assert sorted(r["seq"] for r in history.collect()) == [5, 6]
    assert state.parse_details(history).where("action = 'conflict'").select("conflict.local_hash").collect()[0][0] == "l"
    assert [r["note_path"] for r in state.latest_conflict(history).collect()] == ["a.md"]
    st = state.resolve_conflicts(st, st.where("note_path = 'a.md'"), now)
    assert state.by_status(st, "conflict").count() == 0
    assert state.retain_history(history, now, F.expr("interval 10 days")).count() == 1 and state.expired_count(history, now, F.expr("interval 10 days")).collect()[0][0] == 1
    assert [r["action"] for r in state.recent_history(history, 1).collect()] == ["conflict"]


def test_renames_and_deletions(spark):
    st = state_of(spark, [("old.md", "1", "synced"), ("b.md", "2", "synced")])
    links = spark.createDataFrame([("old.md", "T", None, None, False)], schema.LINKS)
    aliases = spark.createDataFrame([("old.md", "A", "title")], schema.PAGE_ALIASES)
    moves = spark.createDataFrame([("old.md", "new.md")], "old_path string, new_path string")
    s, k, a = state.apply_renames(st, links, aliases, moves, F.lit("2024-02-01").cast("timestamp"))
    assert {r["note_path"]: r["last_sync"] is not None for r in s.collect()} == {"new.md": True, "b.md": False}
    assert k.collect()[0]["source_path"] == a.collect()[0]["note_path"] == "new.md"
    changes = spark.createDataFrame([("x/a.md", "deleted", "push", "1"), ("x/b.md", "deleted", "pull", "2"), ("c.md", "modified", "push", "3")], "path string, type string, direction string, page_id string")
    assert {tuple(r) for r in state.deletion_plan(changes).collect()} == {("x/a.md", "1", "archive_page", None), ("x/b.md", "2", "move_note", "_archive/b.md")}
    assert {r["action"] for r in state.deletion_plan(changes, "ignore", "delete").collect()} == {"ignore", "remove_note"}


@pytest.fixture
def folder(tmp_path):
    for path in ("root.md", "notes/note1.md", "notes/note2.md", "deep/nested/file.md", ".hidden/secret.md", "other.txt", "ignored/skip.md", "_x/y.md", ".z.md"):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"text of {path}")
    return str(tmp_path)


def test_vault(spark, folder):
    paths = lambda df: {r["path"] for r in df.collect()}
    kept = {"root.md", "notes/note1.md", "notes/note2.md", "deep/nested/file.md", "ignored/skip.md", "_x/y.md", ".z.md"}
    assert paths(vault.scan(spark, folder)) == kept
    assert paths(vault.scan(spark, folder, ["ignored/*"])) == kept - {"ignored/skip.md"}
    assert paths(vault.scan(spark, folder, directory="notes")) == {"notes/note1.md", "notes/note2.md"} and vault.scan(spark, folder, directory="gone").count() == 0
    assert paths(vault.scan_glob(spark, folder, "notes/*.md")) == {"notes/note1.md", "notes/note2.md"}
    assert {r["path"]: r["content"] for r in vault.read(vault.scan(spark, folder)).collect()}["root.md"] == "text of root.md"
    assert vault.directories(folder) == ["_x", "deep", "deep/nested", "ignored", "notes"]
    files = spark.createDataFrame([("new/dir/a.md", "é"), ("b.md", None)], "path string, content string")
    assert {r["path"]: r["bytes"] for r in vault.write(files, folder).collect()} == {"new/dir/a.md": 2, "b.md": 0}
    vault.move(folder, "b.md", "_archive/b.md")
    vault.delete(folder, "root.md")
    assert vault.exists(folder, "_archive/b.md") and not vault.exists(folder, "root.md")
    assert "notes/note1.md" in paths(vault.read_store(spark, f"file://{folder}"))


def test_init_and_plans(spark, folder):
    notes = vault.read(vault.scan(spark, folder)).select("path", "content", "mtime")
    first = verbs.init(notes)
    assert first.state.count() == 7 and first.state.where("status = 'pending'").count() == 7 and first.errors.count() == 0
    pages = spark.createDataFrame([("p9", T0, T0, False, None, "New: page")], schema.REMOTE_PAGES + ", title string")
    v = verbs.Vault(notes, first.state, first.links, first.aliases, pages)
    assert verbs.status(v).collect()[0]["pending"] == 7
    assert verbs.push(v).count() == 7 and verbs.push(v, pattern="notes/*.md").count() == 2 and verbs.push(v, ignore=["_x/*"]).count() == 6
    assert [tuple(r) for r in verbs.pull(v).collect()] == [("New- page.md", "p9", "pull")]
    out = verbs.render(v, verbs.push(v))
    assert out.blocks.where("type = 'paragraph'").count() == 7
    assert remote.create_requests(out.properties.join(out.blocks.groupBy("page_key").agg(F.collect_list("block_path").alias("blocks")), "page_key"), "db").count() == 7
    choices = spark.createDataFrame([("root.md", "both")], "note_path string, keep string")
    theirs = spark.createDataFrame([("root.md", "remote text")], "note_path string, markdown string")
    kept = verbs.resolve_conflict(notes, theirs, choices, F.lit("2024-01-02").cast("timestamp")).collect()[0]
    assert kept["path"] == "root.conflict.md" and kept["content"].endswith("---\n\nremote text") and kept["action"] == "write"


def test_state_store(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/state")
    assert store.read("links").count() == 0
    for n in range(1, 5):
        store.write("links", store.read("links").unionByName(spark.createDataFrame([("s", f"t{n}", None, None, False)], schema.LINKS)))
    assert store.read("links").count() == 4 and len(os.listdir(tmp_path / "state/links")) == 2


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("TOKEN_X", "secret")
    path = tmp_path / "c.yaml"
    path.write_text("vault: ~/v\nremote: {token: '${TOKEN_X}', default_database: db}\nmappings: [{path: 'work/*', database: w, properties: [{key: a, type: bool}]}]\n")
    c = config.load(str(path))
    assert c["remote"]["token"] == "secret" and not c["vault"].startswith("~") and c["sync"]["deletion"]["remote"] == "archive" and config.validate(c) == []
    config.save(c, str(tmp_path / "d/c.yaml"))
    assert config.load(str(tmp_path / "d/c.yaml")) == c and config.find(["/no/such", str(path)]) == str(path)
    bad = config._over(config.DEFAULTS, {"rate_limit": {"batch_size": 200}, "sync": {"conflict_strategy": "x"}, "watch": {"poll": "soon"}, "mappings": [{"properties": [{"type": "odd"}]}]})
    assert len(config.validate(bad)) == 7
    assert config.duration_seconds("1h30m") == 5400 and config.duration_seconds("500ms") == 0.5 and config.duration_seconds("0") == 0
    assert config.merge_properties([{"key": "a", "type": "url"}, {"key": "z"}], [{"key": "a", "type": "title"}, {"key": "b"}]) == [{"key": "a", "type": "url"}, {"key": "b"}, {"key": "z"}]


def test_remote(spark):
    pages = spark.createDataFrame([("p1", T0, T0, False, None, "One"), ("p2", T0, T0, False, "boom", "Two")], schema.REMOTE_PAGES + ", title string")
    ids = spark.createDataFrame([("p1",), ("p3",)], "page_id string")
    assert {r["page_id"]: r["error"] for r in remote.batch_metadata(ids, pages).collect()} == {"p1": None, "p3": "page not found: p3"}
    assert [r["page_id"] for r in remote.known_metadata(ids, pages).collect()] == ["p1"]
    cache = spark.createDataFrame([("p1", T0, True, None, T0)], "page_id string, last_edited timestamp, archived boolean, error string, fetched_at timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    fresh, new = remote.cached_metadata(ids, cache, pages, at("2024-01-01 00:01:00"), F.expr("interval 5 minutes"))
    assert {r["page_id"]: r["archived"] for r in fresh.collect()} == {"p1": True, "p3": None} and new.count() == 2
    stale, _ = remote.cached_metadata(ids, cache, pages, at("2024-01-02"), F.expr("interval 5 minutes"))
    assert {r["page_id"]: r["archived"] for r in stale.collect()} == {"p1": False, "p3": None}
    assert remote.search(pages, "tw").count() == 1 and remote.archive(pages, ids).where("archived").count() == 1 and remote.clear_cache(cache).count() == 0
    flat = spark.createDataFrame([("n", [i], 0, "paragraph") for i in range(250)] + [("n", [3, 0], 1, "paragraph")], "page_key string, block_path array<int>, depth int, type string")
    batches = remote.append_batches(flat).groupBy("batch").count().collect()
    assert sorted(map(tuple, batches)) == [(0, 100), (1, 100), (2, 50)]
    assert remote.children(flat, [3]).count() == 1 and remote.has_children(flat).where("has_children").count() == 1
    attrs = spark.createDataFrame([("to_do", {"checked": "true", "x": "y"})], "t string, a map<string,string>")
    assert attrs.select(remote.block_update(F.col("t"), F.col("a")).alias("u")).collect()[0]["u"] == {"checked": "true"}
    with pytest.raises(Exception, match="can't be updated"):
        attrs.select(remote.block_update(F.lit("table"), F.col("a"))).collect()


def test_parallel_map(spark):
    df = spark.range(100).select(F.col("id").alias("n"), (F.col("id") * 10).alias("value"))

    def f(x):
        if x % 20 == 0:
            raise ValueError(f"even {x}")
        return x + 1

    rows = runtime.parallel_map(df, f, result_type="bigint").orderBy("n").collect()
    assert [r["result"] for r in rows] == [None if i % 2 == 0 else i * 10 + 1 for i in range(100)] and rows[2]["error"] == "even 20"
    assert df.columns == ["n", "value"]
    now = [0.0]
    limiter = runtime.RateLimiter(3, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(7):
        limiter.wait()
    assert abs(now[0] - 2.0) < 1e-6
    one = spark.range(1).select(runtime.progress(F.lit(5), F.lit(20), F.lit(10.0)).alias("p")).collect()[0]["p"]
    assert (one["percent"], one["rate"], one["eta_seconds"]) == (25.0, 0.5, 30.0)


def test_stream_of_events(spark, tmp_path):
    log = str(tmp_path / "log")
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("a.md", "write", at(0)), ("a.md", "write", at(3)), ("b.md", "write", at(1)), ("a.md", "remove", at(20)), (".x.md", "write", at(2)), ("t.txt", "write", at(2))]
    spark.createDataFrame(rows, events.EVENT).coalesce(1).write.parquet(log)
    batch = events.debounce(events.wanted(spark.read.parquet(log)))
    assert sorted((r["path"], r["events"], r["op"]) for r in batch.collect()) == [("a.md", 1, "remove"), ("a.md", 2, "write"), ("b.md", 1, "write")]
    seen = []
    notes = spark.createDataFrame([("a.md", "text", T0)], "path string, content string, mtime timestamp")
    st = state_of(spark, [("b.md", "2", "synced")])
    stream = events.debounce_stream(events.wanted(events.read_log(spark, log)), "5 seconds", "1 seconds")
    query = events.run_syncs(stream, lambda: diff.fingerprints(notes), lambda: st, lambda plan, n: seen.extend(map(tuple, plan.collect()))).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    spark.createDataFrame([("z.md", "write", at(500))], events.EVENT).coalesce(1).write.mode("append").parquet(log)
    query.processAllAvailable()
    query.stop()
    assert ("a.md", "push") in seen and ("b.md", "delete") in seen
    assert events.polls(spark, 0) is None and events.polls(spark, 300).isStreaming
