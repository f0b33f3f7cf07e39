import hashlib

from marginalia.llm import exact_dedup

from .helpers import awkward_rows, frame


def test_equals_brute_force(spark):
    rows = awkward_rows()
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    for block_bytes in (7, 4096):
        got = exact_dedup.exact_duplicates(frame(spark, rows), block_bytes=block_bytes).collect()
        want = []
        for text, ids in groups.items():
            best = max((i for i in ids if i is not None), default=None)
            left = [best]
            for i in ids:
                kept = i in left
                if kept:
                    left.remove(i)
                want.append((str(i), str(best), len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
        assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in got) == sorted(want)
        if block_bytes == 7:
            continue


def test_kept_rows_keep_their_columns(spark):
    rows = awkward_rows()
    kept = exact_dedup.drop_exact_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "kept", "score"]
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({r[1] or "" for r in rows})


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    assert exact_dedup.drop_exact_duplicates(frame(spark, [])).count() == 0
