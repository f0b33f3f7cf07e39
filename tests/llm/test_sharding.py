import zlib
from collections import Counter

import pytest

from marginalia.llm import sharding

from .helpers import awkward_rows, frame


@pytest.mark.parametrize(("rows", "shards"), [(awkward_rows() + [(500 + i, f"text {i}", "s", "", "") for i in range(100)], 16), ([(i, "hot" if i % 3 == 0 else str(i // 2), "s", "", "") for i in range(400)], 5), ([(i, "one", "", "", "") for i in range(50)], 7), ([(1, None, None, None, None)], 16), ([], 16)])
def test_law_slots_and_groups(spark, rows, shards):
    got = sharding.shard_documents(frame(spark, rows), shards).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((str(r[0]), size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    counts = Counter(r["shard"] for r in got)
    assert all(0 <= s < shards for s in counts) and all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    spread = [counts[s] for s in range(shards)]
    assert max(spread) - min(spread) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    groups = {}
    for r in got:
        groups.setdefault((r["size"], r["text_crc32"]), []).append(r["shard"])
    quota = max(spread, default=0)
    small = [g for g in groups.values() if 1 < len(g) <= quota // 2]
    cut = sum(len(set(g)) > 1 for g in small)
    assert cut <= max(1, len(small) * 0.1)
