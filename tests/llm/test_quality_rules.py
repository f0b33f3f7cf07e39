import itertools
import re
from collections import Counter

from marginalia.llm import quality_rules as q

from .helpers import awkward_rows, frame


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    repeat = len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, len(words) < 50 or 100 * repeat > 50 * len(words)


def test_counts_and_verdicts(spark):
    rows = awkward_rows()
    got = q.apply_rules(frame(spark, rows)).collect()
    want = []
    for r in rows:
        d = q.Document(r[1] or "")
        base = brute(r[1] or "")
        kept = not base[5] and not any(rule.rejects(d) for rule in q.RULES)
        want.append(str((r[0], *base, kept)))
    assert sorted(str(tuple(r)[:8]) for r in got) == sorted(want)
    assert q.apply_rules(frame(spark, [])).count() == 0


def test_order_decides_no_verdict():
    texts = [r[1] or "" for r in awkward_rows()] + ["LOUD WORDS " + " ".join(f"W{i}" for i in range(80)), " ".join(f"w{i}***" for i in range(90))]
    for order in itertools.permutations(q.RULES):
        assert [q.verdict(q.Document(t), list(order)) is None for t in texts] == [q.verdict(q.Document(t), list(q.RULES)) is None for t in texts]


def test_order_is_by_rejections_per_cost_of_what_is_left():
    import time

    slow = q.Rule("slow", lambda d: time.sleep(0.002) or "a" in d.text)
    fast = q.Rule("fast", lambda d: time.sleep(0.0002) or "a" in d.text)
    other = q.Rule("other", lambda d: time.sleep(0.0002) or "b" in d.text)
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "aaaaabbcccc"]
    # What fast rejects, slow has no chance at, so other goes before it.
    assert [r.name for r in q.order_rules(texts, (slow, other, fast))] == ["fast", "other", "slow"]


def test_letters_are_letters_only():
    text = "AB² ٣Ⅷ ǅ é" + " x" * 60
    d = q.Document(text)
    assert sum(map(len, q._LETTERS.findall(text))) == 64 and sum(map(len, q._CAPITALS.findall(text))) == 2 and not q._shouts(d)


def test_sample_of_long_texts(spark):
    rows = [(i, f"{i} " + "lorem ipsum dolor " * 9000, "s", "", "") for i in range(5)]
    assert q.apply_rules(frame(spark, rows)).where("base_failed").count() == 5


def test_rules_keep_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = q.apply_rules(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
