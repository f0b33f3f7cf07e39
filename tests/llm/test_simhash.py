import math
import random
import re

import numpy as np
import pytest
import xxhash

from marginalia.llm import simhash

from .helpers import awkward_rows, frame


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = least.setdefault(find(i), [])
        if r[0] is not None:
            ids.append(r[0])
    return sorted((str(r[0]), f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, r in enumerate(rows))


def test_equals_brute_force(spark):
    rows = awkward_rows()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == brute_components(rows)


def test_small_blocks_lose_no_link(spark):
    rows = [(i, str(i)) for i in range(3)]
    fps = [0, 1, 3, 7, 1 << 40, (1 << 40) | 1, 0xFFFF, 0xFFFE, -1, -2] + [1 << k for k in range(63)]
    from marginalia.llm.common import Scratch
    from marginalia.llm.components import components

    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([(f,) for f in fps], "fp long").distinct()
    for block in (3, 2048):
        roots = {r["node"]: r["root"] for r in components(simhash.links(df, scratch, block=block), scratch).collect()}
        for a in fps:
            for b in fps:
                if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                    assert roots[a] == roots[b]
        assert roots[-1] == roots[-2] != roots[0]
    assert rows


def brute_similar(rows, least=0.8):
    """The ids that stay: of each group linked by shingle similarity the smallest."""
    sets, ids = {}, {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets[r[1] or ""] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
        ids.setdefault(r[1] or "", []).append(r[0])
    texts, group = list(sets), {t: {t} for t in sets}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            either = len(sets[a] | sets[b])
            if group[a] is not group[b] and (len(sets[a] & sets[b]) >= least * either if either else True):
                group[a] |= group[b]
                for t in group[b]:
                    group[t] = group[a]
    groups = {id(g): g for g in group.values()}.values()
    return sorted(str(min((i for t in g for i in ids[t] if i is not None), default=None)) for g in groups)


def near_copies(seed=3):
    """Families of copies with more and more words changed, so that some are alike only by way of others."""
    rng = random.Random(seed)
    rows = []
    for family in range(6):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 40, 150, 600]))]
        for _ in range(25):
            words[rng.randrange(len(words))] = f"x{rng.randrange(500)}"
            rows.append((len(rows), " ".join(words), f"f{family}", "k", "s"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [7, None])
def test_groups_of_near_copies(spark, monkeypatch, block):
    rows = awkward_rows() + [(1000 + r[0], *r[1:]) for r in near_copies()]
    if block:
        compare = simhash.compare
        monkeypatch.setattr(simhash, "compare", lambda nodes, scratch, work, radius, _: compare(nodes, scratch, work, radius, block * 9))
    kept = simhash.drop_similar(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "kept", "score"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == brute_similar(rows)


def test_distance_stands_for_similarity():
    rng = random.Random(8)
    for s in (0.8, 0.9):
        far = []
        for _ in range(40):
            base = [rng.getrandbits(64) for _ in range(900)]
            a, b = (np.unique(np.array(base[: round(900 * s)] + [rng.getrandbits(64) for _ in range(round(450 * (1 - s)))], np.uint64)) for _ in range(2))
            assert abs(simhash.similarity(a, b) - s) < 0.02
            far.append(simhash.wide_distance(simhash.wide_fingerprint(a), simhash.wide_fingerprint(b)))
        assert abs(sum(far) / 40 - 256 * math.acos(2 * s / (1 + s)) / math.pi) < 4 and max(far) <= simhash.WIDE_RADIUS


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.drop_similar(frame(spark, [])).count() == 0


def test_keys_are_compared_but_not_all_pairs(spark, monkeypatch):
    """Texts that share nothing never meet; those of a key do, in place or, if many have it, in the grid."""
    met, compare = [], simhash.compare
    monkeypatch.setattr(simhash, "compare", lambda nodes, *rest: met.append(nodes.count()) or compare(nodes, *rest))
    rng = random.Random(5)
    alone = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)), "s", "k", "s") for i in range(300)]
    twins = [(1000 + r[0], r[1] + " more", *r[2:]) for r in alone[:20]]
    assert simhash.drop_similar(frame(spark, alone + twins)).count() == 300
    assert max(met) == 40


def test_key_pairs_are_all_pairs_of_each_list():
    sizes = [1, 5, 2, 7]
    ends = np.repeat(np.cumsum(sizes), sizes)
    for most in (1, 6, 1000):
        found = [(int(a), int(b)) for i, j in simhash._key_pairs(ends, most) for a, b in zip(i, j, strict=True)]
        assert sorted(found) == [(a, b) for a in range(15) for b in range(a + 1, 15) if ends[a] == ends[b]]


def test_alike_sets_share_a_key_whatever_is_common():
    rng = random.Random(2)
    for n in (1, 4, 5, 9, 10, 37, 400):
        for _ in range(20):
            base = [rng.getrandbits(64) for _ in range(n)]
            kept = math.ceil(0.8 * n)
            a, b = np.unique(np.array(base, np.uint64)), np.unique(np.array(rng.sample(base, kept), np.uint64))
            common = np.sort(np.array(rng.sample(base, rng.randrange(n + 1)), np.uint64))
            assert simhash.similarity(a, b) >= 0.8
            assert np.intersect1d(simhash.prefix_keys(a, common, 0.8), simhash.prefix_keys(b, common, 0.8)).size


@pytest.mark.parametrize("most", [2, 1000])
def test_links_of_keys_in_place_and_in_the_grid(spark, monkeypatch, most):
    monkeypatch.setattr(simhash.key_links, "__defaults__", (simhash.WIDE_RADIUS, None, most))
    rows = awkward_rows() + [(1000 + r[0], *r[1:]) for r in near_copies(11)]
    assert sorted(str(r["doc_id"]) for r in simhash.drop_similar(frame(spark, rows)).collect()) == brute_similar(rows)
