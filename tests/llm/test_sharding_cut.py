"""Groups that fit a shard lie on one, also beside groups larger than a quota."""

import random
from collections import Counter, defaultdict
from functools import cache

import pytest

from marginalia.llm import sharding


def cut_groups(spark, total, text, shards):
    """Text's number -> shards it lies on."""
    docs = spark.range(total).selectExpr("id as doc_id", f"cast({text} as string) as text")
    got = sharding.shard_documents(docs, shards).join(docs, "doc_id").groupBy("text", "shard").count().collect()
    on = defaultdict(list)
    for r in got:
        on[r["text"]].append(r["count"])
    return on


def test_hot_group_takes_few_shards_and_small_ones_stay_whole(spark):
    # A third of all rows is one group; half of the others are in groups of four.
    on = cut_groups(spark, 48_000, "case when id % 3 = 0 then -1 when id % 3 = 1 then floor(id / 12) else id + 1000000 end", 16)
    assert len(on.pop("-1")) == 6
    assert not [t for t, n in on.items() if len(n) > 1]


def test_all_rows_linked(spark):
    on = cut_groups(spark, 48_000, "case when id % 3 = 0 then -1 else floor(id / 6) end", 16)
    assert len(on.pop("-1")) == 6
    assert sum(len(n) > 1 for n in on.values()) <= 16


def fewest_cut(sizes, shards, total):
    """The least number of groups that any placement cuts, by trying all; documents without links fill what is left."""
    quota = tuple(sorted(total // shards + (s < total % shards) for s in range(shards)))

    @cache
    def best(i, room):
        if i == len(sizes):
            return 0
        tries = [best(i + 1, tuple(sorted(room[:s] + (room[s] - sizes[i],) + room[s + 1 :]))) for s in range(shards) if room[s] >= sizes[i] and room[s] not in room[:s]]
        # Cut: its rows lie anywhere, as a group without links; that can only leave more room than any way of cutting it.
        return min([*tries, 1 + best(i + 1, room)])

    return best(0, quota)


@pytest.mark.parametrize("seed", range(3))
def test_cut_groups_against_the_best_and_random(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randint(2, 9) for _ in range(9)]
    texts = [f"g{i}" for i, n in enumerate(sizes) for _ in range(n)] + [f"s{i}" for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    on = defaultdict(set)
    for r in sharding.shard_documents(docs, 4).join(docs, "doc_id").collect():
        on[r["text"]].add(r["shard"])
    cut = sum(len(s) > 1 for s in on.values())
    by_chance = sum(1 - 4 ** (1 - n) for n in sizes)
    assert cut <= fewest_cut(tuple(sizes), 4, len(texts)) + 1 and cut < by_chance / 2


def test_partitions_make_no_difference(spark):
    rows = [(i % 900 if i % 7 else None, f"text {i // 3 if i % 2 else i % 40}") for i in range(1000)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    results = [Counter(tuple(r) for r in sharding.shard_documents(docs.repartition(n), 16).collect()) for n in (3, 7)]
    assert results[0] == results[1]
