import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from marginalia.llm import mixing

from .helpers import awkward_rows, frame


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = {s: Fraction(0) for s in order}
    full = set()
    excess = Fraction(sum(sizes.values()))
    while excess and len(full) < len(order):
        total = sum(weight[s] for s in order if s not in full)
        target |= {s: target[s] + excess * weight[s] / total for s in order if s not in full}
        excess = Fraction(0)
        for s in order:
            if s not in full and target[s] > 3 * sizes[s]:
                excess += target[s] - 3 * sizes[s]
                target[s] = Fraction(3 * sizes[s])
                full.add(s)
    return target


@pytest.mark.parametrize("seed", range(30))
def test_targets(seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 100, 5000]) for s in rng.sample(["a", "b", "B", "é", "zz", "", None, "c", "d"], rng.randint(1, 9))}
    got, want = mixing.source_targets(list(sizes.items())), brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - float(want[s])) < 1e-6 for s in got)


@pytest.mark.parametrize("block", [40, 4096])
def test_mix(spark, block):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", None]), "k", "s") for i in range(700)] + awkward_rows() + [(1, "same id", "a", "", "")]
    got = mixing.mix(frame(spark, rows), block=block).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in got) == sorted((str(r[0]), str(r[2]), words(r[1])) for r in rows)
    sizes, taken, docs_in, docs_out, rate = Counter(), Counter(), Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
    targets = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(targets[r["source"]])) < 1e-6 and 0 <= r["copies"] <= 3
        whole = targets[r["source"]] / sizes[r["source"]]
        assert int(whole) * bool(r["size"]) <= r["copies"] <= whole + 1
        taken[r["source"]] += r["copies"] * r["size"]
        if r["size"]:
            docs_in[r["source"]] += float(whole)
            docs_out[r["source"]] += r["copies"]
    for s in sizes:
        near = 30 if block == 4096 else max(30, max(r["size"] for r in got if r["source"] == s))  # tiny blocks leave giants to the end
        assert abs(taken[s] - targets[s]) <= near, (s, taken[s], float(targets[s]))
        assert abs(docs_in[s] - docs_out[s]) <= (10 if s == "a" else 60)  # giants leave the count to the words
    again = mixing.mix(frame(spark, rows).repartition(7), block=block).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_take_repeats_rows(spark):
    rows = [r for r in awkward_rows() if r[0] is not None]
    docs = frame(spark, rows)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["copies"]
    out = mixing.take(docs)
    assert out.columns == docs.columns
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == +want
    assert mixing.take(frame(spark, [])).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(4)
    units = [(rng.randint(1, 50), rng.random()) for _ in range(500)]
    settled, open_ = mixing.fly(units, random.Random(1))
    assert len(open_) <= 2 and settled.keys() | open_.keys() == set(range(500))
    chosen = {**settled, **open_}
    assert abs(sum(units[k][0] * v for k, v in chosen.items()) - sum(s * p for s, p in units)) < 1e-6
    assert abs(sum(chosen.values()) - sum(p for _, p in units)) < 1e-6
