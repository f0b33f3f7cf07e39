"""Near-dedup of rows with null and repeated ids whose texts differ."""

from marginalia.llm import simhash

from .helpers import frame


def test_unlinked_rows_stay_whatever_their_ids(spark):
    texts = [" ".join(f"{w}{k}" for k in range(60)) for w in ("red", "green", "blue", "black", "white")]
    rows = [(None, texts[0], "a", "", ""), (None, texts[1], "b", "", ""), (7, texts[2], "c", "", ""), (7, texts[3], "d", "", ""), (7, texts[3], "d", "", ""), (8, texts[3].upper(), "e", "", ""), (9, texts[4], "f", "", ""), (7, texts[4].upper(), "g", "", "")]
    kept = simhash.drop_similar(frame(spark, rows)).collect()
    assert sorted(r["source"] for r in kept) == ["a", "b", "c", "d", "g"]


def test_a_loser_is_not_let_in_by_its_id(spark):
    # Id 5 stays by its one text; its other text loses to id 1.
    a, b = (" ".join(f"{w}{k}" for k in range(60)) for w in ("one", "two"))
    kept = simhash.drop_similar(frame(spark, [(1, a, "x", "", ""), (5, a.upper(), "lost", "", ""), (5, b, "y", "", "")])).collect()
    assert sorted(r["source"] for r in kept) == ["x", "y"]
