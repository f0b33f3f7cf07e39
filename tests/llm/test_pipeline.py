"""Each stage of the pipeline against brute force on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from marginalia.llm import mixing, quality_cnn

from .test_bpe import library
from .test_simhash import brute_similar

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{base}/{i}"
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_names_and_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == COLUMNS for df in steps[:-1])


def test_quality(spark, steps):
    docs, kept = steps[0], steps[1]
    net = quality_cnn.train(quality_cnn.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    want = {r["doc_id"] for r in docs.collect() if quality_cnn.probability(net, r["text"] or "") >= 0.5}
    assert {r["doc_id"] for r in kept.collect()} == want
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()} & {r["doc_id"] for r in docs.collect()}
    assert len(good & want) >= 0.97 * len(good)


def test_exact(steps):
    before, after = steps[1].collect(), steps[2].collect()
    best = {}
    for r in before:
        best[r["text"]] = max(r["doc_id"], best.get(r["text"], r["doc_id"]))
    assert sorted(r["doc_id"] for r in after) == sorted(best.values())


def test_near(steps):
    """Five-word shingles, similarity 0.8 or more."""
    before, after = steps[2].collect(), steps[3].collect()
    assert sorted(str(r["doc_id"]) for r in after) == brute_similar([(r["doc_id"], r["text"]) for r in before])


def test_mix(spark, steps):
    before, after = steps[3], steps[4]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == +Counter(copies)
    words = Counter()
    for r in mixing.mix(before).collect():
        words[r["source"]] += r["copies"] * r["size"]
    targets = {r["source"]: r["target"] for r in mixing.mix(before).collect()}
    assert all(abs(words[s] - t) <= max(60, 0.1 * t) for s, t in targets.items())


def test_tokens(steps):
    encode = library().encode_ordinary
    before, after = steps[4].collect(), steps[5].collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in after) == sorted((r["doc_id"], encode(r["text"])) for r in before)
    assert all(r["n_tokens"] == len(r["ids"]) for r in after)


def test_run(spark, steps):
    key = lambda r: (r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, steps[5].collect()))
