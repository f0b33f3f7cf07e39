import zlib

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import quality_cnn

from .helpers import awkward_rows, frame

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_cnn.training_rows(docs, labels)
    assert rows == quality_cnn.training_rows(docs.repartition(5), labels.repartition(3))
    net = quality_cnn.train(rows)
    got = quality_cnn.score_documents(docs, net).join(labels, "doc_id").where(quality_cnn.held_out("doc_id")).select("doc_id", "score", "quality").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)
    assert sum((r["score"] >= 0.5) == bool(r["quality"]) for r in got) >= 0.93 * len(got)
    for label in (0, 1):  # balanced accuracy
        right = [(r["score"] >= 0.5) == bool(label) for r in got if r["quality"] == label]
        assert sum(right) >= 0.9 * len(right)


def test_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(1)
    net = quality_cnn.Network.blank()
    net.taps, net.bias, net.dense = net.taps.astype(np.float64) * 3, net.bias.astype(np.float64) + 0.1, rng.normal(0, 1, quality_cnn.FILTERS)
    texts = [bytes(rng.integers(0, 9, n, np.uint8)) for n in (1, 3, 255, 256, 257, 900)]
    labels, weights = np.array([0, 1, 0, 1, 1, 0.0]), np.array([1, 2, 1, 2, 2, 1.0])

    def loss():
        chunks = quality_cnn.Chunks.of(texts)
        pool = np.maximum.reduceat(chunks.means(net), chunks.owner, axis=0)
        p = 1 / (1 + np.exp(-(pool @ net.dense + net.offset)))
        return -(weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum()

    taps, bias, dense, _ = quality_cnn._gradients(net, texts, labels, weights)
    for values, grads, places in ((net.taps, taps, [(0, 3, 1), (2, 0, 5), (3, 8, 7)]), (net.bias, bias, [(0,), (6,)]), (net.dense, dense, [(2,), (9,)])):
        for at in places:
            kept = values[at]
            values[at] = kept + 1e-3
            up = loss()
            values[at] = kept - 1e-3
            assert abs((up - loss()) / 2e-3 - grads[at]) < 1e-2 * max(1, abs(grads[at]))
            values[at] = kept


def test_batches_equal_single_texts():
    net = quality_cnn.Network.blank()
    net.dense[:] = 0.3
    texts = [r[1] or "" for r in awkward_rows()]
    assert np.allclose(quality_cnn.probabilities(net, texts), [quality_cnn.probability(net, t) for t in texts], atol=1e-6)
    # One text by the definition.
    x = np.frombuffer(texts[60].encode() + bytes(quality_cnn.WIDTH - 1), np.uint8)
    n, step = len(x) - quality_cnn.WIDTH + 1, quality_cnn.STEP
    out = np.maximum(sum(net.taps[k][x[k : n + k]] for k in range(quality_cnn.WIDTH)) + net.bias, 0)
    pool = np.max([out[at : at + 2 * step].mean(axis=0) for at in range(0, max(1, n - step), step)], axis=0)
    assert abs(1 / (1 + np.exp(-pool @ net.dense)) - quality_cnn.probability(net, texts[60])) < 1e-5


def test_slices_and_awkward_rows(spark, monkeypatch):
    net = quality_cnn.Network.blank()
    net.dense[:] = 0.3
    rows = awkward_rows()
    whole = {r[1]: quality_cnn.probability(net, r[1] or "") for r in rows}
    monkeypatch.setattr(quality_cnn, "SLICE", quality_cnn.STEP * 2)
    for text, p in whole.items():
        assert abs(quality_cnn.probability(net, text or "") - p) < 1e-5
    got = quality_cnn.score_documents(frame(spark, rows), net).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    some = quality_cnn.score_documents(frame(spark, rows).select("doc_id", "text", "source"), net, ("doc_id", "text", "source"), filter_below=2.0)
    assert some.count() == 0
    assert quality_cnn.score_documents(frame(spark, []), net).count() == 0


def test_no_labels(spark):
    docs = frame(spark, [(1, "a b", "s", "", "")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    net = quality_cnn.train(quality_cnn.training_rows(docs, none))
    assert quality_cnn.score_documents(docs, net).select(F.round("score", 6)).collect()[0][0] == 0.5
