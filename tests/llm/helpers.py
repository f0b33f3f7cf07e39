"""Small documents with every awkward case: nulls, empties, ties, repeats, long texts, clashing columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("score", T.StringType())])
SF = "/root/testdata/sf0.001"


def awkward_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = ["alpha", "Béta", "gamma!", "ΔELTA", "eps", "漢字", "a|b", "x" * 30]
    texts = [None, "", " \t\n", "one", "one two", "One two three", "one\ntwo\nthree four", "same text here now", "same text here now", "a" * 20000, "word " * 9000]
    for _ in range(60):
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))))
    texts += texts[-5:] * 3
    long = " ".join(rng.choice(words) for _ in range(20000))
    texts += [long, long, long + "!"]
    base = [rng.choice(words) + str(rng.randint(0, 50)) for _ in range(800)]
    for k in range(12):
        near = list(base)
        near[k * 7] = "changed"
        texts.append(" ".join(near))
    rows = [(i, t, rng.choice(["s1", "s2", None]), "extra", "clash") for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, "no id", "s1", None, None), (None, "same text here now", None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)
