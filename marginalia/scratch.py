"""Tables written to the cluster's shared folder, for steps that later ones read more than once and for loops."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; under a local master without one, as in tests, a folder of our own."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="marginalia-notes-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


class Scratch:
    """Written tables cut lineage: what is lost with an executor is at most the running stage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, step: str) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{step}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
