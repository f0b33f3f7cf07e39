"""Session defaults: UTC, adaptive plans, skew handling."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(name: str = "marginalia", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
