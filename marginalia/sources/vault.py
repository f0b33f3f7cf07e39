"""Folders of notes. Listing is by the file system; contents come in through Spark, a partition of paths at a time."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import glob_regex, ignored
from ..session import share_package

SCHEMA = "path string, abs_path string, size long, mtime timestamp"


def _walk(root: str, start: str = "") -> Iterator[tuple[str, str, int, int]]:
    """Files named ``*.md`` below a folder, not in folders whose names begin with a dot; the root's own name doesn't matter."""
    for folder, dirs, files in os.walk(os.path.join(root, start)):
        dirs[:] = sorted(d for d in dirs if not d.startswith("."))
        for name in sorted(files):
            if name.endswith(".md"):
                full = os.path.join(folder, name)
                stat = os.stat(full)
                yield os.path.relpath(full, root), full, stat.st_size, stat.st_mtime_ns // 1000


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, directory: str = "") -> DataFrame:
    """The notes of a vault; a folder that isn't there has none. Spark's own listing would hide names that begin with ``_`` or a dot."""
    rows = list(_walk(root, directory)) if os.path.isdir(os.path.join(root, directory)) else []
    df = spark.createDataFrame(rows, "path string, abs_path string, size long, mtime_us long").withColumn("mtime", F.timestamp_micros("mtime_us")).drop("mtime_us")
    return df.where(~ignored(F.col("path"), ignore)) if ignore else df


def scan_glob(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return scan(spark, root).where(F.col("path").rlike(glob_regex(pattern).replace("$", r"\z")))


def get_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    return scan(spark, root).where(F.col("path") == path)


def exists(root: str, path: str) -> bool:
    return os.path.exists(os.path.join(root, path))


def read(files: DataFrame) -> DataFrame:
    """``content`` of scanned files; null where a file went meanwhile. The folder must be one that executors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for path in batch.column(1).to_pylist():
                try:
                    texts.append(Path(path).read_bytes().decode("utf-8", "replace"))
                except FileNotFoundError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "content"])

    share_package(files.sparkSession)
    return files.select("path", "abs_path", "size", "mtime").mapInArrow(run, SCHEMA + ", content string")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Notes of a folder in any store Spark reads: path, content, mtime. Names that begin with ``_`` or a dot stay hidden."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    root = re.sub(r"^[a-z0-9]+:/*(?=/)", "", path).rstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("path"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("mtime"))


def write(files: DataFrame, root: str) -> DataFrame:
    """Writes (path, content) rows below a folder, with parents; returns (path, bytes). Runs where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path, content in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                to = Path(root, path)
                to.parent.mkdir(parents=True, exist_ok=True)
                data = (content or "").encode()
                to.write_bytes(data)
                to.chmod(0o644)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    share_package(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, bytes long")


def delete(root: str, path: str) -> None:
    os.remove(os.path.join(root, path))


def move(root: str, path: str, to: str) -> None:
    target = os.path.join(root, to)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    shutil.move(os.path.join(root, path), target)


def directories(root: str) -> list[str]:
    """Folders below the root, none whose name begins with a dot."""
    out = []
    for folder, dirs, _ in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith("."))
        out += [os.path.relpath(os.path.join(folder, d), root) for d in dirs]
    return sorted(out)
