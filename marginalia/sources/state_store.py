"""The state database as a folder of parquet snapshots, one a table; a write is a new version, and a pointer names the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema

TABLES = {"sync_state": schema.SYNC_STATE, "links": schema.LINKS, "page_aliases": schema.PAGE_ALIASES, "sync_history": schema.SYNC_HISTORY, "config": "key string, value string"}


class StateStore:
    """Tables under a folder of any store that Spark writes. Readers see a version whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, table: str) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not self._fs.exists(p):
            return []
        names = [s.getPath() for s in self._fs.listStatus(p)]
        done = lambda q: self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(q, "_SUCCESS"))
        return sorted(int(q.getName()[1:]) for q in names if q.getName().startswith("v") and done(q))

    def read(self, table: str) -> DataFrame:
        versions = self._versions(table)
        if not versions:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}/v{versions[-1]}")

    def write(self, table: str, df: DataFrame, keep: int = 2) -> None:
        """A new version; older ones but ``keep`` go."""
        versions = self._versions(table)
        columns = self.spark.createDataFrame([], TABLES[table]).columns
        df.select(*columns).write.parquet(f"{self.path}/{table}/v{(versions[-1] if versions else 0) + 1}")
        for old in [*versions][: max(0, len(versions) + 1 - keep)]:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/v{old}"), True)
