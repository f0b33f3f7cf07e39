"""Ordered parallel map, rate limiting, progress."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import share_package


class RateLimiter:
    """A token bucket: so many a second, with a burst. For sinks that talk to a service; one a partition, so give a sink one."""

    def __init__(self, per_second: float = 3, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.tokens, self._clock, self._sleep = per_second, burst, float(burst), clock, sleep
        self._at = clock()

    def wait(self) -> None:
        now = self._clock()
        self.tokens = min(self.burst, self.tokens + (now - self._at) * self.rate)
        self._at = now
        if self.tokens < 1:
            pause = (1 - self.tokens) / self.rate
            self._sleep(pause)
            self._at, self.tokens = self._at + pause, 1.0
        self.tokens -= 1


def parallel_map(df: DataFrame, f: Callable[[object], object], value: str = "value", result_type: str = "string", limiter: Callable[[], RateLimiter] | None = None) -> DataFrame:
    """``result`` and ``error`` of f for every row, an error per item; other columns, such as an ordinal to sort by, stay."""
    out_type = df.sparkSession.range(0).select(F.lit(None).cast(result_type).alias("r")).schema[0].dataType
    kind, names = to_arrow_type(out_type), df.columns
    at = names.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = limiter() if limiter else None
        for batch in batches:
            results, errors = [], []
            for x in batch.column(at).to_pylist():
                if limit:
                    limit.wait()
                try:
                    results.append(f(x))
                    errors.append(None)
                except Exception as e:  # an item's failure is its own
                    results.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, kind), pa.array(errors, pa.string())], [*names, "result", "error"])

    schema = T.StructType([*df.schema.fields, T.StructField("result", out_type), T.StructField("error", T.StringType())])
    share_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def progress(done: Column, total: Column, elapsed_seconds: Column) -> Column:
    """struct(percent, rate, eta_seconds); nothing done yet: no rate, no estimate."""
    rate = F.when((done > 0) & (elapsed_seconds > 0), done / elapsed_seconds)
    return F.struct(F.when(total > 0, 100.0 * done / total).otherwise(0.0).alias("percent"), rate.alias("rate"), ((total - done) / rate).alias("eta_seconds"))


def run_summary(results: DataFrame) -> DataFrame:
    """Counts by outcome: the row's action where it went well, else failed."""
    return results.groupBy(F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("action")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
