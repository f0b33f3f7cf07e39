"""Requests sent to a remote workspace from a batch or a stream, each once, within one rate for the whole cluster.

``df.write.format("workspace_requests")`` and ``writeStream`` alike take rows (request_id, kind, body) and the options

* service: ``module:class``, made with ``path`` once a task; its ``send(request_id, kind, body)`` returns a text, such as a new page's id;
* path: the service's address; ledger: a folder that every task can reach;
* perSecond, writers: the rate over all tasks, and how many partitions at most the rows come in.

The ledger holds two small files a request: one from before it is sent, one with the answer. A request that has its answer is never
sent again, so a replayed micro-batch or a task's second attempt goes on where the first one ended. One that was begun but has no
answer may or may not have arrived; it is left alone and listed (``ledger``), unless ``resend`` says that sending it again does no
harm. Rates are a few requests a second, so the files are no burden.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import import_module

import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..session import share_package

REQUEST = "request_id string, kind string, body string"


class Slots:
    """One writer's share of a rate: of the times ``start + n / per_second`` every ``of``-th is its own, from the ``index``-th on.

    All writers together never send more than the rate, without a word between them, as far as their clocks agree.
    """

    def __init__(self, per_second: float, index: int, of: int, start: float, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        if not 0 <= index < of:
            raise ValueError(f"writer {index} of {of}: the rows come in more partitions than the option writers says")
        self._every, self._first, self._clock, self._sleep = of / per_second, start + index / per_second, clock, sleep
        self._next = 0

    def wait(self) -> None:
        now = self._clock()
        self._next = max(self._next, math.ceil((now - self._first) / self._every - 1e-9))
        at = self._first + self._next * self._every
        self._next += 1
        if at > now:
            self._sleep(at - now)


class Ledger:
    """Which requests were begun and which have an answer."""

    def __init__(self, path: str):
        self._fs, self._root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def _file(self, kind: str, request_id: str) -> str:
        name = hashlib.sha256(request_id.encode()).hexdigest()
        return f"{self._root}/{kind}/{name[:2]}/{name}.json"

    def _put(self, file: str, what: dict) -> None:
        self._fs.create_dir(file.rpartition("/")[0], recursive=True)
        with self._fs.open_output_stream(file) as out:
            out.write((json.dumps(what) + "\n").encode())

    def _has(self, file: str) -> bool:
        return self._fs.get_file_info(file).type == fs.FileType.File

    def state(self, request_id: str) -> str:
        """done, begun or new."""
        if self._has(self._file("done", request_id)):
            return "done"
        return "begun" if self._has(self._file("begun", request_id)) else "new"

    def begin(self, request_id: str) -> None:
        self._put(self._file("begun", request_id), {"request_id": request_id})

    def end(self, request_id: str, answer: str | None) -> None:
        self._put(self._file("done", request_id), {"request_id": request_id, "answer": answer})

    def forget(self, request_id: str) -> None:
        """For a request that the service refused: it did not arrive."""
        self._fs.delete_file(self._file("begun", request_id))

    def commit(self, batch: int, totals: dict[str, int]) -> None:
        self._put(f"{self._root}/batches/{batch}.json", {"batch": batch, **totals})


class Refused(Exception):
    """A service raises this if a request certainly changed nothing, such as one turned away for its rate."""


def send_all(rows: Iterator[Row], service: object, ledger: Ledger, wait: Callable[[], None], resend: bool = False, tries: int = 3) -> dict[str, int]:
    """Counts of sent, skipped (done before), unsure (begun before) and failed rows. A refusal is tried again; any other error ends
    the task, and leaves its request begun."""
    n = dict.fromkeys(("sent", "skipped", "unsure", "failed"), 0)
    for row in rows:
        state = ledger.state(row["request_id"])
        if state == "done" or state == "begun" and not resend:
            n["skipped" if state == "done" else "unsure"] += 1
            continue
        for left in reversed(range(tries)):
            wait()
            ledger.begin(row["request_id"])
            try:
                answer = service.send(row["request_id"], row["kind"], row["body"])
            except Refused:
                ledger.forget(row["request_id"])
                n["failed"] += not left
                continue
            ledger.end(row["request_id"], answer)
            n["sent"] += 1
            break
    return n


@dataclass
class Sent(WriterCommitMessage):
    counts: dict[str, int]


class _Requests:
    def __init__(self, options: dict[str, str]):
        # Spark hands option names over in lower case.
        self.options = {k.lower(): v for k, v in options.items()}
        for needed in ("service", "ledger"):
            if needed not in self.options:
                raise ValueError(f"option {needed} is missing")
        self.start = time.time()

    def write(self, iterator: Iterator[Row]) -> Sent:
        module, _, name = self.options["service"].partition(":")
        service = getattr(import_module(module), name)(self.options.get("path"))
        slots = Slots(float(self.options.get("persecond", 3)), TaskContext.get().partitionId(), int(self.options.get("writers", 1)), self.start)
        return Sent(send_all(iterator, service, Ledger(self.options["ledger"]), slots.wait, self.options.get("resend", "false") == "true"))

    def totals(self, messages: list[Sent | None]) -> dict[str, int]:
        n: dict[str, int] = {}
        for m in messages:
            for k, v in (m.counts if m else {}).items():
                n[k] = n.get(k, 0) + v
        return n


class _BatchWriter(_Requests, DataSourceWriter):
    def commit(self, messages: list[Sent | None]) -> None:
        if (n := self.totals(messages)).get("failed"):
            raise RuntimeError(f"the service refused {n['failed']} requests")


class _StreamWriter(_Requests, DataSourceStreamWriter):
    def commit(self, messages: list[Sent | None], batchId: int) -> None:
        """The batch's totals, once all its tasks are through; a refused request fails the batch, which runs again."""
        if (n := self.totals(messages)).get("failed"):
            raise RuntimeError(f"the service refused {n['failed']} requests")
        Ledger(self.options["ledger"]).commit(batchId, n)

    def abort(self, messages: list[Sent | None], batchId: int) -> None:
        """What was sent stays in the ledger, so the batch's next run leaves it out."""


class WorkspaceRequests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workspace_requests"

    def schema(self) -> str:
        return REQUEST

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(self.options)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options)


class Outbox:
    """A service that leaves each request as a file of its own in a folder, for something else to carry on."""

    def __init__(self, path: str):
        self._fs, self._root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self._fs.create_dir(self._root, recursive=True)

    def send(self, request_id: str, kind: str, body: str) -> str:
        name = f"{hashlib.sha256(request_id.encode()).hexdigest()}-{time.time_ns()}"
        with self._fs.open_output_stream(f"{self._root}/{name}.json") as out:
            out.write((json.dumps({"request_id": request_id, "kind": kind, "body": body}) + "\n").encode())
        return name


def register(spark: SparkSession) -> None:
    share_package(spark)
    spark.dataSource.register(WorkspaceRequests)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(request_id, state, answer): done, or begun where no answer came."""
    begun = spark.read.schema("request_id string").json(f"{path}/begun/*")
    done = spark.read.schema("request_id string, answer string").json(f"{path}/done/*")
    return begun.join(done, "request_id", "full_outer").select("request_id", F.when(F.col("answer").isNull(), "begun").otherwise("done").alias("state"), "answer")


def append_requests(batches: DataFrame, page: str = "page_id", block: str = "block_id") -> DataFrame:
    """Rows for the sink from ``batch`` and ``batch_pos`` of blocks (``remote.append_batches``): one request a batch, of at most a hundred
    blocks. Its id names page, batch and blocks, so the same content is the same request."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("batch_pos", block))), lambda x: x[block])
    rows = batches.groupBy(page, "batch").agg(ids.alias("ids")).withColumn("body", F.to_json(F.struct(F.col(page).alias("page"), F.col("ids").alias("children"))))
    return rows.select(F.concat_ws(":", page, "batch", F.sha2("body", 256)).alias("request_id"), F.lit("append").alias("kind"), "body")
