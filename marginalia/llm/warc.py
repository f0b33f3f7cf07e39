"""WARC archives: a writer with revisit records, and a reader that verifies record boundaries by their chain.

Writing: a record is one row of Spark's text writer whose line end is the record's closing CRLF CRLF, so any file system
Spark writes to will do and no worker opens a file.

Reading: Spark's text reader, with the version line as delimiter, deals the files out in splits and gives the stretches
between version lines. Each is a *candidate* record: its header tells where its successor must start. A version line inside
a payload makes candidates that no record leads to. Pointer jumping from each file's start keeps the reachable ones:
in round k, everything reached so far is carried 2**k records on. Stretches of a record that a false candidate cut apart
are put together again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ensure_workers, text_or_empty

VERSION = "WARC/1.0\r\n"
_SEP = len(VERSION)

#: Rows, counted first, up to which a narrow table is sent to the stretches; beyond, both are sorted.
BROADCAST_ROWS = 100_000


def _header_value(c: Column) -> Column:
    """Without line ends, which would end the header line."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _marked(c: Column) -> Column:
    """A value that ends in the version text would, with its line's end, make the reader's delimiter: that gets a percent sign
    (``WARC/%1.0``), and one more what already has some, so that the reader can undo it."""
    return F.regexp_replace(c, r"WARC/(%*)1\.0\z", r"WARC/%$11.0")


_MARKED = re.compile(r"WARC/%(%*)1\.0\Z")


def write_warc(pages: DataFrame, path: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 100, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """A record per row under ``path``. Of rows with equal payloads of at least ``revisit_bytes`` bytes, that of the smallest id
    is a response (all rows of it, should the id repeat) and others are revisits that refer to it; smaller payloads are all responses.

    Null payload counts as empty, null url as an empty one, a null id as an empty one that is larger than others; rows of null
    id only are all responses. An empty table writes no record. Only the three named columns are read.
    """
    payload = text_or_empty(payload_col)
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).alias("n"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    large = keyed.where(F.col("n") >= revisit_bytes).select("digest", "id")
    firsts = large.groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and first is not null").select("d", "first")
    firsts = scratch.save(firsts, "firsts")
    rows = keyed.join(firsts.hint("merge"), (F.col("digest") == F.col("d")) & (F.col("n") >= revisit_bytes), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(_header_value(F.col(c).cast("string")), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    record = F.concat(
        F.lit(VERSION + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn("id"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), _marked(_header_value(text_or_empty("url"))),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn("first"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length,
        F.lit("\r\n\r\n"), http, F.when(revisit, "").otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


_LENGTH = re.compile(rb"(?:^|\r\n)content-length:[ \t]*(\d+)[ \t]*(?=\r\n|$)", re.I)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per version line: its stretch, where that starts in the split's text, and the lengths its header states."""
    at, local = None, 0
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("file", "split", "local", "seg_len", "head_len", "body_len", "seg")}
        for file, split, seg in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            first = (file, split) != at
            if first:
                at, local = (file, split), 0
            if not first or split > 0:
                end = seg.find(b"\r\n\r\n")
                found = _LENGTH.search(seg[:end]) if end >= 0 else None
                row = (file, split, local, len(seg), end + 4 if found else None, int(found[1]) if found else None, seg)
                for values, v in zip(out.values(), row, strict=True):
                    values.append(v)
            local += len(seg) + _SEP
        kinds = (pa.string(), *[pa.int64()] * 5, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


def _counted(df: DataFrame) -> DataFrame:
    return df.hint("broadcast" if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else "merge")


def reachable(chain: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, at) of what pointer jumping reaches from at = 0 in ``chain`` (file, at, next).

    All joins are sort-merge: file names compress so well that a table looks small enough to broadcast long after it isn't.
    """
    jump = scratch.save(chain, "jump")
    reached = scratch.save(chain.where("at = 0").select("file", "at").distinct(), "reached")
    count = reached.count()
    while count:
        ahead = reached.join(jump.hint("merge"), ["file", "at"]).select("file", F.col("next").alias("at"))
        new = ahead.join(chain.select("file", "at").hint("merge"), ["file", "at"], "left_semi").join(reached.hint("merge"), ["file", "at"], "left_anti")
        past = [reached]
        reached, before = scratch.save(reached.unionByName(new.distinct()), "reached"), count
        count = reached.count()
        if count == before:
            break
        over = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        past.append(jump)
        jump = scratch.save(jump.join(over.hint("merge"), ["file", "next"]).select("file", "at", F.col("far").alias("next")), "jump")
        for table in past:
            scratch.drop(table)
    return reached


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record stretches, whole, into fields."""
    for batch in batches:
        out: list[tuple] = []
        for file, at, head_len, body_len, seg in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            lines = seg[: head_len - 4].decode("utf-8", "replace").split("\r\n")
            head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            body = seg[head_len : head_len + body_len]
            http, _, payload = body.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", body)
            stated = _LENGTH.search(http)
            urn = lambda name: (m[1] or None) if (m := re.fullmatch(r"<urn:page:(.*)>", head.get(name, ""))) else None  # noqa: B023, E731
            digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
            out.append((file, at, head.get("warc-type"), urn("warc-record-id"), None if (url := head.get("warc-target-uri")) is None else _MARKED.sub(r"WARC/\g<1>1.0", url), urn("warc-refers-to"), digest, int(stated[1]) if stated else len(payload), payload))
        kinds = (pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary())
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], ["file", "offset", "record_type", "record_id", "url", "refers_to", "digest", "stated_bytes", "payload"])


def read_warc(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """The records of the archives under ``path``: file, offset, record_type, record_id, url, refers_to, digest (as the header
    states it), stated_bytes (of the full payload) and payload (empty for revisits).

    A file's records are those that the chain from its start reaches; the chain ends where a header states no length or no
    record follows, so what stands behind damage is left out. An empty file has no records. One archive's narrow rows (an offset
    and lengths a candidate) meet in one task, so archives should be of ordinary size.
    """
    ensure_workers(spark)
    lines = spark.read.option("lineSep", VERSION).text(path)
    raw = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("seg"))
    found = scratch.save(raw.mapInArrow(_candidates, "file string, split long, local long, seg_len long, head_len long, body_len long, seg binary"), "candidates")

    narrow = found.drop("seg")
    splits = narrow.groupBy("file", "split").agg(F.max(F.col("local") + F.col("seg_len") + _SEP).alias("size"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = scratch.save(splits.select(F.col("file").alias("f"), F.col("split").alias("s"), F.coalesce(before, F.lit(0)).alias("base")), "splits")
    at = F.col("base") + F.col("local") - _SEP
    placed = narrow.join(splits, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s"))).select("file", "split", "local", at.alias("at"), "head_len", "body_len", (at + _SEP + F.col("head_len") + F.col("body_len") + 4).alias("next"), (F.col("seg_len") >= F.col("head_len") + F.col("body_len")).alias("whole"))
    placed = scratch.save(placed, "placed")
    reached = reachable(placed.where("head_len is not null").select("file", "at", "next"), scratch)
    marked = scratch.save(placed.join(reached.withColumn("real", F.lit(True)).hint("merge"), ["file", "at"], "left"), "marked")

    # All candidates are records with their stretches whole, but for those in ``odd``. Stretches hold the payloads, so they aren't
    # shuffled for the few rows of ``odd``, ``splits`` and ``parts``.
    odd = marked.where("real is null or not whole").select("file", "split", "local")
    records = found.join(_counted(odd), ["file", "split", "local"], "left_anti")
    records = records.join(_counted(splits), (F.col("file") == F.col("f")) & (F.col("split") == F.col("s"))).select("file", at.alias("at"), "head_len", "body_len", "seg")
    if not marked.where("real and not whole").isEmpty():
        owner = F.last(F.when(F.col("real"), F.struct("at", "head_len", "body_len", "whole")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
        parts = marked.withColumn("owner", owner).where("owner is not null and not owner.whole").select("file", "split", "local", "at", "owner")
        parts = found.select("file", "split", "local", "seg").join(_counted(scratch.save(parts, "parts")), ["file", "split", "local"])
        joined = F.transform(F.array_sort(F.collect_list(F.struct("at", "seg"))), lambda p: p["seg"])
        merged = parts.groupBy("file", "owner").agg(joined.alias("segs"))
        whole = F.aggregate(F.slice("segs", 2, F.greatest(F.size("segs") - 1, F.lit(0))), F.element_at("segs", 1), lambda acc, x: F.concat(acc, F.lit(VERSION).cast("binary"), x))
        records = records.unionByName(merged.select("file", F.col("owner.at").alias("at"), F.col("owner.head_len").alias("head_len"), F.col("owner.body_len").alias("body_len"), whole.alias("seg")))
    return records.mapInArrow(_fields, "file string, offset long, record_type string, record_id string, url string, refers_to string, digest string, stated_bytes long, payload binary")
