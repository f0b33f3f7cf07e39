"""Byte-level convolutional quality classifier in numpy.

A text is its UTF-8 bytes. Each learned filter spans ``WIDTH`` bytes; as a byte has 256 values, a filter is a table
per tap and a convolution is a sum of table look-ups. Rectified responses are averaged over overlapping chunks of
``2 * STEP`` bytes that start every ``STEP`` bytes and cover the whole text. Channels are max-pooled over the chunks, and a
dense layer makes one probability of them.

Texts are laid end to end with ``WIDTH - 1`` zeros after each, so that one pass convolves a whole batch of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_workers, text_or_empty

WIDTH, FILTERS, STEP = 4, 12, 256
#: Bytes convolved at once; longer texts go through in slices of whole steps, so memory is bounded.
SLICE = 1 << 18
#: Bounds of the training sample: labelled rows, and bytes of a text used to learn from.
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 4000, 1 << 16


@dataclass
class Network:
    taps: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    dense: np.ndarray  # FILTERS
    offset: float

    @classmethod
    def blank(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0.0)

    def parameters(self) -> list[np.ndarray]:
        return [self.taps, self.bias, self.dense]


def respond(net: Network, x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Rectified filter responses at bytes lo..hi of x, which goes on for WIDTH - 1 bytes."""
    out = net.taps[0].take(x[lo:hi], axis=0)
    for k in range(1, WIDTH):
        out += net.taps[k].take(x[lo + k : hi + k], axis=0)
    out += net.bias
    return np.maximum(out, 0, out=out)


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass") or b"\0"


@dataclass
class Chunks:
    """Where the chunks of a batch of texts lie in its bytes ``x``."""

    x: np.ndarray
    steps: np.ndarray  # first byte of each step
    ends: np.ndarray  # and its end; a text's last step may be short
    lo: np.ndarray  # first and last step of each chunk
    hi: np.ndarray
    owner: np.ndarray  # first chunk of each text

    @classmethod
    def of(cls, texts: list[bytes]) -> Chunks:
        x = np.frombuffer((b"\0" * (WIDTH - 1)).join(texts) + b"\0" * (WIDTH - 1), np.uint8)
        sizes = np.array([len(t) for t in texts])
        start = np.cumsum(sizes + WIDTH - 1) - sizes - WIDTH + 1
        n_steps = -(-sizes // STEP)
        n_chunks = np.maximum(n_steps - 1, 1)
        first_step, first_chunk = np.cumsum(n_steps) - n_steps, np.cumsum(n_chunks) - n_chunks
        nth = lambda counts, firsts: np.arange(counts.sum()) - np.repeat(firsts, counts)
        steps = np.repeat(start, n_steps) + STEP * nth(n_steps, first_step)
        ends = np.minimum(steps + STEP, np.repeat(start + sizes, n_steps))
        lo = np.repeat(first_step, n_chunks) + nth(n_chunks, first_chunk)
        return cls(x, steps, ends, lo, lo + np.repeat(n_steps > 1, n_chunks), first_chunk)

    def means(self, net: Network) -> np.ndarray:
        """Mean response of each chunk to each filter. Bytes between texts belong to no step."""
        n = len(self.x) - WIDTH + 1
        sums = np.zeros((len(self.steps), FILTERS), np.float32)
        at = 0
        while at < len(self.steps):
            base = self.steps[at]
            stop = max(at + 1, int(np.searchsorted(self.ends, base + SLICE, "right")))
            out = respond(net, self.x, base, min(n, int(self.ends[stop - 1])))
            # Sums of bytes up to each step's end, without the gap that may follow.
            cuts = np.stack([self.steps[at:stop], self.ends[at:stop]], axis=1).ravel() - base
            padded = np.concatenate([out, np.zeros((1, FILTERS), np.float32)])
            sums[at:stop] = np.add.reduceat(padded, cuts, axis=0)[::2]
            at = stop
        total, size = sums[self.lo].copy(), (self.ends - self.steps)[self.lo]
        two = self.hi > self.lo
        total[two] += sums[self.hi[two]]
        size = size + np.where(two, (self.ends - self.steps)[self.hi], 0)
        return total / size[:, None].astype(np.float32)


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def probabilities(net: Network, texts: list[str]) -> np.ndarray:
    """The score of each text, whole; as many at a time as make a slice."""
    out, batch, held = [], [], 0

    def flush() -> None:
        chunks = Chunks.of(batch)
        pool = np.maximum.reduceat(chunks.means(net), chunks.owner, axis=0)
        out.append(_probability(pool.astype(np.float64) @ net.dense + net.offset))
        batch.clear()

    for text in texts:
        batch.append(_encoded(text))
        held += len(batch[-1])
        if held >= SLICE:
            flush()
            held = 0
    if batch:
        flush()
    return np.concatenate([np.zeros(0), *out])


def probability(net: Network, text: str) -> float:
    return float(probabilities(net, [text])[0])


def train(rows: list[tuple[str, int]], epochs: int = 6, least_steps: int = 300, batch: int = 32, rate: float = 0.06, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the log loss. rows: (text, 0 or 1), in an order that doesn't depend on the run. No rows: every score is 0.5. Few rows
    are gone through until least_steps. Rows count by the inverse of their label's share, so that neither label drowns the other.
    """
    net = Network.blank(seed)
    if not rows:
        return net
    rng = np.random.default_rng(seed)
    net.dense[:] = rng.normal(0, 0.5, FILTERS)
    labels = np.array([y for _, y in rows], np.float64)
    share = np.clip(labels.mean(), 0.02, 0.98)
    weights = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    epochs = max(epochs, -(-least_steps * batch // len(rows)))
    encoded = [_encoded(t) for t, _ in rows]
    params = [*net.parameters(), np.array([net.offset], np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(encoded))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            net.offset = float(params[3][0])
            grads = _gradients(net, [encoded[i] for i in chosen], labels[chosen], weights[chosen])
            step += 1
            lr = rate * min(1, step / 20) * (1 - epoch / epochs)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g / len(chosen) + decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(p.dtype)
    net.offset = float(params[3][0])
    return net


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Sums of a batch's gradients; through the max pool only each filter's winning chunk of a text gets any."""
    chunks = Chunks.of(texts)
    means = chunks.means(net)
    pool = np.maximum.reduceat(means, chunks.owner, axis=0)
    error = (_probability(pool @ net.dense + net.offset) - labels) * weights
    ends = np.append(chunks.owner[1:], len(means))
    taps, bias = np.zeros((WIDTH, 256, FILTERS)), np.zeros(FILTERS)
    # The bytes of all winning chunks, filter by filter.
    won = np.stack([means[a:b].argmax(axis=0) + a for a, b in zip(chunks.owner, ends, strict=True)])
    for f in range(FILTERS):
        lo, hi = chunks.steps[chunks.lo[won[:, f]]], chunks.ends[chunks.hi[won[:, f]]]
        sizes = hi - lo
        at = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        out = np.full(len(at), net.bias[f])
        for k in range(WIDTH):
            out += net.taps[k, :, f].take(chunks.x[at + k])
        back = np.repeat(error * net.dense[f] / sizes, sizes) * (out > 0)
        bias[f] = back.sum()
        for k in range(WIDTH):
            taps[k, :, f] = np.bincount(chunks.x[at + k], weights=back, minlength=256)
    return [taps.astype(np.float32), bias.astype(np.float32), (error @ pool).astype(np.float32), np.array([error.sum()], np.float32)]


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES) -> list[tuple[str, int]]:
    """A bounded sample of labelled rows outside the held-out third.

    The ``max_rows`` label rows of smallest hash, so the same ones in every run; texts over ``max_bytes`` are left out of
    learning (never of scoring). A document labelled both ways counts as 0, and of rows that repeat an id with different texts the
    least text is learned from. The sample's ids are broadcast: max_rows bounds them.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).where(F.octet_length("text") <= max_bytes)
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    return [(r["text"], r["quality"]) for r in sorted(got.limit(max_rows).collect(), key=lambda r: r["doc_id"])]


def score_documents(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", score_col: str = "score", filter_below: float | None = None) -> DataFrame:
    """Columns ``keep`` of every row and its ``score``; whole texts, no shuffle.

    Null text counts as empty; an empty text is one chunk of zero bytes and gets a score too. Null and repeated ids pass
    through. An empty table gives an empty one. ``score_col`` names the score, for tables that keep a column so called.
    filter_below: rows that score less are left out, which is how a pipeline rejects them.
    """
    ensure_workers(docs.sparkSession)
    schema = docs.select(*keep).schema.add(score_col, "double", False)
    # A text that is kept goes to the worker once.
    columns, where = (list(keep), keep.index(text_col)) if text_col in keep else ([*keep, text_col], len(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = probabilities(net, [t.as_py() or "" for t in batch.column(where)])
            out = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(scores)], names=[*keep, score_col])
            yield out if filter_below is None else out.filter(pa.array(scores >= filter_below))

    return docs.select(*columns).mapInArrow(run, schema)
