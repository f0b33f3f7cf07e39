"""Byte-level BPE as a monoid over text pieces.

``encode`` halves a text until a piece is a leaf of at most ``LEAF`` characters, encodes the leaves and joins neighbours up
the tree. A join looks at a window around the seam that grows on each side until it ends at a *stable cut*: a place that
ends a pre-token whatever stands left or right of it. Tokens outside the window are then provably those of the whole text.

Stable cuts for the pre-token pattern (letters L, numbers N, white space S, other O): no match holds a non-space character
and white space after it, none that holds an L or N goes on into another class, and one that holds an O goes on into L only
as a contraction, which starts with an apostrophe. So a cut stands before white space that follows a non-space, between N
and anything but N, between L and anything but L, and between O (not an apostrophe) and L or N.

The window is cut into pre-tokens anew. One that either side had already encoded up to the seam is joined from those
tokens, so a pre-token of any length is never encoded twice: the join re-encodes a window of a few tokens at the seam and
lets it grow until the pair of tokens across each of its ends encodes to itself. A token sequence is the encoding of its
bytes iff all adjacent pairs are, so the rest stands. Other pre-tokens are encoded from their halves of bytes by the
same join, down to leaves of ``LEAF_BYTES`` bytes merged by rank, and remembered.

Decoding concatenates byte strings up the same kind of tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_workers, text_or_empty

LEAF = 256
LEAF_BYTES = 16
LEAF_IDS = 64
#: Pre-tokens of up to this many characters are remembered, so many at a time.
MEMO_CHARS, MEMO_SIZE = 64, 1 << 19

_SPACE = regex.compile(r"\s")
_LETTER = regex.compile(r"\p{L}")
_NUMBER = regex.compile(r"\p{N}")


@functools.cache
def _kind(ch: str) -> str:
    if _SPACE.match(ch):
        return "S"
    if _LETTER.match(ch):
        return "L"
    return "N" if _NUMBER.match(ch) else "O"


def is_stable_cut(text: str, at: int) -> bool:
    """Whether a pre-token ends at ``at`` in every text that holds text[at-1:at+1] there."""
    before, after = _kind(text[at - 1]), _kind(text[at])
    if before == "S" or before == after:
        return False
    return before != "O" or after == "S" or text[at - 1] != "'"


class BytePairCodec:
    """Encoder and decoder for a rank file. ``pattern`` must be the pre-token pattern above."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self._ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._words = [b""] * (max(self._ranks.values()) + 1)
        for word, i in self._ranks.items():
            self._words[i] = word
        self._lengths = [len(w) for w in self._words]
        self._split = regex.compile(pattern).findall
        self._decimal = [str(i) for i in range(len(self._words))]
        self._memo: dict[str, list[int]] = {}
        self._merged: dict[bytes, list[int]] = {}

    # bytes of one pre-token

    def _merge(self, data: bytes) -> list[int]:
        """The encoding of some bytes: the adjacent pair of least rank merges, the first of equals, until none can."""
        if (ids := self._merged.get(data)) is not None:
            return ids
        ranks, n = self._ranks, len(data)
        # A part is known by its first byte; pairs wait in a heap and are void once either part has merged.
        end, before = list(range(1, n + 1)), list(range(-1, n))
        waiting = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, stop = heapq.heappop(waiting)
            middle = end[i]
            if middle <= 0 or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle], before[stop] = stop, 0, i
            if i > 0 and (rank := ranks.get(data[before[i] : stop])) is not None:
                heapq.heappush(waiting, (rank, before[i], stop))
            if stop < n and (rank := ranks.get(data[i : end[stop]])) is not None:
                heapq.heappush(waiting, (rank, i, end[stop]))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : end[i]]])
            i = end[i]
        if n <= MEMO_CHARS:
            if len(self._merged) >= MEMO_SIZE:
                self._merged.clear()
            self._merged[data] = ids
        return ids

    def _bytes(self, data: bytes, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF_BYTES:
            return self._merge(data[lo:hi])
        mid = (lo + hi) // 2
        return self._join_bytes(self._bytes(data, lo, mid), self._bytes(data, mid, hi))

    def _join_bytes(self, left: list[int], right: list[int]) -> list[int]:
        words, size = self._words, 1
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            seam = self._merge(b"".join([words[t] for t in left[i:]] + [words[t] for t in right[:j]]))
            left_holds = i == 0 or self._merge(words[left[i - 1]] + words[seam[0]]) == [left[i - 1], seam[0]]
            right_holds = j == len(right) or self._merge(words[seam[-1]] + words[right[j]]) == [seam[-1], right[j]]
            if left_holds and right_holds:
                return left[:i] + seam + right[j:]
            size *= 2

    def _piece(self, piece: str) -> list[int]:
        """The encoding of a pre-token."""
        ids = self._memo.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self._ranks.get(data)
            ids = [whole] if whole is not None else self._bytes(data, 0, len(data))
            self._remember(piece, ids)
        return ids

    def _remember(self, piece: str, ids: list[int]) -> None:
        if len(piece) <= MEMO_CHARS:
            if len(self._memo) >= MEMO_SIZE:
                self._memo.clear()
            self._memo[piece] = ids

    # text

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF:
            memo, ids = self._memo, []
            for piece in self._split(text[lo:hi]):
                ids += memo.get(piece) or self._piece(piece)
            return ids
        mid = (lo + hi) // 2
        left = self._tree(text, lo, mid)
        self._join(text, lo, mid, hi, left, self._tree(text, mid, hi))
        return left

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> None:
        """Joins ``right`` to ``left``, in place."""
        start, end = mid - 1, mid + 1
        while start > lo and not is_stable_cut(text, start):
            start -= 1
        while end < hi and not is_stable_cut(text, end):
            end += 1
        before, after = text[start:mid], text[mid:end]
        m, n = len(left) - self._count(before, reversed(left)), self._count(after, right)
        window = self._window(before, after, left[m:], right[:n])
        left[m:] = window
        left += right[n:]

    def _window(self, before: str, after: str, a: list[int], b: list[int]) -> list[int]:
        """The ids of before + after, which stands between stable cuts, from those of its two sides."""
        pieces = self._split(before + after)
        known = [self._memo.get(p) for p in pieces]
        had: dict[tuple[int, int], list[int]] = {}
        seam = len(before)
        if None in known:
            for place, side, ids in ((0, before, a), (seam, after, b)):
                at = 0
                for piece in self._split(side):
                    n = self._count(piece, itertools.islice(ids, at, None))
                    had[place, place + len(piece)] = ids[at : at + n]
                    at, place = at + n, place + len(piece)
        out: list[int] = []
        place = 0
        for piece, ids in zip(pieces, known, strict=True):
            until = place + len(piece)
            if ids is None:
                ids = had.get((place, until))
            if ids is None and (place, seam) in had and (seam, until) in had:
                whole = self._ranks.get(piece.encode("utf-8", "surrogatepass"))
                ids = [whole] if whole is not None else self._join_bytes(had[place, seam], had[seam, until])
                self._remember(piece, ids)
            out += self._piece(piece) if ids is None else ids
            place = until
        return out

    def _count(self, text: str, ids: Iterable[int]) -> int:
        """How many of the ids make up the text's bytes."""
        left, n = len(text.encode("utf-8", "surrogatepass")), 0
        for i in ids:
            if left <= 0:
                break
            left -= self._lengths[i]
            n += 1
        return n

    # decoding

    def decode(self, ids: list[int]) -> bytes:
        return self._untree(ids, 0, len(ids))

    def _untree(self, ids: list[int], lo: int, hi: int) -> bytes:
        if hi - lo <= LEAF_IDS:
            words = self._words
            return b"".join([words[i] for i in ids[lo:hi]])
        mid = (lo + hi) // 2
        return self._untree(ids, lo, mid) + self._untree(ids, mid, hi)

    def decimal(self, ids: list[int]) -> str:
        names = self._decimal
        return " ".join([names[i] for i in ids])


@functools.cache
def codec(ranks_path: str, pattern: str) -> BytePairCodec:
    """One codec per Python worker."""
    return BytePairCodec(ranks_path, pattern)


_KINDS = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.binary(), "decoded_sha256": pa.string()}
_DDL = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, columns: tuple[str, ...] = ("ids", "n_tokens", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again: one row per row of ``docs``, no shuffle.

    columns: any of ids, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded (bytes) and
    decoded_sha256. ``ranks_path`` must be readable under the same path on each executor.

    Null text counts as empty: no ids, and the digests of nothing. Ids of rows pass through, null ones too, and
    repeated rows stay. An empty table gives an empty one. Other columns of ``docs`` aren't read, whatever their names.
    Text of any length is encoded whole; its tree keeps each step's window small.
    """
    ensure_workers(docs.sparkSession)
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for text in batch.column(1):
                ids = c.encode(text.as_py())
                back = c.decode(ids) if "decoded" in out or "decoded_sha256" in out else b""
                for n, rows in out.items():
                    if n == "ids":
                        rows.append(ids)
                    elif n == "n_tokens":
                        rows.append(len(ids))
                    elif n == "ids_sha256":
                        rows.append(hashlib.sha256(c.decimal(ids).encode()).hexdigest())
                    elif n == "decoded":
                        rows.append(back)
                    else:
                        rows.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, _KINDS[n]) for n, v in out.items())], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_or_empty(text_col).alias(text_col)).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{n} {_DDL[n]}" for n in names)]))
