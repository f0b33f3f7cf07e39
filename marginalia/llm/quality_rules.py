"""Quality rules as a short-circuit cascade.

A document first gets its base counts. One that fails the base rules is done. The others go through further rules, cheapest
way first: on a bounded sample, the rows of least text hash, each rule's cost beyond the counts and the share it rejects of what
the rules before it let through are measured, and rules run in order of rejections per cost. A document leaves the cascade
at the first rule that rejects it. The order decides what is
computed, never the verdict, so results don't depend on timings or on the sample.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_workers, text_or_empty

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Rows of the sample that orders the rules, and characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 20_000
_LETTERS, _CAPITALS = regex.compile(r"\p{L}+"), regex.compile(r"\p{Lu}+")


@dataclass
class Document:
    text: str
    words: list[bytes] = field(init=False)

    def __post_init__(self) -> None:
        self.words = self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that stand in a 3-word window found twice or more."""
        n = len(self.words)
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        size = len(number)
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        _, window, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
        twice = counts[window] > 1
        marked = np.zeros(n, bool)
        for k in range(3):
            marked[k : n - 2 + k] |= twice
        return int(marked.sum())

    @cached_property
    def base_failed(self) -> bool:
        return len(self.words) < 50 or 100 * self.n_repeat_words > 50 * len(self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


def _shouts(d: Document) -> bool:
    return 2 * sum(map(len, _CAPITALS.findall(d.text))) > sum(map(len, _LETTERS.findall(d.text)))


#: Rejected: over a twentieth of the characters are symbols; over half the lines repeat; words of under 2 or over 15
#: characters on average; over half the letters are capitals.
RULES = (
    Rule("symbols", lambda d: 20 * d.n_symbols > d.word_chars),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    Rule("word_length", lambda d: not 2 * len(d.words) <= d.word_chars <= 15 * len(d.words)),
    Rule("capitals", _shouts),
)


def _counted(text: str) -> Document:
    """A document with the counts that every row gets, whatever its verdict."""
    d = Document(text)
    d.word_chars, d.n_symbols, d.n_dup_lines, d.base_failed  # noqa: B018
    return d


def order_rules(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """The rules by rejections per second on the sample, best first: each among documents that those before it let through. Ties,
    and rules on nothing that is left, stay as they are."""
    docs, left, ordered = [d for d in map(_counted, texts) if not d.base_failed], list(rules), []
    while left:
        worth = []
        for rule in left:
            began = time.perf_counter()
            rejected = sum(map(rule.rejects, docs))
            worth.append(rejected / max(time.perf_counter() - began, 1e-9))
        best = left.pop(worth.index(max(worth)))
        ordered.append(best)
        docs = [d for d in docs if not best.rejects(d)]
    return ordered


def verdict(d: Document, rules: list[Rule]) -> str | None:
    """The first rule that rejects the document."""
    if d.base_failed:
        return "base"
    return next((r.name for r in rules if r.rejects(d)), None)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and rejected_by.

    Null text counts as empty; texts of under 50 words fail the base rules. Repeated rows and null ids pass through. An empty
    table gives an empty one. Only the two named columns are read. rejected_by depends on the order of the rules, nothing else does.
    """
    ensure_workers(docs.sparkSession)
    text = docs.select(text_or_empty(text_col).alias("text"))
    sample = text.select(F.xxhash64("text").alias("h"), F.left("text", F.lit(SAMPLE_CHARS)).alias("text")).orderBy("h", "text").limit(sample_rows)
    ordered = order_rules([r["text"] for r in sample.collect()], rules)
    columns = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "rejected_by": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                d = Document(t.as_py())
                by = verdict(d, ordered)
                rows.append((len(d.words), d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed, by is None, by))
            values = list(zip(*rows, strict=True)) or [[]] * len(columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(values, columns.values(), strict=True))], [id_col, *columns])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
