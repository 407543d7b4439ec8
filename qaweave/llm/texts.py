"""Words, slices of Arrow batches and array hashes that several operators share.

A word is a longest run of characters other than the blank and U+0009 to U+000D;
`bytes.split()` cuts UTF-8 at just these bytes.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: A missing doc_id is ordered behind all others.
LAST_ID = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def kept_in_worker(name: str, make: Callable):
    """What `make` returns, made once in a Python worker. A worker runs many tasks, and
    each brings its own copy of this module; `sys` is what they share."""
    kept = sys.__dict__.setdefault("_qaweave_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def fresh(docs: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `docs` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (all columns of `docs`), id and th: nothing can clash with the columns inside."""
    row = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row")
    return docs.select(row, *row_key(docs, id_col, text_col))


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """What tells rows apart: the id (a missing one last) and a hash of the text (a
    missing one empty). Rows alike in both get the same decisions."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return [F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("th")]


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of a slice hold about `limit` bytes. A longer text
    is a slice of its own, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def encoded(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; a missing text is empty."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the word, so that low bits and order are even."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """The words of many documents as one byte array, with a hash of any span of them.

    `docs` are lists of words. Word i covers bytes starts[i] to ends[i] of the words
    joined by single blanks; first[d] is the number of words before document d.
    """

    def __init__(self, docs: list[list[bytes]]):
        self.counts = np.fromiter(map(len, docs), np.int64, len(docs))
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.total = int(self.first[-1])
        self.joined = b" ".join([b" ".join(d) for d in docs if d])
        data = np.frombuffer(self.joined, np.uint8)
        blank = np.flatnonzero(data == 32)
        if self.total:
            self.starts = np.concatenate(([0], blank + 1))
            self.ends = np.concatenate((blank, [len(data)]))
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        size = len(data) + 1
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _ODD))))
        self._sums = np.zeros(size, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self._sums[1:])
        self._back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _ODD_INVERSE))))

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans from word `first` to word `last`, both within."""
        a = self.starts[first]
        return mixed((self._sums[self.ends[last]] - self._sums[a]) * self._back[a])

    def document_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def window_starts(self, size: int) -> np.ndarray:
        """First words of all windows of `size` words that lie in one document."""
        per = np.maximum(self.counts - size + 1, 0)
        ahead = np.repeat(self.first[:-1] - np.concatenate(([0], np.cumsum(per)[:-1])), per)
        return np.arange(int(per.sum())) + ahead
