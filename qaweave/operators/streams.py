"""One block of rows held in a task while the rows of another side stream past it.

A cell is a block of the held side and a part of the passing side. Its rows lie next to
each other, the held ones first, so a task needs memory for the held block and for one
batch, however long the passing side is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

HELD, PASSING = 0, 1


def in_cells(rows: DataFrame, cell: list[str], *order: Column) -> DataFrame:
    """Rows with `cell` columns and a `side` dealt and sorted for `streamed`."""
    return rows.repartition(*cell).sortWithinPartitions(*cell, "side", *order)


def streamed(batches: Iterator[pa.RecordBatch], cell: list[str]) -> Iterator[tuple[pa.Table | None, Iterator[pa.RecordBatch]]]:
    """For each cell its held rows (None if there are none) and the passing batches.
    The batches of a cell must be read before the next cell."""
    parts = runs(batches, cell)
    ahead = next(parts, None)
    while ahead is not None:
        key, held = ahead[0], []
        while ahead is not None and ahead[0] == key and ahead[1] == HELD:
            held.append(ahead[2])
            ahead = next(parts, None)
        state = [ahead]

        def passing(key=key, state=state):
            while state[0] is not None and state[0][0] == key:
                yield state[0][2]
                state[0] = next(parts, None)

        rest = passing()
        yield (pa.Table.from_batches(held).combine_chunks() if held else None), rest
        for _ in rest:
            pass
        ahead = state[0]


def runs(batches, cell):
    """(cell, side, rows) for every run of rows alike in both."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c) for c in [*cell, "side"]]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        edges = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            *key, side = (c[a].as_py() for c in columns)
            yield tuple(key), side, batch.slice(a, b - a)


def matrix(column) -> np.ndarray:
    """A column of equally long lists of numbers as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class Best:
    """The best `k` passing rows of each held row so far, 12 bytes each. Of equal scores
    the first to come stays, so rows have to come in the order that settles ties."""

    #: Candidates that wait to be sorted in; entries sorted, and rows given back at a time.
    WAITING, AT_ONCE = 2_000_000, 1 << 18

    def __init__(self, n: int, k: int, least: float = -np.inf):
        self.n, self.k = n, k
        # What a newcomer has to exceed.
        self.limit = np.full(n, least)
        self._score, self._name = np.zeros((n, k)), np.full((n, k), -1, np.int32)
        self.names = np.zeros(0, object)
        self._new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._kept = self._size = 0

    def add(self, names: np.ndarray, row: np.ndarray, name: np.ndarray, score: np.ndarray) -> None:
        """Candidates: `name` counts in `names`, rows that came after all before."""
        keep = score > self.limit[row]
        if keep.any():
            used, code = np.unique(name[keep], return_inverse=True)
            self._new.append((row[keep].astype(np.int32), (code + len(self.names)).astype(np.int32), score[keep]))
            self.names = np.concatenate((self.names, names[used]))
            self._size += len(code)
        if self._size - self._kept > min(self.k * self.n, self.WAITING):
            self.settle()

    def settle(self) -> None:
        """Sorts the candidates in; `limit` is up to date then."""
        if not self._new:
            return
        row, name, score = (np.concatenate(x) for x in zip(*self._new))
        self._new = []
        order = np.argsort(row, kind="stable")
        row, name, score = row[order], name[order], score[order]
        first = np.searchsorted(row, np.arange(self.n + 1))
        load = np.cumsum(np.diff(first) + self.k)
        a = 0
        while a < self.n:
            b = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + self.AT_ONCE, side="right")))
            if first[b] > first[a]:
                self._sort_in(a, b, row[first[a]:first[b]], name[first[a]:first[b]], score[first[a]:first[b]])
            a = b
        there = self._name >= 0
        full = there[:, -1]
        self.limit[full] = self._score[full, -1]
        used = np.zeros(len(self.names), bool)
        used[self._name[there]] = True
        self._name[there] = (np.cumsum(used, dtype=np.int32) - 1)[self._name[there]]
        self.names = self.names[used]
        self._kept = self._size = int(there.sum())

    def _sort_in(self, a, b, row, name, score) -> None:
        """New candidates of the rows from a to b join those that are kept."""
        old = np.nonzero(self._name[a:b] >= 0)
        row = np.concatenate((old[0], row - a))
        name = np.concatenate((self._name[a:b][old], name))
        score = np.concatenate((self._score[a:b][old], score))
        order = np.lexsort((name, -score, row))
        row, name, score = row[order], name[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(b - a))[row]
        keep = place < self.k
        self._name[a:b][row[keep], place[keep]] = name[keep]
        self._score[a:b][row[keep], place[keep]] = score[keep]

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Held row, name and score of all that stay, a bounded number at a time."""
        self.settle()
        step = max(1, self.AT_ONCE // self.k)
        for a in range(0, self.n, step):
            row, place = np.nonzero(self._name[a:a + step] >= 0)
            yield row + a, self.names[self._name[row + a, place]], self._score[row + a, place]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Held row, name and score of all that stay."""
        return tuple(np.concatenate(x) for x in zip(*self.parts())) if self.n else (np.zeros(0, np.int64), self.names, np.zeros(0))


class Deep:
    """The best `k` passing rows of each held row, 12 bytes each, for candidates of one held
    row at a time. Of equal scores above 0 the first to come stays."""

    #: Rows given back at a time.
    AT_ONCE = 1 << 18

    def __init__(self, n: int, k: int, least: float = 0.0):
        self.n, self.k = n, k
        # What a newcomer has to exceed.
        self.limit = np.full(n, least)
        self._score, self._name, self._size = np.empty((n, k)), np.empty((n, k), np.int32), np.zeros(n, np.int64)
        self._names: list[pa.Array] = []
        self._first = self._base = 0

    def open(self, names: pa.Array) -> None:
        """Names that the candidates from now on count in, rows that came after all before.
        Names that no kept row bears go where they are many."""
        if self._first > 2 * self.n * self.k + (1 << 16):
            there = np.arange(self.k) < self._size[:, None]
            used, code = np.unique(self._name[there], return_inverse=True)
            self._name[there] = code
            self._names, self._first = [self.names().take(pa.array(used))], len(used)
        self._base = self._first
        self._names.append(names)
        self._first += len(names)

    def add(self, row: int, name: np.ndarray, score: np.ndarray) -> None:
        """Candidates of a held row, in the order they came."""
        keep = score > self.limit[row]
        if not keep.any():
            return
        m = int(self._size[row])
        score = np.concatenate((self._score[row, :m], score[keep]))
        name = np.concatenate((self._name[row, :m], (name[keep] + self._base).astype(np.int32)))
        if len(score) > self.k:
            least = np.partition(score, -self.k)[-self.k]
            keep = score > least
            keep[np.flatnonzero(score == least)[:self.k - np.count_nonzero(keep)]] = True
            score, name = score[keep], name[keep]
        n = len(score)
        self._score[row, :n], self._name[row, :n], self._size[row] = score, name, n
        if n == self.k:
            self.limit[row] = score.min()

    def names(self) -> pa.Array:
        return pa.concat_arrays(self._names) if self._names else pa.array([], pa.string())

    def of(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Name (its place in `names`) and score of what stays of a held row, best first."""
        m = self._size[row]
        name, score = self._name[row, :m], self._score[row, :m]
        order = np.lexsort((name, -score))
        return name[order], score[order]
