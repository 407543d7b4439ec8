"""Substring dedup by super-k-mer partitioning: repeated windows of words are removed."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaweave.llm.texts import Words, encoded, row_key, sliced
from qaweave.session import stored

_SPANS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("minimiser", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])
_PACKED = pa.schema([("minimiser", pa.int64()), ("hot", pa.bool_()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])
_CUTS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_ONE = pa.schema([("h", pa.binary()), ("id", pa.int64()), ("th", pa.int64()), ("first", pa.int32())])


def _spark(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def super_kmers(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of one document with one minimiser, the least hash of
    the `gram`-word runs in a window: (first word, windows, minimiser)."""
    starts = words.window_starts(window)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    at = np.arange(words.total - gram + 1)
    least = sliding_minimum(words.hashes(at, at + gram - 1), window - gram + 1)[starts]
    new = np.concatenate(([True], (starts[1:] != starts[:-1] + 1) | (least[1:] != least[:-1])))
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.concatenate((first, [len(starts)]))), least[first]


def spans(docs: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """The super-k-mers of every document, without their words."""

    def run(batches):
        for batch in sliced(batches):
            words = Words([t.split() for t in encoded(batch)])
            start, count, least = super_kmers(words, window, gram)
            of = np.searchsorted(words.first, start, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(of)), batch.column("th").take(pa.array(of)), pa.array(least.view(np.int64)),
                 pa.array((start - words.first[of]).astype(np.int32)), pa.array(count.astype(np.int32))], schema=_SPANS)

    base = docs.select(*row_key(docs, id_col, text_col), docs[text_col].alias("text"))
    return base.mapInArrow(run, _spark(_SPANS))


def packed(docs: DataFrame, wanted: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """The words of chosen super-k-mers, each as one string. Rows alike in id and text want
    the same ones, each once."""
    per_row = wanted.groupBy("id", "th").agg(F.collect_set(F.struct("minimiser", "hot", "start", "windows")).alias("want"))
    keyed = docs.select(*row_key(docs, id_col, text_col), docs[text_col].alias("text"))

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for doc_id, th, text, want in zip(*(batch.column(c).to_pylist() for c in ("id", "th")), encoded(batch), batch.column("want").to_pylist()):
                words = text.split()
                for w in want:
                    part = b" ".join(words[w["start"]:w["start"] + w["windows"] + window - 1])
                    rows.append((w["minimiser"], w["hot"], doc_id, th, w["start"], part))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED)], schema=_PACKED)

    return keyed.join(per_row, ["id", "th"]).select("id", "th", "text", "want").mapInArrow(run, _spark(_PACKED))


def window_ranks(strings: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact classes of all windows: (class, string, place). Runs of 1, 2, 4, ... words are
    sorted and numbered by the numbers of their halves, so equal numbers mean equal words."""
    numbers: dict[bytes, int] = {}
    rank = np.fromiter((numbers.setdefault(w, len(numbers)) for s in strings for w in s), np.int64)
    counts = np.fromiter(map(len, strings), np.int64, len(strings))
    first = np.cumsum(counts) - counts
    per = np.maximum(counts - window + 1, 0)
    of = np.repeat(np.arange(len(strings)), per)
    place = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].reshape(-1) if len(a) else a

    span = 1
    while 2 * span <= window:
        rank = pairs(rank[:-span], rank[span:])
        span *= 2
    if span < window:
        rank = pairs(rank[:len(rank) - (window - span)], rank[window - span:])
    return rank[first[of] + place], of, place


def repeated(ids: np.ndarray, strings: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words to cut, as (string, first, last): all windows that also stand in a string of a
    smaller id; windows one after another make one cut."""
    rank, of, place = window_ranks(strings, window)
    if not len(rank):
        return of, place, place
    least = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, rank, ids[of])
    gone = np.flatnonzero(least[rank] < ids[of])
    of, place = of[gone], place[gone]
    if not len(gone):
        return of, place, place
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)))
    start = np.flatnonzero(new)
    end = np.concatenate((start[1:] - 1, [len(of) - 1]))
    return of[start], place[start], place[end] + window - 1


def bucket_cuts(rows: DataFrame, window: int, held_words: int = 500_000) -> DataFrame:
    """Cuts from whole buckets: a bucket is in one task, and a task holds a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            ids = table.column("id").to_numpy()
            of, first, last = repeated(ids, [w.split() for w in table.column("words").to_pylist()], window)
            start = table.column("start").to_numpy()[of]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[of]), pa.array(table.column("th").to_numpy()[of]), pa.array((start + first).astype(np.int32)),
                 pa.array((start + last).astype(np.int32))], schema=_CUTS)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("words").nbytes // 6
            if size < held_words:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("minimiser").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield flush(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(b.column("words").nbytes for b in held) // 6
        if held:
            yield flush(pa.Table.from_batches(held))

    return rows.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(run, _spark(_CUTS))


def single_cuts(rows: DataFrame, window: int) -> DataFrame:
    """Cuts of crowded buckets: their windows go by a 128-bit cryptographic hash of their
    words, folded to the smallest id in map tasks, so no task gets a crowd."""

    def run(batches):
        for batch in sliced(batches, "words", 100_000):
            out = []
            for doc_id, th, start, text in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "start", "words"))):
                words = text.split()
                out += [(blake2b(b" ".join(words[i:i + window]), digest_size=16).digest(), doc_id, th, start + i)
                        for i in range(len(words) - window + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ONE)], schema=_ONE)

    each = rows.mapInArrow(run, _spark(_ONE))
    least = each.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo != hi").select("h", "lo")
    return each.join(least, "h").filter("lo < id").select("id", "th", "first", (F.col("first") + window - 1).cast("int").alias("last"))


def cuts(docs: DataFrame, window: int = 50, gram: int = 8, crowd: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, first, last: words of a row to remove, by their place; cuts may overlap.

    A census of minimisers (one narrow row per super-k-mer) finds those that occur under
    two ids; only super-k-mers of these travel, with their words, to the bucket of their
    minimiser, where equal windows must meet. Buckets of more than `crowd` super-k-mers are
    dealt by window instead, with the same result.
    """
    every = stored(spans(docs, window, gram, id_col, text_col), "super-kmers")
    shared = stored(
        every.groupBy("minimiser").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"))
        .filter("lo != hi").select("minimiser", (F.col("n") > crowd).alias("hot")), "shared-minimisers")
    rows = stored(packed(docs, every.join(shared, "minimiser"), window, id_col, text_col), "packed")
    return bucket_cuts(rows.filter("not hot"), window).unionByName(single_cuts(rows.filter("hot"), window))


def substring_dedup(docs: DataFrame, window: int = 50, gram: int = 8, crowd: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by single blanks), one row
    per row of `docs`.

    A word goes if a window of `window` words that covers it also stands in a document of
    smaller doc_id. Windows are judged on the input. The first document with a passage keeps
    it; a passage repeated inside one document only stays.

    A missing text has no words; a missing doc_id counts as larger than all others. Rows of
    one doc_id never cut each other, and rows alike in id and text get the same result. Texts
    shorter than a window lose nothing. An empty table gives an empty result. Other columns
    are not read.
    """
    key = row_key(docs, id_col, text_col)
    found = cuts(docs, window, gram, crowd, id_col, text_col).groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("cuts"))
    rows = docs.select(*key, docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(found, ["id", "th"], "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches):
        for batch in sliced(batches):
            out = []
            for doc_id, text, gone in zip(batch.column("doc_id").to_pylist(), encoded(batch), batch.column("cuts").to_pylist()):
                words = text.split()
                n = len(words)
                if gone:
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, [c["first"] for c in gone], 1)
                    np.add.at(depth, [c["last"] + 1 for c in gone], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
                out.append((doc_id, n, n - len(words), b" ".join(words).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.select("doc_id", "text", "cuts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
