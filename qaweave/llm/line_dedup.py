"""Line dedup: a deletion-neighbourhood join on words, earliest line kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaweave.llm.texts import Words, encoded, fresh, mixed, row_key, sliced, whole_rows
from qaweave.session import stored

#: Lines of fewer words are compared exactly only: one word of five is a similarity of 0.8.
LEAST_WORDS = 5

_LINES = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("a", pa.int64()), ("b", pa.int64()),
                    ("n", pa.int32()), ("halves", pa.list_(pa.int64()))])
_TEXTS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("line", pa.int32()), ("words", pa.binary())])
_VARIANTS = pa.schema([("v", pa.int64()), ("tag", pa.int32()), ("id", pa.int64()), ("line", pa.int32()), ("a", pa.int64())])


def _spark(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _halves(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and last halves of the lines of LEAST_WORDS words or more, and
    how many each line has. Lines at most one word apart share one of them: the edit lies
    in one half, and the other is as long in both lines for one of the two halvings."""
    n, first = words.counts, words.first[:-1]
    long = n >= LEAST_WORDS
    parts = []
    for h in (n // 2, (n - 1) // 2):
        rows = np.flatnonzero(long)
        at, size = first[rows], h[rows]
        salt = mixed(size.astype(np.uint64))
        parts.append((rows, words.hashes(at, at + size - 1) ^ salt))
        parts.append((rows, ~words.hashes(at + n[rows] - size, at + n[rows] - 1) ^ salt))
    rows, keys = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(rows, kind="stable")
    return keys[order].view(np.int64), np.where(long, 4, 0)


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line with a word: id, th, line number, 128-bit hash (a, b) of its words, their
    number, hashes of its halves."""

    def run(batches):
        for batch in sliced(batches):
            ids, ths = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            found, of, number = [], [], []
            for d, text in enumerate(encoded(batch)):
                for k, line in enumerate(text.split(b"\n")):
                    if w := line.split():
                        found.append(w)
                        of.append(d)
                        number.append(k)
            if not found:
                continue
            words = Words(found)
            last = words.first[1:] - 1
            a = words.hashes(words.first[:-1], last).view(np.int64)
            joined, h = words.joined, xxhash.xxh64_intdigest
            b = np.array([h(joined[s:e]) for s, e in zip(words.starts[words.first[:-1]], words.ends[last])], np.uint64).view(np.int64)
            keys, n_keys = _halves(words)
            halves = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_keys))), pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[of]), pa.array(ths[of]), pa.array(number, pa.int32()), pa.array(a), pa.array(b),
                 pa.array(words.counts.astype(np.int32)), halves], schema=_LINES)

    base = docs.select(*row_key(docs, id_col, text_col), docs[text_col].alias("text"))
    return base.mapInArrow(run, _spark(_LINES))


def line_words(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The words of chosen lines (id, th, line, a, b), joined by blanks."""
    per_row = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("line", "a", "b")).alias("want"))
    keyed = docs.select(*row_key(docs, id_col, text_col), docs[text_col].alias("text"))

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for doc_id, text, want in zip(batch.column("id").to_pylist(), encoded(batch), batch.column("want").to_pylist()):
                parts = text.split(b"\n")
                rows += [(w["a"], w["b"], doc_id, w["line"], b" ".join(parts[w["line"]].split())) for w in want]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TEXTS)], schema=_TEXTS)

    # Hashing the short side spares a sort of all texts.
    found = keyed.join(per_row.hint("shuffle_hash"), ["id", "th"]).select("id", "text", "want").mapInArrow(run, _spark(_TEXTS))
    return found.dropDuplicates(["a", "b"])


def variant_hashes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each line whole and with each word left out: (hash, tag, line). The tag is
    the place of the word left out, or -1. A hash is a sum over the words that are left, by
    their new place, so that a shortened line and a whole line of the same words agree."""
    step = np.uint64(0xD1342543DE82EF95)
    back = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
    at = np.arange(words.total)
    of = words.document_of_word()
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(words.total, step))))
    unpower = np.cumprod(np.concatenate(([np.uint64(1)], np.full(words.total, back))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words.hashes(at, at) * powers[:-1])))
    begin, end = words.first[:-1], words.first[1:]
    whole = (sums[end] - sums[begin]) * unpower[begin]
    short = ((sums[at] - sums[begin[of]]) + (sums[end[of]] - sums[at + 1]) * back) * unpower[begin[of]]
    lines_ = np.arange(len(begin))
    n = words.counts.astype(np.uint64)
    left = np.concatenate((n, (n - np.uint64(1))[of]))
    v = mixed(np.concatenate((whole, short)) + left * np.uint64(0x9E3779B97F4A7C15))
    return v, np.concatenate((np.full(len(begin), -1), at - begin[of])), np.concatenate((lines_, of))


def variants(texts: DataFrame) -> DataFrame:
    """The deletion neighbourhood of every line: v (hash), tag, and the line's id, line, a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "words", 200_000):
            v, tag, of = variant_hashes(Words([w.split() for w in batch.column("words").to_pylist()]))
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v.view(np.int64)), pa.array(tag.astype(np.int32)), *(batch.column(c).take(take) for c in ("id", "line", "a"))],
                schema=_VARIANTS)

    return texts.mapInArrow(run, _spark(_VARIANTS))


def one_edit_apart(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word put in, left out or replaced at most turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def near_lines(texts: DataFrame) -> DataFrame:
    """a, b of the lines that have an earlier line at most one word away.

    Variants that agree are joined by aggregates, never as pairs: lines without the same
    word in the same place differ in that word only, so the earliest of them is a witness
    for all others; a whole line and a line without one word are witnesses for each other.
    Each line goes on with its earliest witness, and the edit distance of the two is
    verified on their words.
    """
    order = F.struct("id", "line", "a")
    rows = variants(texts)
    by_tag = rows.groupBy("v", "tag").agg(F.min(order).alias("m"), F.min("a").alias("lo"), F.max("a").alias("hi"))
    by_variant = stored(
        by_tag.groupBy("v").agg(
            F.min(F.when(F.col("tag") < 0, F.col("m"))).alias("whole"), F.min(F.when(F.col("tag") >= 0, F.col("m"))).alias("short"),
            F.map_from_entries(F.collect_list(F.struct("tag", "m"))).alias("same"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .filter("lo != hi").drop("lo", "hi"), "variants")
    earliest = F.when(F.col("tag") < 0, F.col("short")).otherwise(F.least(F.col("whole"), F.col("same")[F.col("tag")]))
    pairs = (
        rows.join(by_variant, "v").select("a", order.alias("o"), earliest.alias("w")).filter(F.col("w") < F.col("o"))
        .groupBy("a").agg(F.min("w").alias("w")).select("a", F.col("w.a").alias("wa"))
    )
    mine = texts.select("a", "b", "words")
    other = texts.select(F.col("a").alias("wa"), F.col("words").alias("other"))
    both = stored(pairs, "line-pairs").join(mine, "a").join(other, "wa").select("a", "b", "words", "other")

    def run(batches):
        for batch in sliced(batches, "words"):
            near = [one_edit_apart(x.split(), y.split()) for x, y in zip(batch.column("words").to_pylist(), batch.column("other").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(run, "a long, b long").distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, removed (sorted line numbers) for each row of `docs` that loses lines."""
    every = stored(lines(docs, id_col, text_col), "lines")
    place = F.struct("id", "line", "th")
    distinct = stored(
        every.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("halves").alias("halves")), "distinct-lines")
    halves = distinct.filter(F.size("halves") > 0).select("a", "b", F.explode(F.array_distinct("halves")).alias("h"))
    shared = stored(halves.groupBy("h").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo != hi").select("h"), "shared-halves")
    meeting = halves.join(shared, "h", "left_semi").select("a", "b").distinct()
    wanted = distinct.join(meeting, ["a", "b"], "left_semi").select("first.id", "first.th", "first.line", "a", "b")
    texts = stored(line_words(docs, wanted, id_col, text_col), "line-words")
    near = near_lines(texts).withColumn("near", F.lit(True))
    verdicts = stored(
        distinct.select("a", "b", "first", (F.col("first") != F.col("last")).alias("again")).join(near, ["a", "b"], "left")
        .filter(F.col("again") | F.col("near")).select("a", "b", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-verdicts")
    gone = every.select("id", "th", "line", "a", "b").join(verdicts, ["a", "b"]).filter(F.col("near") | (place != F.col("first")))
    return gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def count_columns(docs: DataFrame) -> tuple[str, str]:
    """__lines and __removed, or names like them that `docs` has not."""
    return fresh(docs, "__lines"), fresh(docs, "__removed")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `docs`, its text without the lines that repeat an earlier one: columns
    of `docs`, then the two of `count_columns` (numbers of lines and of removed ones).

    A line is removed if an earlier line of any document has the same words, or, where both
    have five words or more, words that one edit (a word put in, left out or replaced)
    turns into them. Earlier means a smaller doc_id, then a smaller line number. Lines are
    judged on the input, removed ones too, so the result does not depend on any order of
    work. Lines without a word stay.

    Equal lines are folded first. A census of half-line hashes, which no pair of near lines
    escapes, picks the lines that can have a near one; only these emit deletion variants.
    All groups are folded by aggregates of one row per task and key, so a line that holds
    a third of all lines costs no task more than the others.

    A missing text stays missing and has no line; a missing doc_id is behind all others.
    Rows alike in doc_id and text are one document: they keep and lose the same lines.
    An empty table gives an empty result. Columns of any name pass through.
    """
    gone = removed_lines(docs, id_col, text_col)
    lines, removed = count_columns(docs)
    rows = whole_rows(docs, id_col, text_col).join(gone.hint("shuffle_hash"), ["id", "th"], "left")
    own = F.col(f"row.`{text_col}`")
    parts = F.split(own, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed"))
    text = F.when(F.col("removed").isNull(), own).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    return rows.select(
        *[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns],
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias(lines), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias(removed))
