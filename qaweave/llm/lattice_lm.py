"""Probability of documents under a unigram model of subword pieces, summed over all
segmentations, beside an add-one word model."""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaweave.llm.texts import encoded, kept_in_worker, sliced
from qaweave.session import stored

TOKENIZER = "piece_bpe_32k.model"
#: What the vocabulary writes before a word.
MARK = "▁".encode()
#: Added to the expected count of every piece.
SMOOTHING = 0.1
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())
_WORDS_AT_ONCE = 200_000


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Pieces:
    """The pieces of a public vocabulary as a tree of bytes: step (node * 256 + byte, in
    order) leads to `child`, and `piece` is the number of a node's piece, or -1. `byte` is
    the piece of each byte."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        node_of: dict[bytes, int] = {b"": 0}
        of_node, steps, scores = [-1], [], []
        self.byte = np.zeros(256, np.int64)
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(name[3:5], 16)] = len(scores)
            else:
                whole = name.encode()
                for j in range(1, len(whole) + 1):
                    if whole[:j] not in node_of:
                        node_of[whole[:j]] = len(of_node)
                        steps.append((node_of[whole[:j - 1]] * 256 + whole[j - 1], len(of_node)))
                        of_node.append(-1)
                of_node[node_of[whole]] = len(scores)
            scores.append(model.get_score(i))
        self.size = len(scores)
        self.piece = np.array(of_node, np.int64)
        self.step, self.child = np.array(sorted(steps) + [(1 << 60, 0)], np.int64).T.copy()
        # The vocabulary's scores are places in an order; by Zipf's law a place has a weight.
        place = np.empty(self.size)
        place[np.argsort(-np.array(scores), kind="stable")] = np.arange(1, self.size + 1)
        self.first_weights = 1.0 / place


class Lattice:
    """All segmentations of many words. An arc is a piece over part of a word, or a byte."""

    def __init__(self, words_: list[bytes], pieces: Pieces):
        marked = [MARK + w for w in words_]
        data = np.frombuffer(b"".join(marked), np.uint8).astype(np.int64)
        self.lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        word = np.repeat(np.arange(len(marked)), self.lengths)
        stop = np.cumsum(self.lengths)[word]
        at = np.arange(len(data))
        starts, ends, found = [at], [at + 1], [pieces.byte[data]]
        node, size = np.zeros(len(data), np.int64), 0
        while len(at):
            step = node * 256 + data[at + size]
            i = np.searchsorted(pieces.step, step)
            there = pieces.step[i] == step
            at, node, size = at[there], pieces.child[i[there]], size + 1
            whole = pieces.piece[node] >= 0
            starts.append(at[whole])
            ends.append(at[whole] + size)
            found.append(pieces.piece[node[whole]])
            more = at + size < stop[at]
            at, node = at[more], node[more]
        start, end = np.concatenate(starts), np.concatenate(ends)
        self.piece, self.of = np.concatenate(found), word[start]
        # A word has a place before each byte and one behind the last.
        self.first = np.concatenate(([0], np.cumsum(self.lengths + 1)))[:-1]
        self.places = int((self.lengths + 1).sum())
        self.a, self.b = start + self.of, end + self.of
        self.start, self.end = self.a - self.first[self.of], self.b - self.first[self.of]

    def _swept(self, by: np.ndarray, steps, to: np.ndarray, source: np.ndarray, value: np.ndarray, weight: np.ndarray) -> None:
        """value[to] = log sum exp(value[source] + weight) for the arcs at each step."""
        order = np.argsort(by * self.places + to)
        edges = np.searchsorted(by[order], np.arange(int(by.max(initial=0)) + 2))
        for s in steps:
            arcs = order[edges[s]:edges[s + 1]]
            if not len(arcs):
                continue
            x = value[source[arcs]] + weight[arcs]
            target = to[arcs]
            new = np.concatenate(([True], target[1:] != target[:-1]))
            starts = np.flatnonzero(new)
            most = np.maximum.reduceat(x, starts)
            total = np.add.reduceat(np.exp(x - most[np.cumsum(new) - 1]), starts)
            value[target[starts]] = most + np.log(total)

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """For every place of every word the log probability of what is before it."""
        value = np.full(self.places, -np.inf)
        value[self.first] = 0.0
        self._swept(self.end, range(1, int(self.lengths.max(initial=0)) + 1), self.b, self.a, value, log_p[self.piece])
        return value

    def words(self, log_p: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability over all its segmentations."""
        return self.forward(log_p)[self.first + self.lengths]

    def expected(self, log_p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected number of each piece in words that occur `times` times."""
        before = self.forward(log_p)
        behind = np.full(self.places, -np.inf)
        behind[self.first + self.lengths] = 0.0
        self._swept(self.start, range(int(self.lengths.max(initial=0)) - 1, -1, -1), self.a, self.b, behind, log_p[self.piece])
        share = np.exp(before[self.a] + log_p[self.piece] + behind[self.b] - behind[self.first][self.of])
        return np.bincount(self.piece, share * times[self.of], len(log_p))


def _word_batches(batch: pa.RecordBatch, limit: int = 80_000):
    """Slices of a batch of words, of about `limit` bytes or one word."""
    for part in sliced(iter([batch]), "word", limit):
        yield part, part.column("word").to_pylist()


def held_out(doc_id: Column) -> Column:
    """A document's part: crc32 of its id as text, modulo 7, is 2. A missing id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (in the documents learnt from), total (in all), of every word."""

    def run(batches):
        learnt, rest, size = Counter(), Counter(), 0

        def counted():
            names = list(learnt.keys() | rest.keys())
            c = [learnt[w] for w in names]
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(c, pa.int64()), pa.array([n + rest[w] for n, w in zip(c, names)], pa.int64())], ["word", "c", "total"])

        for batch in sliced(batches):
            for text, held in zip(encoded(batch), batch.column("held_out").to_pylist()):
                (rest if held else learnt).update(words(text))
            if len(learnt) + len(rest) > _WORDS_AT_ONCE:
                yield counted()
                learnt.clear()
                rest.clear()
        if learnt or rest:
            yield counted()

    return docs.select("held_out", "text").mapInArrow(run, "word binary, c long, total long").groupBy("word").agg(
        F.sum("c").alias("c"), F.sum("total").alias("total"))


def piece_model(counts: DataFrame, n_ends: int, path: str, rounds: int, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of the end. Each round weighs all segmentations
    of every word learnt from with the last round's probabilities, beginning with the
    vocabulary's own order, and takes the expected counts."""
    learnt = counts.filter("c > 0").select("word", "c")
    weights, log_end = start / start.sum(), 0.0
    for _ in range(rounds):
        log_p = np.log(weights)

        def run(batches, log_p=log_p):
            pieces = kept_in_worker(f"lattice {path}", lambda: Pieces(path))
            total = np.zeros(pieces.size)
            for batch in batches:
                for part, names in _word_batches(batch):
                    total += Lattice(names, pieces).expected(log_p, part.column("c").to_numpy())
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])

        # One number for each piece of the vocabulary, whatever the corpus.
        expected = np.full(len(start), SMOOTHING)
        for r in learnt.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            expected[r.piece] += r.n
        whole = expected.sum() + n_ends + SMOOTHING
        weights, log_end = expected / whole, math.log((n_ends + SMOOTHING) / whole)
    return np.log(weights), log_end


def score_words(counts: DataFrame, log_p: np.ndarray, path: str) -> DataFrame:
    """word, c, total and lp, the log10 probability of the word over all segmentations."""

    def run(batches):
        pieces = kept_in_worker(f"lattice {path}", lambda: Pieces(path))
        for batch in batches:
            for part, names in _word_batches(batch):
                lp = Lattice(names, pieces).words(log_p) / math.log(10)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("word", "c", "total")] + [pa.array(lp)], ["word", "c", "total", "lp"])

    return counts.select("word", "c", "total").mapInArrow(run, "word binary, c long, total long, lp double")


def document_parts(docs: DataFrame, often: list[tuple[bytes, int, float]], least: float) -> DataFrame:
    """Sums over the words in `often`, and the other words of each document. `row` tells
    rows apart once the result is stored."""

    def run(batches):
        place = {w: i for i, (w, _, _) in enumerate(often)}
        c = np.array([x[1] for x in often] + [0], np.float64)
        lp = np.array([x[2] for x in often] + [0.0])
        base = np.log10(c + 1) - least
        base[-1] = 0.0
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            found = [words(t) for t in encoded(batch)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            flat = list(chain.from_iterable(found))
            i = np.fromiter(map(place.get, flat, repeat(-1)), np.int64, len(flat))
            of = np.repeat(np.arange(len(found)), n)
            other = np.flatnonzero(i < 0)
            offsets = np.searchsorted(of[other], np.arange(len(found) + 1)).astype(np.int32)
            sums = [np.bincount(of, x[i], len(found)) for x in (c > 0, base, lp)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + len(found))), batch.column("doc_id"), batch.column("held_out"), pa.array(n),
                pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(float)), pa.array(sums[2].astype(float)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array([flat[j] for j in other], pa.binary()))],
                ["row", "doc_id", "held_out", "n", "known", "base", "score", "others"])
            row += len(found)

    return docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n long, known long, base double, score double, others array<binary>")


def score_documents(docs: DataFrame, rounds: int = 2, often_share: float = 1e-5, tokenizer: str | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Words are runs of characters other than the blank and U+0009 to U+000D, A-Z in lower
    case; an end is one token more. `base_score` is the log10 probability under add-one
    word counts of the documents that are not held out. `score` is that under pieces of a
    public vocabulary: a word's probability is the sum over all ways to write it in pieces
    or bytes (forward recursion in log space), a text's the product over its words and its
    end. Pieces do not reach over words, so this is the sum over all segmentations of the
    text. Probabilities are fitted in `rounds` of expected counts over every word learnt from.

    The table of words grows with the corpus and stays distributed. Words with a share of
    `often_share` or more of all tokens, at most 1 / often_share, are summed where their
    documents are read; the others are joined, each with less than that share of the rows.

    A missing text is empty and has its end only. A missing doc_id is learnt from. Repeated
    rows are counted and scored each. Long texts and long words are scored whole. An empty
    table gives an empty result; with nothing to learn from all pieces are equally likely.
    Other columns are not read.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    id_ = docs[id_col]
    base = docs.select(id_.cast("long").alias("doc_id"), held_out(id_).alias("held_out"), docs[text_col].alias("text"))
    counts = stored(word_counts(base), "word-counts")
    n_ends = base.filter(~F.col("held_out")).count()
    n, v, total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum("total"), F.lit(0))).first()
    n, v = n + n_ends, v + (n_ends > 0)
    least = math.log10(n + v + 1)

    log_p, log_end = piece_model(counts, n_ends, path, rounds, Pieces(path).first_weights)
    scored = stored(score_words(counts, log_p, path), "word-scores")
    often = [(bytes(r.word), r.c, r.lp) for r in scored.filter(F.col("total") >= often_share * total).collect()]
    parts = stored(document_parts(base, often, least), "document-parts")
    rare = scored.filter(F.col("total") < often_share * total).select("word", (F.col("c") > 0).cast("long").alias("k"), (F.log10(F.col("c") + 1) - least).alias("b"), "lp")
    sums = parts.select("row", F.explode("others").alias("word")).join(rare, "word").groupBy("row").agg(
        F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("lp").alias("lp"))

    def plus(own: str, other: str, end) -> Column:
        return (F.col(own) + F.coalesce(F.col(other), F.lit(0)) + end).alias({"known": "n_known", "base": "base_score"}.get(own, own))

    whole = parts.drop("others").join(sums.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    return whole.select(
        "doc_id", "held_out", (F.col("n") + 1).alias("n_tokens"), plus("known", "k", F.lit(int(n_ends > 0)).cast("long")),
        F.lit(n).cast("long").alias("train_tokens"), plus("base", "b", F.lit(math.log10(n_ends + 1) - least)),
        plus("score", "lp", F.lit(log_end / math.log(10))))
