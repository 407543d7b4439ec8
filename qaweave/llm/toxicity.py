"""Toxicity by maximum-scoring segments of word log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaweave.llm.texts import encoded, sliced
from qaweave.session import stored

#: Lengths of the word beginnings that a word's prior comes from.
STEMS = (3, 4, 5, 6, 7)
_STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def units(word: bytes) -> list[str]:
    """What a word counts for: its beginnings, shortest first, then itself."""
    text = word.translate(None, _STRIP).decode()
    if not text:
        return []
    return [f"{text[:k]}~" for k in STEMS if len(text) >= k] + [text]


@dataclass(frozen=True)
class LogOdds:
    """Log-odds of units with Dirichlet priors: a unit's prior is the rate of the next
    shorter one, worth `strength` documents, and the shortest one's is the base rate."""

    rates: dict[str, float]
    base: float
    drift: float

    @staticmethod
    def learn(counts: dict[str, tuple[int, int]], toxic: int, clean: int, strength: float, drift: float) -> LogOdds:
        base = (toxic + 1) / (toxic + clean + 2)
        rates: dict[str, float] = {}
        for unit in sorted(counts, key=lambda u: (not u.endswith("~"), len(u), u)):
            t, n = counts[unit]
            word = unit.removesuffix("~")
            shorter = [k for k in STEMS if k < len(word) or k == len(word) and not unit.endswith("~")]
            prior = next((rates[s] for k in reversed(shorter) if (s := f"{word[:k]}~") in rates), base)
            rates[unit] = (t + strength * prior) / (t + n + strength)
        return LogOdds(rates, base, drift)

    def word(self, raw: bytes) -> float:
        rate = next((self.rates[u] for u in reversed(units(raw)) if u in self.rates), self.base)
        return math.log(rate / (1 - rate)) - math.log(self.base / (1 - self.base)) - self.drift


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence in one pass: each
    positive item joins those before it as long as that raises their sum."""
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[int, int, float, float]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        first, left, right = i, float(sums[i]), float(sums[i + 1])
        last = i
        while True:
            k = len(stack) - 1
            # The nearest segment that starts below; those in between start at or above.
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= right:
                break
            first, left = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((first, last, left, right))
    return [(a, b, r - le) for a, b, le, r in stack]


class Scorer:
    """Segments of texts; scores of words seen before are kept, `most` at most."""

    def __init__(self, model: LogOdds, most: int = 250_000):
        self.model, self.most = model, most
        self.known: dict[bytes, float] = {}

    def segments(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        words = text.decode().lower().encode().split()
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > self.most:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self.model.word(w)
        scores = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        # A word said again adds little: its k-th occurrence counts one k-th.
        said: Counter = Counter()
        for i in np.flatnonzero(scores > 0).tolist():
            said[words[i]] += 1
            scores[i] /= said[words[i]]
        return len(words), maximal_segments(scores)


@dataclass(frozen=True)
class Calibration:
    """Segment scores of clean texts follow an extreme-value law: one above x is found with
    probability 1 - exp(-k n e^(-rate x)) in n words. `weight` and `bias` turn the evidence
    of a text into a probability."""

    rate: float
    k: float
    weight: float
    bias: float

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """What the segments hold beyond the best one that chance gives, added up; below
        zero if none holds more."""
        over = [self.rate * s - math.log(self.k * max(n, 1)) for _, _, s in found]
        return sum(x for x in over if x > 0) or max(over, default=-math.log(self.k * max(n, 1)) if n else -20.0)

    def score(self, n: int, found: list[tuple[int, int, float]]) -> float:
        z = self.weight * max(-20.0, min(60.0, self.evidence(n, found))) + self.bias
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

    @staticmethod
    def fit(rows: list[tuple[int, int, list[float]]]) -> Calibration:
        """rows: (label, words, segment scores). The law from the best segments of clean
        texts, by maximum likelihood; weight and bias by penalised logistic regression."""
        clean = [(n, max(s, default=0.0)) for y, n, s in rows if not y and n]
        rate, k = 1.0, 0.05
        if sum(x > 0 for _, x in clean) >= 10:
            n, x = np.array([c[0] for c in clean], float), np.array([c[1] for c in clean])
            hit, best = x > 0, -math.inf
            for r in np.geomspace(0.1, 5.0, 60):
                # Texts without a segment only say that none is above zero.
                tail = n * np.exp(-r * x)
                scale = hit.sum() / tail.sum()
                fit = hit.sum() * math.log(r * scale) - r * x[hit].sum() - scale * tail.sum()
                if fit > best:
                    best, rate, k = fit, float(r), float(scale)
        law = Calibration(rate, k, 1.0, 0.0)
        e = np.array([max(-20.0, min(60.0, law.evidence(n, [(0, 0, v) for v in s]))) for _, n, s in rows])
        y = np.array([r[0] for r in rows], float)
        w = np.array([0.5, -3.0])
        if len(rows):
            a = np.stack([e, np.ones(len(e))], axis=1)
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
                ridge = np.array([1.0, 0.01])
                step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
                w = w + np.clip(step, -2, 2)
        return Calibration(rate, k, float(w[0]), float(w[1]))


def learning_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, toxic, part of labelled rows outside the held-out third: distinct texts of at
    most `most` labels, the first by a hash of their id. Part 0 is for word counts, part 2
    for the calibration."""
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    chosen = (
        labels.select("doc_id", "toxic", part.alias("part")).filter("part != 1 AND toxic IS NOT NULL")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)
    )
    # At most `most` rows of two numbers, so it can be broadcast.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("part").alias("part"))


def unit_counts(rows: DataFrame) -> DataFrame:
    """unit, toxic, clean: in how many texts of each label a unit occurs."""
    schema = pa.schema([("unit", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches):
        counts = (Counter(), Counter())

        def flush():
            names = list(counts[0] | counts[1])
            out = pa.RecordBatch.from_arrays(
                [pa.array(names), *(pa.array([c[u] for u in names], pa.int64()) for c in (counts[1], counts[0]))], schema=schema)
            counts[0].clear()
            counts[1].clear()
            return out

        for batch in sliced(batches):
            for text, toxic in zip(encoded(batch), batch.column("toxic").to_pylist()):
                counts[toxic > 0].update({u for w in set(text.decode().lower().encode().split()) for u in units(w)})
            if len(counts[0]) > 300_000:
                yield flush()
        yield flush()

    each = rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "unit string, toxic long, clean long")
    return each.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def shipped(docs: DataFrame, model: LogOdds) -> Callable[[], Scorer]:
    """A scorer for tasks; the table of rates, bounded by the learning rows, is broadcast."""
    rates, base, drift = docs.sparkSession.sparkContext.broadcast(model.rates), model.base, model.drift
    return lambda: Scorer(LogOdds(rates.value, base, drift))


def learn(docs: DataFrame, labels: DataFrame, most: int = 20_000, least_toxic: int = 3, least_clean: int = 50,
          strength: float = 20.0, drift: float = 1.5) -> tuple[LogOdds, Calibration]:
    """The model from at most `most` labelled rows, which bounds what the driver gets: the
    units that occur in enough texts, and the scores of all segments of the calibration
    part, as a text is scored by all of its segments."""
    rows = stored(learning_rows(docs, labels, most), "toxicity-learning")
    part = rows.filter("part = 0")
    sizes = {bool(r.t): r["count"] for r in part.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
    counts = unit_counts(part).filter((F.col("toxic") >= least_toxic) | (F.col("clean") >= least_clean))
    table = {r.unit: (r.toxic, r.clean) for r in counts.collect()}
    model = LogOdds.learn(table, sizes.get(True, 0), sizes.get(False, 0), strength, drift)
    scorer_of = shipped(docs, model)

    def run(batches):
        scorer = scorer_of()
        for batch in sliced(batches):
            found = [scorer.segments(t) for t in encoded(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([n for n, _ in found], pa.int64()), pa.array([[s for _, _, s in f] for _, f in found], pa.list_(pa.float64()))],
                ["toxic", "n", "scores"])

    held = rows.filter("part = 2").select("text", F.col("toxic").cast("int")).mapInArrow(run, "toxic int, n long, scores array<double>")
    return model, Calibration.fit([(r.toxic, r.n, list(r.scores)) for r in held.collect()])


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted and passages of every row of `docs`; a passage has
    the places of its first and last word and its probability under chance.

    Words score by how much likelier they make the label 1, with Dirichlet priors from their
    beginnings, less a drift, so that the sum falls on clean text. One pass over a text finds
    every maximal scoring passage. An extreme-value law fitted to clean texts tells which of
    them chance does not explain in a text of that length; their excess adds up to the
    evidence, which a logistic curve turns into the score. The model learns from the labels
    of rows with crc32(doc_id as text) mod 3 other than 1, `most` rows at most; ids, labels,
    languages and sources are no input of a score. All documents are scored whole.

    A missing text is empty and gets the score of an empty text; a missing id is not held
    out; repeated rows each get a row; labels without a document or value are not used, and
    without labels of both kinds all scores are low. An empty table gives an empty result.
    Other columns are not read.
    """
    model, law = learn(docs, labels, most)
    scorer_of = shipped(docs, model)
    passage = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("chance", pa.float64())])

    def run(batches):
        scorer = scorer_of()
        for batch in sliced(batches):
            scores, passages = [], []
            for text in encoded(batch):
                n, found = scorer.segments(text)
                scores.append(law.score(n, found))
                chance = [(a, b, -math.expm1(-law.k * n * math.exp(-law.rate * s))) for a, b, s in found]
                passages.append([dict(first=a, last=b, chance=p) for a, b, p in chance if p < 0.01])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array(passages, pa.list_(passage))], ["doc_id", "score", "passages"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    scored = base.mapInArrow(run, "doc_id long, score double, passages array<struct<first:int,last:int,chance:double>>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "passages")
