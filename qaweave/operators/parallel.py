"""Cross-language pair mining and its assessment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaweave import constants as C
from qaweave.functions.seeded import unit_draw
from qaweave.functions.text import parse_score, render
from qaweave.operators.blocks import BLOCK_ROWS, PART_BLOCKS, cell_columns, in_block_cells, stripes, unit_rows
from qaweave.operators.dedup import first_per_key
from qaweave.operators.neardup import apply_flags
from qaweave.operators.streams import matrix, streamed

_PAIR = ["scheme_host", "l1", "l2"]


def candidate_docs(faq: DataFrame, hosts: DataFrame, flags: DataFrame, labels: DataFrame,
                   vectors: DataFrame, limit: float = C.NEAR_DUPLICATE_SIMILARITY,
                   large=C.LARGE_LANGUAGES) -> DataFrame:
    """Rows of the host's listed languages: first row per question, then the flag
    filter, so a flagged first row hides later ones. A listed language outside
    the large ones has no flags and labels and passes with `-`."""
    sides = hosts.select("scheme_host", F.explode(F.map_keys("counts")).alias("language"))
    rows = faq.join(sides, ["scheme_host", "language"], "left_semi")
    firsts = first_per_key(rows, ["scheme_host", "language", "question"], ["pos"])
    is_large = F.col("language").isin(list(large))
    kept = apply_flags(firsts.filter(is_large), flags, limit).join(labels, ["language", "id"])
    small = firsts.filter(~is_large).withColumns(
        {"topic": F.lit(None).cast("string"), "question_type": F.lit(None).cast("string")}
    )
    named = kept.unionByName(small).withColumns(
        {c: F.coalesce(c, F.lit("-")) for c in ("topic", "question_type")}
    )
    return named.join(vectors.select("language", "id", "embedding"), ["language", "id"])


#: Which side of a language pair a best value belongs to.
_FIRST, _SECOND = 1, 2


class _Pairs:
    """Best values of the rows of a held block against all that pass, per language pair.
    Rows below the limit can change neither maximum, so they are dropped where they arise."""

    def __init__(self, host, held: pa.Table, limit: float):
        self.host, self.limit = host, limit
        self.held = dict(_languages(held.combine_chunks().to_batches(max_chunksize=len(held))[0]))
        self.best: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}

    def alone(self):
        for l1, (pos1, a) in self.held.items():
            for l2, (pos2, b) in self.held.items():
                if l1 < l2:
                    yield from self._met(l1, pos1, a, l2, pos2, b, keep=False)

    def meet(self, batch: pa.RecordBatch):
        for language, (pos, theirs) in _languages(batch):
            for mine, (own_pos, a) in self.held.items():
                if mine != language:
                    yield from self._met(mine, own_pos, a, language, pos, theirs, keep=True)

    def _met(self, l_held, pos_held, a, l_other, pos_other, b, keep):
        """Maxima of both sides. Those of the other side are whole after this; those of
        the held side go on (`keep`), as more rows of its partner's language may pass."""
        best, partner = self.best.get((l_held, l_other), (np.full(len(a), -2.0), np.full(len(a), -1)))
        for start, s in stripes(b, a):
            names = pos_other[start:start + len(s)]
            j = s.argmax(axis=1)
            yield self._rows(l_other, l_held, names, pos_held[j], s[np.arange(len(s)), j])
            i = s.argmax(axis=0)
            value, name = s[i, np.arange(len(a))], names[i]
            better = (value > best) | ((value == best) & (name < partner))
            best, partner = np.where(better, value, best), np.where(better, name, partner)
        if keep:
            self.best[l_held, l_other] = best, partner
        else:
            yield self._rows(l_held, l_other, pos_held, partner, best)

    def rest(self):
        for (l_held, l_other), (best, partner) in self.best.items():
            yield self._rows(l_held, l_other, self.held[l_held][0], partner, best)

    def _rows(self, own, other, pos, partner, value) -> pa.RecordBatch:
        some = value >= self.limit
        n, first = int(some.sum()), own < other
        l1, l2 = (own, other) if first else (other, own)
        return pa.RecordBatch.from_arrays([
            pa.array([self.host] * n, pa.string()), pa.array([l1] * n, pa.string()), pa.array([l2] * n, pa.string()),
            pa.array(np.full(n, _FIRST if first else _SECOND, np.int32)), pa.array(pos[some]), pa.array(partner[some]), pa.array(value[some])],
            ["scheme_host", "l1", "l2", "side", "pos", "partner", "similarity"])


def _languages(batch: pa.RecordBatch):
    """(language, (positions, unit vectors)) of each run of rows of a language."""
    language = batch.column("language").dictionary_encode()
    codes = language.indices.to_numpy()
    edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1), len(codes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            part = batch.slice(a, b - a)
            yield language[a].as_py(), (part.column("pos").to_numpy(), unit_rows(matrix(part.column("embedding"))))


def mutual_best_pairs(docs: DataFrame, limit: float = C.PAIR_SIMILARITY,
                      block_rows: int = BLOCK_ROWS, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """Per host and language pair: a row takes its best partner (first on ties);
    the pair stays if it reaches the limit and no other row is better for the
    partner."""
    cells = in_block_cells(
        docs.filter("language IS NOT NULL").select(
            F.col("scheme_host").cast("string").alias("scheme_host"), "language", F.col("pos").cast("long").alias("pos"), "embedding"),
        ["scheme_host"], ["language", "pos"], block_rows, part_blocks,
    )

    def maxima(batches):
        for held, passing in streamed(batches, cell_columns(["scheme_host"])):
            if held is None:
                continue
            pairs = _Pairs(held.column("scheme_host")[0].as_py(), held, limit)
            if held.column("alone")[0].as_py():
                yield from pairs.alone()
            for batch in passing:
                yield from pairs.meet(batch)
            yield from pairs.rest()

    found = cells.mapInArrow(
        maxima, "scheme_host string, l1 string, l2 string, side int, pos long, partner long, similarity double")
    # Both branches read the aggregate `which`, not the key, and ask for the same columns to
    # be there, so they share its exchange: the products are made once.
    there = found.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*_PAIR, "pos"]))
    best = there.groupBy(*_PAIR, "side", "pos").agg(
        F.max(F.struct("similarity", (-F.col("partner")).alias("back"))).alias("best"), F.max("side").alias("which"))
    rows = best.filter(F.col("which") == _FIRST).select(
        *_PAIR, F.col("pos").alias("pos1"), (-F.col("best.back")).alias("pos2"), "best.similarity")
    columns = best.filter(F.col("which") == _SECOND).select(
        *_PAIR, F.col("pos").alias("pos2"), F.col("best.similarity").alias("column_best"))
    return (
        rows.join(columns, [*_PAIR, "pos2"])
        .filter("similarity >= column_best")
        .select(*_PAIR, "pos1", "pos2", "similarity")
    )


def pair_record(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Output records: every field holds the values of both sides."""
    fields = {"url": "urls", "question": "questions", "answer": "answers",
              "topic": "topics", "question_type": "question_types"}

    def side(n: int) -> DataFrame:
        return docs.select(
            "scheme_host", F.col("language").alias(f"l{n}"), F.col("pos").alias(f"pos{n}"),
            *[F.col(f).alias(f"{f}{n}") for f in fields],
        )

    both = pairs.join(side(1), ["scheme_host", "l1", "pos1"]).join(
        side(2), ["scheme_host", "l2", "pos2"]
    )
    return both.select(
        "scheme_host", "similarity", F.array("l1", "l2").alias("languages"),
        *[F.array(f"{f}1", f"{f}2").alias(alias) for f, alias in fields.items()],
    )


def similarity_bucket(similarity: Column) -> Column:
    return (similarity * 100).cast("int") / F.lit(100.0)


def similarity_histogram(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(similarity_bucket(F.col("similarity")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def sample_for_scoring(candidates: DataFrame, keys: list[str],
                       probability: float = C.SCORING_PROBABILITY, seed: int = 42) -> DataFrame:
    """`sampled` with the given probability; the others are scored -2."""
    return candidates.withColumn("sampled", unit_draw(seed, *keys) < F.lit(probability))


def scoring_prompt(candidates: DataFrame) -> DataFrame:
    def segment(i: int) -> Column:
        return F.concat_ws(" ", F.col("questions")[i], F.col("answers")[i])

    return candidates.withColumn(
        "prompt",
        render(
            C.SCORING_PROMPT,
            source_lang=F.col("languages")[0], target_lang=F.col("languages")[1],
            source_seg=segment(0), target_seg=segment(1),
        ),
    )


def attach_scores(candidates: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Score from the reply of a pair; -2 without a reply, -1 when unreadable."""
    scored = replies.select(*keys, parse_score(F.col("reply")).alias("score"))
    return candidates.join(scored, keys, "left").withColumn(
        "score", F.coalesce("score", F.lit(-2))
    )


def pair_counts(scores: DataFrame) -> DataFrame:
    """Rows per sorted language pair, descending, with the identical ones."""
    same_q = F.col("questions")[0] == F.col("questions")[1]
    same_a = F.col("answers")[0] == F.col("answers")[1]
    return (
        scores.groupBy(F.array_sort("languages").alias("languages"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(same_q).alias("same_questions"),
            F.count_if(same_a).alias("same_answers"),
            F.count_if(same_q & same_a).alias("same_both"),
        )
        .orderBy(F.desc("n"), "languages")
    )


def score_histogram(scores: DataFrame) -> DataFrame:
    return scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))


def _scored_buckets(scores: DataFrame) -> DataFrame:
    """Rows with a score, by similarity from 0.80 to 0.99; 1.00 is left out."""
    bucket = similarity_bucket(F.col("similarity"))
    return scores.filter("score >= 0").withColumn("bucket", bucket).filter(
        "bucket >= 0.8 and bucket < 1.0"
    )


def mean_score_by_similarity(scores: DataFrame) -> DataFrame:
    return _scored_buckets(scores).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")
    )


def precision_recall_sweep(scores: DataFrame, limits=C.SCORE_LIMITS) -> DataFrame:
    """Per score limit and similarity limit 0.99 down to 0.80: share above the
    score limit, cumulative precision, recall and F1. At most twenty buckets
    reach the windows; a bucket without rows counts 0."""
    counts = _scored_buckets(scores).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("score") >= limit).alias(f"good{limit}") for limit in limits],
    )
    grid = scores.sparkSession.range(80, 100).select(
        (F.col("id") / F.lit(100.0)).alias("bucket")
    )
    per_limit = F.array(
        *[F.struct(F.lit(limit).alias("score_limit"), F.col(f"good{limit}").alias("good"))
          for limit in limits]
    )
    rows = (
        grid.join(counts, "bucket", "left").na.fill(0)
        .select("bucket", "n", F.inline(per_limit))
    )
    down = Window.partitionBy("score_limit").orderBy(F.desc("bucket")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    everything = Window.partitionBy("score_limit")
    summed = rows.select(
        "score_limit", F.col("bucket").alias("similarity_limit"),
        F.sum("n").over(down).alias("extracted"), F.sum("good").over(down).alias("correct"),
        F.sum("n").over(everything).alias("total"),
        F.sum("good").over(everything).alias("total_good"),
    )
    precision = F.try_divide(F.col("correct"), F.col("extracted"))
    recall = F.try_divide(F.col("correct"), F.col("total_good"))
    return (
        summed.withColumns({
            "share": F.try_divide(F.col("total_good"), F.col("total")),
            "precision": precision, "recall": recall,
        })
        .withColumn("f1", F.try_divide(
            2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .drop("total", "total_good")
    )


def to_bitexts(scores: DataFrame, limit: float = C.BITEXT_SIMILARITY,
               min_rows: int = C.BITEXT_MIN_ROWS) -> DataFrame:
    """Pairs that reach the limit and differ in question and answer, for language
    pairs with enough rows. The broadcast table has one row per language pair
    that has at least `min_rows` rows; 75 languages make 2,775 pairs."""
    q, a, l = F.col("questions"), F.col("answers"), F.col("languages")
    kept = scores.filter(
        (F.col("similarity") >= F.lit(limit)) & (q[0] != q[1]) & (a[0] != a[1])
    ).withColumn("pair", F.concat_ws("_", l[0], l[1]))
    enough = kept.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= min_rows
    )
    return kept.join(F.broadcast(enough.select("pair")), "pair", "left_semi").select(
        "pair",
        F.col("scheme_host").alias("origin"),
        F.col("similarity").alias("labse_similarity"),
        q[0].alias("question1"), q[1].alias("question2"),
        a[0].alias("answer1"), a[1].alias("answer2"),
        F.struct("urls", "topics", "question_types").alias("details"),
    )
