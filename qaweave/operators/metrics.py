"""Retrieval metrics over runs and relevance judgements.

run: language, query_id, doc_id, score; qrels: language, query_id, doc_id, score.
Equal scores are ordered by document id, descending. Every judged query counts;
one without hits has the value 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaweave import constants as C
from qaweave.operators.ranking import top_unique

_QUERY = ["language", "query_id"]


def _by(*order):
    return Window.partitionBy(*_QUERY).orderBy(*order)


def _judged(run: DataFrame, qrels: DataFrame, depth: int, rank: str | None) -> DataFrame:
    """The first `depth` documents with rank and relevance (0 if not judged)."""
    if rank is None:
        run = run.withColumn("rank", F.row_number().over(_by(F.desc("score"), F.desc("doc_id"))))
        rank = "rank"
    ranked = run.select(*_QUERY, "doc_id", F.col(rank).alias("rank")).filter(F.col("rank") <= depth)
    relevance = qrels.select(*_QUERY, "doc_id", F.col("score").alias("relevance"))
    return ranked.join(relevance, [*_QUERY, "doc_id"], "left").select(
        *_QUERY, "doc_id", "rank", F.coalesce("relevance", F.lit(0)).alias("relevance")
    )


def _gain(relevance: str, rank: str):
    positive = F.greatest(F.col(relevance), F.lit(0))
    return positive / F.log2(F.col(rank) + 1)


def _cut_sums(value, rank: str, ks, prefix: str):
    return [
        F.sum(F.when(F.col(rank) <= k, value).otherwise(F.lit(0.0))).alias(f"{prefix}{k}")
        for k in ks
    ]


def _ideal(qrels: DataFrame, ks) -> DataFrame:
    """Best reachable gain per cutoff and number of relevant documents."""
    relevant = qrels.filter("score > 0")
    totals = relevant.groupBy(*_QUERY).agg(F.count(F.lit(1)).alias("n_relevant"))
    order = _by(F.desc("score"), "doc_id")
    best = (
        relevant.withColumn("ideal_rank", F.row_number().over(order))
        .filter(F.col("ideal_rank") <= max(ks))
        .groupBy(*_QUERY)
        .agg(*_cut_sums(_gain("score", "ideal_rank"), "ideal_rank", ks, "ideal"))
    )
    return (
        qrels.select(*_QUERY).distinct()
        .join(totals, _QUERY, "left").join(best, _QUERY, "left")
        .na.fill(0)
    )


def _long(df: DataFrame, values: dict, ks) -> DataFrame:
    """One row per query, metric and cutoff."""
    cells = F.array(*[
        F.struct(F.lit(name).alias("metric"), F.lit(k).alias("k"),
                 F.coalesce(make(k), F.lit(0.0)).alias("value"))
        for name, make in values.items() for k in ks
    ])
    return df.select(*_QUERY, F.inline(cells))


def ndcg_at_k(run: DataFrame, qrels: DataFrame, ks=(10,), rank: str | None = None) -> DataFrame:
    """Linear gain, logarithmic discount. `rank` names a column with the order by score and
    document id, if the run has one; such a run may hold its judged documents only."""
    ks = list(ks)
    gains = (
        _judged(run, qrels, max(ks), rank).groupBy(*_QUERY)
        .agg(*_cut_sums(_gain("relevance", "rank"), "rank", ks, "gain"))
    )
    joined = _ideal(qrels, ks).join(gains, _QUERY, "left")
    return _long(
        joined, {"ndcg": lambda k: F.try_divide(F.col(f"gain{k}"), F.col(f"ideal{k}"))}, ks
    )


def ndcg_gold_reordered(hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """nDCG of the first k distinct documents after ordering them by their gold
    relevance, as the published sparse evaluation does. `hits` carry a rank."""
    relevance = qrels.select(*_QUERY, "doc_id", F.col("score").alias("relevance"))
    top = top_unique(hits, k).drop("score").join(relevance, [*_QUERY, "doc_id"], "left")
    run = top.select(*_QUERY, "doc_id", F.coalesce("relevance", F.lit(0)).alias("score"))
    return ndcg_at_k(run, qrels, (k,)).withColumn("metric", F.lit("ndcg_gold_reordered"))


def _relevant(run: DataFrame, qrels: DataFrame, depth: int, rank: str | None) -> DataFrame:
    """The relevant documents among the first `depth`, with rank and relevance. With the
    name of a `rank` column nothing but them is moved."""
    if rank is None:
        run = run.withColumn("rank", F.row_number().over(_by(F.desc("score"), F.desc("doc_id"))))
        rank = "rank"
    relevance = qrels.filter("score > 0").select(*_QUERY, "doc_id", F.col("score").alias("relevance"))
    return run.select(*_QUERY, "doc_id", F.col(rank).alias("rank")).filter(F.col("rank") <= depth).join(
        relevance, [*_QUERY, "doc_id"])


def cutoff_metrics(run: DataFrame, qrels: DataFrame, ks=C.METRIC_CUTOFFS,
                   names=("map", "mrr", "recall", "precision", "ndcg"), rank: str | None = None) -> DataFrame:
    """All metrics at all cutoffs from one ranked table; nothing is exploded
    before the per-query aggregation, and only relevant hits are ordered. `rank` names a
    column with the order by score and document id, if the run has one."""
    ks = list(ks)
    up_to = _by("rank").rowsBetween(Window.unboundedPreceding, 0)
    judged = _relevant(run, qrels, max(ks), rank).withColumn("hit", F.lit(1)).withColumn(
        "hits_so_far", F.sum("hit").over(up_to)
    )
    at_hit = F.col("hits_so_far") / F.col("rank")
    sums = judged.groupBy(*_QUERY).agg(
        *_cut_sums(F.col("hit").cast("double"), "rank", ks, "hits"),
        *_cut_sums(at_hit, "rank", ks, "ap"),
        *_cut_sums(_gain("relevance", "rank"), "rank", ks, "gain"),
        F.min("rank").alias("first_hit"),
    )
    joined = _ideal(qrels, ks).join(sums, _QUERY, "left")
    makers = {
        "map": lambda k: F.try_divide(F.col(f"ap{k}"), F.col("n_relevant")),
        "mrr": lambda k: F.when(F.col("first_hit") <= k, 1 / F.col("first_hit")),
        "recall": lambda k: F.try_divide(F.col(f"hits{k}"), F.col("n_relevant")),
        "precision": lambda k: F.col(f"hits{k}") / F.lit(k),
        "ndcg": lambda k: F.try_divide(F.col(f"gain{k}"), F.col(f"ideal{k}")),
    }
    return _long(joined, {name: makers[name] for name in names}, ks)


def mean_metric(per_query: DataFrame, *labels: str) -> DataFrame:
    """Mean over queries per language (and task, model, ... if present)."""
    return per_query.groupBy(*labels, "language", "metric", "k").agg(F.avg("value").alias("value"))


def upsert_results(old: DataFrame, new: DataFrame,
                   entry=("task", "language", "model")) -> DataFrame:
    """Earlier results with the entries of the new run replaced."""
    entry = list(entry)
    return old.join(new.select(*entry).distinct(), entry, "left_anti").unionByName(new)


def newest_results(runs: DataFrame, entry=("task", "language", "model"), run: str = "run") -> DataFrame:
    """Of each entry the results of the run that began last, whichever ended last. `run`
    sorts by the time of beginning and names one run."""
    entry = list(entry)
    last = runs.groupBy(*entry).agg(F.max(run).alias(run))
    return runs.join(last, [*entry, run], "left_semi")
