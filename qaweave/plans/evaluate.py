"""Retrieval evaluation of all languages of a task in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaweave.operators import metrics as M
from qaweave.operators import ranking as R

#: Documents of a run that is measured at all cutoffs or fused.
RUN_DEPTH = 1000


def _entries(values: DataFrame, task: str, model: str) -> DataFrame:
    return M.mean_metric(values).select(
        F.lit(task).alias("task"), "language", F.lit(model).alias("model"), "metric", "k", "value"
    )


def sparse_hits(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """The documents among the first k of a BM25 run that decide nDCG after gold reordering.
    One without a judgement has gain 0 at any place, so only judged ones leave the run. A
    document that a query judges both above 0 and not stands between those without; such
    queries give their whole run."""
    key = ["language", "query_id"]
    hits = R.bm25_topk(queries, corpus, k, judged=qrels)
    score = F.coalesce("score", F.lit(0))
    odd = qrels.groupBy(*key, "doc_id").agg(F.max(score).alias("most"), F.min(score).alias("least")).filter(
        "most > 0 and least <= 0").select(*key).distinct()
    if odd.isEmpty():
        return hits
    whole = R.bm25_topk(queries.join(odd, key, "left_semi"), corpus, k)
    return hits.join(odd, key, "left_anti").unionByName(whole)


def evaluate_sparse(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, task: str,
                    k: int = 10) -> DataFrame:
    """BM25, scored as published: nDCG@10 after gold reordering."""
    return _entries(
        M.ndcg_gold_reordered(sparse_hits(queries, corpus, qrels, k), qrels), task, "bm25"
    )


def evaluate_dense(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, task: str,
                   model: str, k: int = RUN_DEPTH, run: DataFrame | None = None) -> DataFrame:
    """All metrics at all cutoffs for vector tables, or for the run that is already there."""
    if run is None:
        run = R.dense_topk(queries, corpus, k)
    return _entries(M.cutoff_metrics(run, qrels, rank="rank"), task, model)


def evaluate_hybrid(sparse: DataFrame, dense: DataFrame, qrels: DataFrame,
                    task: str) -> DataFrame:
    """Fusion of two ranked runs, scored as published."""
    return _entries(
        M.ndcg_gold_reordered(R.hybrid_scores(sparse, dense), qrels), task, "hybrid"
    )
