"""Seeded samples and training sets. The same seed gives the same rows on every
run and partitioning; the rows of another generator are not reproduced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaweave import constants as C
from qaweave.functions.seeded import draw, unit_draw
from qaweave.operators.ordered import CHUNK_ROWS, numbered
from qaweave.operators.runs import first_of_run


def _per_language(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("language").agg(F.count(F.lit(1)).alias(name))


def circular_sample(qrels: DataFrame, limits=C.TRAINING_LIMITS, seed: int = 42,
                    rows: int = CHUNK_ROWS) -> DataFrame:
    """From a drawn start `limit` consecutive rows per language, wrapping round;
    at most all rows. Languages without a limit are left out."""
    table = F.create_map(*[F.lit(x) for item in limits.items() for x in item])
    wanted = qrels.withColumn("_limit", F.try_element_at(table, F.col("language"))).filter(
        "_limit is not null"
    )
    # One row per listed language.
    starts = _per_language(wanted, "_n").withColumn(
        "_start", F.pmod(draw(seed, "language"), F.col("_n"))
    )
    placed = numbered(wanted, ["language"], "pos", "_rn", rows).join(
        F.broadcast(starts), "language"
    )
    turn = F.pmod(F.col("_rn") - 1 - F.col("_start"), F.col("_n"))
    return placed.filter(turn < F.col("_limit")).select(*qrels.columns, turn.alias("sample_pos"))


def training_pairs(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Sampled judgements to (query, positive)."""
    q = queries.select("language", "query_id", F.col("text").alias("query"))
    d = corpus.select("language", "doc_id", F.col("text").alias("positive"))
    return qrels.join(q, ["language", "query_id"]).join(d, ["language", "doc_id"])


def monolingual_batches(df: DataFrame, size: int = C.BATCH_ROWS, seed: int = 42,
                        rows: int = CHUNK_ROWS) -> DataFrame:
    """Full groups of `size` consecutive rows of one language. `batch_draw` and
    `row_draw` give the shuffled order between and inside groups."""
    # One row per language.
    totals = _per_language(df, "_n")
    return (
        numbered(df, ["language"], "pos", "_rn", rows)
        .withColumn("batch", F.floor((F.col("_rn") - 1) / F.lit(size)))
        .join(F.broadcast(totals), "language")
        .filter(F.col("batch") < F.floor(F.col("_n") / F.lit(size)))
        .withColumn("batch_draw", draw(seed, "language", F.col("batch").cast("string")))
        .withColumn("row_draw", draw(seed + 1, "language", F.col("pos").cast("string")))
        .drop("_rn", "_n")
    )


def in_batch_order(batches: DataFrame) -> DataFrame:
    return batches.orderBy("batch_draw", "language", "batch", "row_draw", "pos")


def annotation_sample(faq: DataFrame, limit: int = C.ANNOTATION_LIMIT + C.ANNOTATION_BUFFER,
                      min_rows: int = C.ANNOTATION_MIN_ROWS,
                      rows: int = CHUNK_ROWS) -> DataFrame:
    """The first rows of host runs, at most `limit` per language in order;
    languages with fewer than `min_rows` are left out. Keys alone are ordered; the
    rows picked come back by language and position."""
    firsts = first_of_run(faq.select("language", "pos", "scheme_host"), rows=rows)
    enough = _per_language(firsts, "_n").filter(F.col("_n") >= min_rows).select("language")
    picked = (
        numbered(firsts, ["language"], "pos", "sample_rank", rows)
        .filter(F.col("sample_rank") <= limit)
        .join(enough, "language", "left_semi")
        .select("language", "pos", "sample_rank")
    )
    return faq.join(picked, ["language", "pos"])


def split_dataset(df: DataFrame, keys: list[str], seed: int = C.SPLIT_SEED) -> DataFrame:
    """`split`: train, validation or test in shares of 80, 10 and 10 percent."""
    u = unit_draw(seed, *keys)
    return df.withColumn(
        "split",
        F.when(u < 0.8, F.lit("train")).when(u < 0.9, F.lit("validation")).otherwise(F.lit("test")),
    )
