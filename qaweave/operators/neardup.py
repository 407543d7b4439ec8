"""Exact and near duplicate flags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaweave import constants as C
from qaweave.functions.vectors import cosine
from qaweave.operators.blocks import BLOCK_ROWS, PART_BLOCKS, cell_columns, in_block_cells, stripes, unit_rows
from qaweave.operators.streams import matrix, streamed


def flag_exact_question(df: DataFrame) -> DataFrame:
    """`exact_duplicate` on every later row with the same question in a language.

    The first rows are found by aggregation and joined back on the row's own
    position, a unique key, so a frequent question is no hot join key."""
    firsts = (
        df.groupBy("language", "question").agg(F.min("pos").alias("pos"))
        .select("language", "pos", F.lit(True).alias("_first"))
    )
    return (
        df.join(firsts, ["language", "pos"], "left")
        .withColumn("exact_duplicate", F.col("_first").isNull())
        .select(*df.columns, "exact_duplicate")
    )


def flag_qa_mismatch(df: DataFrame, limit: float = C.QA_SIMILARITY) -> DataFrame:
    """`qa_mismatch` where question and answer vectors are too far apart."""
    similarity = cosine(F.col("question_embedding"), F.col("answer_embedding"))
    return df.withColumn("qa_mismatch", similarity < F.lit(limit))


def _alone(a: np.ndarray) -> np.ndarray:
    """Each row's largest product with another row of the block."""
    best = np.zeros(len(a))
    for start, s in stripes(a, a):
        s[np.arange(len(s)), np.arange(start, start + len(s))] = 0.0
        best[start:start + len(s)] = np.maximum(s.max(axis=1), 0.0)
    return best


def near_duplicate_similarity(df: DataFrame, group=("language", "scheme_host"), key: str = "id",
                              vector: str = "question_embedding",
                              block_rows: int = BLOCK_ROWS, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """Largest cosine of each row to another row of its group, at least 0."""
    group = list(group)
    keys = [*group, key]
    cells = in_block_cells(df.select(*keys, vector), group, [key], block_rows, part_blocks)
    schema = df.select(*keys).schema.add("best", "double")

    def maxima(batches):
        for held, passing in streamed(batches, cell_columns(group)):
            if held is None:
                continue
            mine = unit_rows(matrix(held.column(vector)))
            best = _alone(mine) if held.column("alone")[0].as_py() else np.zeros(len(mine))
            for batch in passing:
                theirs = unit_rows(matrix(batch.column(vector)))
                most = np.zeros(len(theirs))
                for start, s in stripes(theirs, mine):
                    most[start:start + len(s)] = np.maximum(s.max(axis=1), 0.0)
                    best = np.maximum(best, s.max(axis=0))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(most)], schema.names)
            columns = [held.column(k).combine_chunks() for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best)], schema.names)

    return cells.mapInArrow(maxima, schema).groupBy(*keys).agg(F.max("best").alias("near_duplicate_similarity"))


def make_flags(faq: DataFrame, vectors: DataFrame, limit: float = C.QA_SIMILARITY,
               group=("language", "scheme_host"), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Flag and similarity for every row; similarity is 0 where none is computed.

    A row with vectors that is no exact duplicate and comes back without a
    similarity failed the question-answer test, so that test runs once."""
    marked = flag_exact_question(faq.select("language", "scheme_host", "id", "pos", "question"))
    tested = flag_qa_mismatch(
        marked.filter("not exact_duplicate").join(vectors, ["language", "id"]), limit
    ).filter("not qa_mismatch")
    similar = near_duplicate_similarity(tested, group, "id", "question_embedding", block_rows)
    known = vectors.select("language", "id", F.lit(True).alias("_known"))
    found = F.col("near_duplicate_similarity")
    return (
        marked.select("language", "id", "exact_duplicate")
        .join(known, ["language", "id"], "left")
        .join(similar.select("language", "id", found), ["language", "id"], "left")
        .select(
            "language",
            "id",
            (F.col("exact_duplicate") | (F.col("_known").isNotNull() & found.isNull())).alias("filter"),
            F.coalesce(found, F.lit(0.0)).alias("near_duplicate_similarity"),
        )
    )


def apply_flags(faq: DataFrame, flags: DataFrame,
                limit: float = C.NEAR_DUPLICATE_SIMILARITY) -> DataFrame:
    kept = flags.filter(~F.col("filter") & (F.col("near_duplicate_similarity") < F.lit(limit)))
    return faq.join(kept.select("language", "id"), ["language", "id"], "left_semi")
