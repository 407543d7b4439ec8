"""Pair mining from flagged and embedded rows to candidate records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from qaweave import constants as C
from qaweave.operators import parallel as P
from qaweave.operators.blocks import BLOCK_ROWS


def mine_pairs(docs: DataFrame, limit: float = C.PAIR_SIMILARITY,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    return P.pair_record(P.mutual_best_pairs(docs, limit, block_rows), docs)
