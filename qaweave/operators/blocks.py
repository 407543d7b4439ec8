"""Exact all-against-all work inside groups of any size.

A group is cut into blocks of a bounded number of rows, and blocks into parts. A task
holds one block while the rows of earlier blocks' partners stream past it, and gives back
best values per row, never pairs. A row of a group of n rows is copied at most n / block
rows times to pass and n / part rows times to be held; a group of one block is held once
and copied never.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaweave.operators.streams import HELD, PASSING, in_cells

# A held block of 512 dimensions in double is 128 MiB, a stripe of products 64 MiB.
BLOCK_ROWS = 32768
#: Blocks that pass one held block in one task.
PART_BLOCKS = 16
MOST_PRODUCTS = 8_000_000
# Sums of products differ in the last bits with the block shape; rounding here
# makes ties and limits independent of it.
DIGITS = 12


def cell_columns(group: list[str]) -> list[str]:
    return [*group, "block", "part"]


def in_block_cells(df: DataFrame, group: list[str], key: list[str], block_rows: int = BLOCK_ROWS,
                   part_blocks: int = PART_BLOCKS) -> DataFrame:
    """Rows of `df` in cells of a held `block` and a `part` of the later blocks, with `side`
    and `alone` (the held block meets itself in this cell), in order of `key`.

    Only groups of more than one block are in the joined table: at most one row
    per `block_rows` input rows. Its size decides at run time how it is joined."""
    crowded = (
        df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > block_rows)
        .select(*group, F.ceil(F.col("_n") / F.lit(block_rows)).cast("int").alias("_blocks"))
    )
    blocks = F.coalesce(F.col("_blocks"), F.lit(1))
    placed = df.join(crowded, group, "left").select(
        *df.columns, blocks.alias("_blocks"),
        F.pmod(F.xxhash64(*key), blocks).cast("int").alias("_own"),
    )
    own_part = F.floor(F.col("_own") / part_blocks).cast("int")
    last_part = F.floor((F.col("_blocks") - 1) / part_blocks).cast("int")
    # One pass over the table: each row once per cell that holds it or that it passes.
    held = F.transform(F.sequence(own_part, last_part), lambda p: F.struct(
        F.col("_own").alias("block"), p.alias("part"), F.lit(HELD).alias("side"), (p == own_part).alias("alone")))
    before = F.when(F.col("_own") > 0, F.sequence(F.lit(0), F.col("_own") - 1)).otherwise(F.array().cast("array<int>"))
    passing = F.transform(before, lambda b: F.struct(
        b.alias("block"), own_part.alias("part"), F.lit(PASSING).alias("side"), F.lit(False).alias("alone")))
    cells = placed.withColumn("_cell", F.explode(F.concat(held, passing))).select(*df.columns, "_cell.*")
    return in_cells(cells, cell_columns(group), *[F.col(k) for k in key])


def unit_rows(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if len(m) else m


def stripes(a: np.ndarray, b: np.ndarray):
    """Products of `a` with `b`, a bounded number of them at a time."""
    rows = max(1, MOST_PRODUCTS // max(len(b), 1))
    for start in range(0, len(a), rows):
        yield start, np.round(a[start:start + rows] @ b.T, DIGITS)
