"""Row numbers, previous values and running sums over long ordered groups.

One language may hold a third of all rows, so a window over a whole group would
be one task. Each group is cut by position into chunks of a bounded number of
rows; windows run inside a chunk, and one summary row per chunk carries the
state from chunk to chunk. Positions are unique whole numbers inside a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1_000_000


def _chunked(df: DataFrame, pos: str, rows: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(pos) / F.lit(rows)))


def _within(group: list[str], pos: str):
    return Window.partitionBy(*group, "_chunk").orderBy(pos)


def _before(group: list[str]):
    """All earlier chunks; one row per chunk of at most `rows` input rows."""
    return (
        Window.partitionBy(*group)
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def running_sum(df: DataFrame, group: list[str], pos: str, value: str, name: str,
                rows: int = CHUNK_ROWS) -> DataFrame:
    """Sum of `value` up to and including each row."""
    cut = _chunked(df, pos, rows)
    summary = (
        cut.groupBy(*group, "_chunk").agg(F.sum(value).alias("_total"))
        .withColumn("_carry", F.coalesce(F.sum("_total").over(_before(group)), F.lit(0)))
        .drop("_total")
    )
    local = cut.withColumn(
        "_local",
        F.sum(value).over(_within(group, pos).rowsBetween(Window.unboundedPreceding, 0)),
    )
    return (
        local.join(summary, [*group, "_chunk"])
        .withColumn(name, F.col("_local") + F.col("_carry"))
        .drop("_chunk", "_local", "_carry")
    )


def numbered(df: DataFrame, group: list[str], pos: str, name: str = "rn",
             rows: int = CHUNK_ROWS) -> DataFrame:
    """Row number 1..n inside the group."""
    cut = _chunked(df, pos, rows)
    summary = (
        cut.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_total"))
        .withColumn("_carry", F.coalesce(F.sum("_total").over(_before(group)), F.lit(0)))
        .drop("_total")
    )
    local = cut.withColumn("_local", F.row_number().over(_within(group, pos)))
    return (
        local.join(summary, [*group, "_chunk"])
        .withColumn(name, F.col("_local") + F.col("_carry"))
        .drop("_chunk", "_local", "_carry")
    )


def previous_value(df: DataFrame, group: list[str], pos: str, value: str, name: str,
                   rows: int = CHUNK_ROWS) -> DataFrame:
    """`value` of the row before; null on the first row of the group."""
    cut = _chunked(df, pos, rows)
    summary = (
        cut.groupBy(*group, "_chunk").agg(F.max_by(value, pos).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*group).orderBy("_chunk")))
        .drop("_last")
    )
    within = _within(group, pos)
    local = cut.withColumn("_local", F.lag(value).over(within)).withColumn(
        "_first", F.row_number().over(within) == 1
    )
    return (
        local.join(summary, [*group, "_chunk"])
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_local")))
        .drop("_chunk", "_local", "_first", "_carry")
    )
