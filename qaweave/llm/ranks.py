"""Numbering rows inside groups of any size, in parallel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(rows: DataFrame, keys: list[str], rows_of_key: str, draw: str, run_rows: int, name: str = "rank") -> DataFrame:
    """Adds `name`, 0 to n-1 inside each group of equal `keys` (missing values are equal).

    `rows_of_key` is a column with the group's row count, `draw` one of evenly spread
    longs. A group is dealt into runs of about `run_rows` rows by the draw; a run is
    numbered in one task, from the number of rows in the runs before it. So a group that
    holds a third of all rows is numbered by many tasks, and the same draws give the same
    ranks again.
    """
    dealt = rows.withColumn("__run", F.pmod(F.shiftright(draw, 20), F.ceil(F.col(rows_of_key) / run_rows)))
    counts = dealt.groupBy(*keys, "__run").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__run").alias("__r"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col("__run") == F.col("__r"))
    in_run = F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(draw)) - 1
    return (
        dealt.withColumn("__in", in_run).join(starts, same)
        .withColumn(name, F.col("__start") + F.col("__in"))
        .drop("__run", "__r", "__start", "__in", *[f"__k{i}" for i in range(len(keys))])
    )
