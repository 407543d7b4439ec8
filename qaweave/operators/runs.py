"""Runs of equal hosts in row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaweave.operators.ordered import CHUNK_ROWS, previous_value, running_sum


def _with_starts(df: DataFrame, group: list[str], pos: str, value: str, rows: int) -> DataFrame:
    """`_start` is 1 on the first row of a run. The marker `_seen` tells a missing
    previous row from a previous null."""
    seen = df.withColumn("_seen", F.struct(F.col(value).alias("v")))
    return (
        previous_value(seen, group, pos, "_seen", "_prev", rows)
        .withColumn(
            "_start",
            F.when(
                F.col("_prev").isNull() | ~F.col("_prev.v").eqNullSafe(F.col(value)), F.lit(1)
            ).otherwise(F.lit(0)),
        )
        .drop("_prev", "_seen")
    )


def host_runs(df: DataFrame, group=("language",), pos: str = "pos", value: str = "scheme_host",
              rows: int = CHUNK_ROWS) -> DataFrame:
    """Maximal runs of equal hosts; a host may own several."""
    group = list(group)
    starts = _with_starts(df.select(*group, pos, value), group, pos, value, rows)
    return (
        running_sum(starts, group, pos, "_start", "run_id", rows)
        .groupBy(*group, value, "run_id")
        .agg(F.min(pos).alias("first_pos"), F.count(F.lit(1)).alias("n_rows"))
    )


def first_of_run(df: DataFrame, group=("language",), pos: str = "pos",
                 value: str = "scheme_host", rows: int = CHUNK_ROWS) -> DataFrame:
    return _with_starts(df, list(group), pos, value, rows).filter("_start = 1").drop("_start")


def rows_of_host(df: DataFrame, hosts: DataFrame) -> DataFrame:
    """All rows of the given hosts, in every language."""
    return df.join(hosts.select("scheme_host").distinct(), "scheme_host", "left_semi")
