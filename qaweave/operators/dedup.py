"""First-wins deduplication and the union of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key.

    An aggregate, not a window: copies meet in the map-side combine, so a key
    that holds a third of all rows leaves one row per map task."""
    payload = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*payload), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*df.columns)


def dedup_exact(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """First row per id inside `by` (the input file for extraction)."""
    return first_per_key(df, [*by, "id"], order)


def merge_parts(parts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Union of all parts of a language, first row per id in (url, part, row).

    Rows of an earlier result rank last on an equal url. The result carries
    `late`, `part` and `row`, so its order is written down."""
    rows = parts.withColumn("late", F.lit(False))
    if existing is not None:
        rows = rows.unionByName(existing.withColumn("late", F.lit(True)), allowMissingColumns=True)
    return first_per_key(rows, ["language", "id"], ["url", "late", "part", "row"])


def in_merge_order(df: DataFrame) -> DataFrame:
    """Range exchange and local sort; the sort key is unique, so any url, however
    frequent, is split over tasks."""
    return df.orderBy("language", "url", "late", "part", "row")
