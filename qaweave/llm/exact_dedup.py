"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaweave.session import stored


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    The aggregation runs on (hash, text), so texts of one hash are told apart by their
    bytes, and map tasks fold copies into one row before the exchange: a group that
    holds a third of all rows leaves one row per task. Rows then look up their group by
    the hash and the SHA-256 they carry; the lookup table proves that this pair names
    one text only and stops the job if it does not. So a text crosses the exchange once
    per map task, and never for the lookup. The table is stored first, which leaves both
    sides of the lookup plain exchanges that adaptive execution can split at hot keys.

    `keep` is the id that stays, "smallest" or "largest". A missing text is empty and
    equal to an empty one. A missing id is never the one that stays unless all ids of
    the group are missing; then keep_id is missing. Of rows alike in id and text exactly
    one is kept. An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    pick = {"smallest": F.min, "largest": F.max}[keep]
    base = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), digest(text).alias("h"))
    groups = stored(
        base.groupBy("h", "text")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
        .groupBy("h", "text_sha256")
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
            F.raise_error(F.lit("two texts share both hashes"))))
        .drop("texts"), "text-groups")
    rows = (
        base.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"))
        .groupBy("h", "text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    )
    return rows.join(groups, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
