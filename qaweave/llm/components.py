"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaweave.session import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (two long columns, any order, repeats and
    loops allowed); the root is the least node of the component.

    Each round hangs the larger neighbours of a node below its least neighbour, then all
    smaller ones, until nothing changes: the edges are then stars. A round is two
    aggregations and two joins on the node; its result is a stored table, so lineage
    stays short, and only a count and a checksum reach the driver. A node with many
    neighbours is folded in map tasks and its join side can be split.
    """
    a, b = edges.columns
    stars = stored(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "stars")
    state = _state(stars)
    while state[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(below, "a").select(F.explode(F.array(
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").filter("a != b").distinct()
        )
        stars = stored(small, "stars")
        before, state = state, _state(stars)
        if state == before:
            break
    roots = stars.select("b").distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
