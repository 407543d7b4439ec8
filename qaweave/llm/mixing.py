"""Mixing sources to target weights: subset-sum fitting of each source's word budget."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qaweave.llm.ranks import ranked
from qaweave.llm.texts import WORD, row_key
from qaweave.session import stored


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, target: one row per source.

    Sources by code point, a missing one last, weigh as `weights` says, repeating. They
    share `share` of all words; no target passes `most` times its source's words, and
    what is cut off goes to the others by weight. So each target is the smaller of its
    limit and weight x level; the level follows from the sources in order of the level
    at which they reach their limit. One narrow row per source passes one task here.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    leveled = ranked.withColumns({
        "level": (F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    })
    # The first source whose limit is above its share sets the level of all after it.
    final = F.min(F.when(F.col("limit") >= F.col("weight") * F.col("level"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(everyone)["level"]
    return leveled.select("source", "source_size", F.least("limit", F.col("weight") * F.coalesce(final, F.col("limit") / F.col("weight"))).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 8192) -> np.ndarray:
    """How many documents of each length to take so that their words come as near below
    `budget` as the lengths allow: even shares first, then single documents in order of
    their lost fraction until the rest is small, then a bounded knapsack over the rest. A
    budget within the window is all knapsack, and the sum is then the best there is.
    """
    total = sum(int(a) * int(n) for a, n in zip(lengths, counts))
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    # Half a window is held back, so that the knapsack has room to choose.
    even = max(0, budget - window // 2)
    exact = [(int(n) * even) for n in counts]
    take = np.array([x // total for x in exact], np.int64)
    rest = budget - sum(int(a) * int(k) for a, k in zip(lengths, take))
    for i in sorted(range(len(lengths)), key=lambda i: (-(exact[i] % total), int(lengths[i]))):
        if rest <= window:
            break
        if take[i] < counts[i] and lengths[i] <= rest - window // 4:
            take[i] += 1
            rest -= int(lengths[i])
    # Reachable sums as bits; the items of a length in powers of two.
    items = []
    for i, a in enumerate(map(int, lengths)):
        left = min(int(counts[i] - take[i]), rest // a if a else 0)
        k = 1
        while left > 0:
            items.append((i, min(k, left)))
            left -= min(k, left)
            k *= 2
    full, sums = (1 << (rest + 1)) - 1, [1]
    for i, k in items:
        sums.append((sums[-1] | sums[-1] << (int(lengths[i]) * k)) & full)
    at = sums[-1].bit_length() - 1
    for (i, k), before in zip(reversed(items), reversed(sums[:-1])):
        if not before >> at & 1:
            take[i] += k
            at -= int(lengths[i]) * k
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", ignore_index=True)
    target, words = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
    base = 1 if words and target >= words else 0
    rows["base"] = base
    rows["take"] = fit(rows["size"].to_numpy(), rows["docs"].to_numpy(), round(target) - base * words)
    return rows[["source", "size", "docs", "source_size", "target", "base", "take"]]


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", run_rows: int = 4096) -> DataFrame:
    """How often the mix takes each document: one row per row of `docs` with id, th (hash
    of the text), doc_id, source, size, source_size, target, times (0, 1 or 2) and taken.

    Sizes are words. A source whose target reaches its own words is taken once whole; the
    rest of its budget is a subset-sum fit on its table of (length, documents), which has
    one row per distinct length and so is bounded by the longest document, not by the
    number of documents. Documents of a length are picked by a seeded hash of id and text:
    the documents of one length are dealt into runs of about `run_rows` by that hash, whole
    runs are taken and one run is ranked, so a hot source or length is never in one task.

    Texts are counted whole, however long; equal lengths of a source are told apart by the
    seeded hash alone. A missing text has no words and is never taken; a missing source is one source, last
    in order; a missing id is hashed as the largest id. Repeated rows count as documents of
    their own; which of rows alike in id, source and text is taken does not matter. No
    table row is left out: an empty table gives an empty result. Other columns are not read.
    """
    base = docs.select(
        *row_key(docs, id_col, text_col), docs[id_col].alias("doc_id"), docs[source_col].alias("source"),
        F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = stored(base, "mix-sizes")
    plan = (
        sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs"))
        .join(source_targets(sized, weights, share, most).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .groupBy("source")
        .applyInPandas(_fit_source, "source string, size long, docs long, source_size long, target double, base int, take long")
        .select(F.col("source").alias("s"), F.col("size").alias("z"), "docs", "source_size", "target", "base", "take")
    )
    plan = stored(plan, "mix-plan")
    draw = F.xxhash64(F.lit(seed), "id", "th")
    dealt = (
        sized.withColumn("draw", draw)
        .join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    )
    picked = ranked(dealt, ["source", "size"], "docs", "draw", run_rows).withColumn(
        "times", F.when(F.col("size") == 0, 0).otherwise(F.col("base") + (F.col("rank") < F.col("take")).cast("int")))
    return picked.select("id", "th", "doc_id", "source", "size", "source_size", "target", "times",
                         (F.col("size") * F.col("times")).alias("taken"))
