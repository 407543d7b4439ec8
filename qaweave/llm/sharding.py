"""Sharding by histogram sort: refine splitters on exact byte counts, exchange once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qaweave.session import stored

#: Hexadecimal digits that one round of probes adds: 65,536 candidate boundaries a prefix.
STEP = 4
#: Digits of a whole key: hash of the text, then hash of the id.
KEY_DIGITS = 32
#: Bytes of a document besides its text.
OVERHEAD = 16


@dataclass(frozen=True)
class Bracket:
    """Keys with this prefix hold the target; bytes counts the bytes before and within."""

    prefix: str
    before: int
    bytes: int


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the sort key. Equal texts share the first half of
    the key, so they stand together in key order."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(
        docs[id_col].alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.concat(hex64(F.xxhash64(text)), hex64(F.xxhash64(docs[id_col], F.lit("id")))).alias("key"),
    )


def probe(keys: DataFrame, brackets: dict[int, Bracket], targets: dict[int, int]) -> dict[int, Bracket]:
    """One round: exact bytes of every prefix that is one step longer than the brackets',
    summed below each candidate boundary; the new bracket of each target. At most one
    row per target reaches the driver."""
    digits = len(next(iter(brackets.values())).prefix)
    prefixes = sorted({b.prefix for b in brackets.values()})
    inside = keys.withColumn("p", F.substring("key", 1, digits)) if digits else keys.withColumn("p", F.lit(""))
    if digits:
        inside = inside.filter(F.col("p").isin(prefixes))
    counts = inside.groupBy("p", F.substring("key", 1, digits + STEP).alias("q")).agg(F.sum("size").alias("bytes"))
    below = Window.partitionBy("p").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("below", F.coalesce(F.sum("bytes").over(below), F.lit(0)))
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(brackets[i].prefix).alias("p"), F.lit(brackets[i].before).cast("long").alias("before"),
                 F.lit(targets[i]).cast("long").alias("target"))
        for i in sorted(brackets)])
    hits = (
        counts.withColumn("w", F.explode(F.filter(wanted, lambda w: (
            (w["p"] == F.col("p")) & (w["before"] + F.col("below") < w["target"])
            & (w["before"] + F.col("below") + F.col("bytes") >= w["target"])))))
        .select("w.i", "q", (F.col("w.before") + F.col("below")).alias("before"), "bytes")
    )
    return {r.i: Bracket(r.q, r.before, r.bytes) for r in hits.collect()}


def after(prefix: str) -> str:
    """The least key above all keys with this prefix; beyond the last digit, "g"."""
    value = int(prefix, 16) + 1
    return "g" if value == 16 ** len(prefix) else f"{value:0{len(prefix)}x}"


def splitters(keys: DataFrame, total: int, shards: int, tolerance: float) -> list[str]:
    """The `shards` - 1 least keys of the shards but the first. A boundary is settled
    when the bytes below it are within `tolerance` of a shard's share of its target, or
    when no key is left between the probes; then the nearer side is taken."""
    slack = tolerance * total / shards
    targets = {i: -(-total * i // shards) for i in range(1, shards)}
    open_, done = {i: Bracket("", 0, total) for i in targets}, {}
    while open_:
        open_ = probe(keys, open_, targets)
        for i, b in list(open_.items()):
            low, high = targets[i] - b.before, b.before + b.bytes - targets[i]
            if min(low, high) <= slack or len(b.prefix) == KEY_DIGITS:
                done[i] = b.prefix if low <= high else after(b.prefix)
                del open_[i]
    return [done[i] for i in sorted(done)]


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.01, id_col: str = "doc_id",
          text_col: str = "text", run_rows: int = 50_000) -> DataFrame:
    """Deal documents into shards of near equal bytes: doc_id, size, text_crc32, shard, slot.

    Keys are sorted by (hash of text, hash of id). Rounds of exact counts narrow each
    splitter down four hexadecimal digits at a time, so a group of equal texts that holds
    a third of all rows is cut inside, by id, and smaller groups stay in one shard where
    the tolerance allows it. Each round reads a narrow stored table of keys and brings
    one row per splitter to the driver. Then rows move once, to runs: the keys of a shard
    with the same first four digits, and runs above `run_rows` rows cut further by their
    id's hash. A run is numbered in one task; its first slot comes from the run counts
    (at most 65,536 rows of them for usual runs).

    Sizes are UTF-8 bytes plus 16; a missing text counts as empty, a missing id as an id
    of its own. Repeated rows (same id and text) have equal keys and stay in one shard.
    An empty table gives an empty result. Other columns are not read.
    """
    keys = stored(keyed(docs, id_col, text_col), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    cuts = splitters(keys, total, shards, tolerance) if total and shards > 1 else []
    cuts_at_or_below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    runs = keys.withColumn("bin", F.substring("key", 1, STEP)).withColumn("shard", cuts_at_or_below)
    # At most one row for each of the 65,536 bins and each splitter, so it can be broadcast.
    heavy = runs.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > run_rows)
    runs = (
        runs.join(F.broadcast(heavy), ["shard", "bin"], "left")
        .withColumn("part", F.when(F.col("n").isNotNull(), F.pmod(
            F.xxhash64("doc_id", F.lit("run")), F.ceil(F.col("n") / run_rows))).otherwise(0))
    )
    counts = runs.groupBy("shard", "bin", "part").agg(F.count(F.lit(1)).alias("rows"))
    ahead = Window.partitionBy("shard").orderBy("bin", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bin", "part", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bin", "part").orderBy("key", "doc_id")
    return (
        runs.withColumn("rank", F.row_number().over(order)).join(counts, ["shard", "bin", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))
    )
