"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All
but the last return the columns of `docs`, whatever they are and are called: rows are kept
whole beside their key. A missing text is empty, a missing doc_id is behind all others,
texts are read whole however long, rows alike in doc_id and text are decided alike (from the
near-duplicate stage on one of them is left), and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaweave.llm import line_dedup, mixing, packing, quality, similar
from qaweave.llm.texts import WORD, whole_rows
from qaweave.session import stored

#: Near-duplicate stage: words of a shingle, least similarity, columns of a fingerprint.
SHINGLE_WORDS, SIMILARITY, FINGERPRINT_WORDS = 5, 0.8, 4


def _decided(docs: DataFrame, decisions: DataFrame, how: str = "inner") -> DataFrame:
    """row (all columns of a row of `docs`) and the columns of `decisions` for its id, th."""
    return whole_rows(docs).join(decisions, ["id", "th"], how)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    rejected = quality.quality(docs).filter("not kept").select("id", "th").distinct()
    return _decided(docs, rejected, "left_anti").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and documents left without a word by that.
    n_chars, where it is there, follows the text."""
    out = line_dedup.line_dedup(docs)
    lines, removed = line_dedup.count_columns(docs)
    kept = out.filter((F.col(removed) == 0) | F.col("text").rlike(WORD)).drop(lines, removed)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in kept.columns else kept


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: the one of least doc_id (a
    missing one last), then of least hash of its text; of repeated rows one. Fingerprints
    find candidates; links are verified similarities."""
    found = similar.similar_dedup(docs, SIMILARITY, SHINGLE_WORDS, FINGERPRINT_WORDS)
    first = stored(found.groupBy("node").agg(F.min(F.struct("id", "th")).alias("k")).select("k.id", "k.th"), "near-firsts")
    return _one_of_each(_decided(docs, first)).select("row.*")


def _one_of_each(rows: DataFrame) -> DataFrame:
    """Of rows alike in id and text the one of least hash over all its columns."""
    columns = [F.col(f"row.`{c}`") for c in rows.schema["row"].dataType.names]
    return rows.groupBy("id", "th").agg(F.min_by("row", F.xxhash64(*columns)).alias("row"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them. Rows alike in id and text are one."""
    taken = mixing.mix(docs).filter("times > 0").groupBy("id", "th").agg(F.sum("times").cast("int").alias("times"))
    mixed = _one_of_each(whole_rows(docs)).join(taken, ["id", "th"])
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in sequences of 2048 tokens."""
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("mix_sources", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Token ids, fingerprint links and subset sums can't be said in SQL; tests/llm holds the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
