"""Corpus statistics.

Every metric is first aggregated per language (map-side combine, one small row
per key) and only that result is rolled up, so rows are never multiplied.
The overall row has a null key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaweave import constants as C


def _is_large(large) -> F.Column:
    return F.col("language").isin(list(large))


def language_lists(df: DataFrame, large=C.LARGE_LANGUAGES) -> DataFrame:
    """One row: number and sorted list of languages, split by size class."""
    languages = df.select("language").distinct().withColumn("is_large", _is_large(large))

    def listed(column):
        return F.sort_array(F.collect_set(column))

    named = F.col("language")
    return languages.agg(
        listed(named).alias("languages"),
        listed(F.when(F.col("is_large"), named)).alias("large_languages"),
        listed(F.when(~F.col("is_large"), named)).alias("small_languages"),
    ).withColumns(
        {
            "num_languages": F.size("languages"),
            "num_large_languages": F.size("large_languages"),
            "num_small_languages": F.size("small_languages"),
        }
    )


def pairs_per_language(df: DataFrame) -> DataFrame:
    per = df.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    return per.rollup("language").agg(F.sum("n").alias("qa_pairs"))


def hosts_per_language(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy("language").agg(count("scheme_host").alias("scheme_hosts"))


def _lengths(df: DataFrame, column: str) -> DataFrame:
    size = F.length(column)
    per = df.groupBy("language").agg(
        F.min(size).alias("lo"), F.max(size).alias("hi"),
        F.sum(size).alias("total"), F.count(size).alias("n"),
    )
    return (
        per.rollup("language")
        .agg(
            F.min("lo").alias("min_length"), F.max("hi").alias("max_length"),
            F.sum("total").alias("total"), F.sum("n").alias("n"),
        )
        .select("language", "min_length", "max_length",
                (F.col("total") / F.col("n")).alias("avg_length"))
    )


def question_lengths(df: DataFrame) -> DataFrame:
    return _lengths(df, "question")


def answer_lengths(df: DataFrame) -> DataFrame:
    return _lengths(df, "answer")


def corpus_sizes(df: DataFrame) -> DataFrame:
    """Pairs and text lengths per language and overall (`_overall` = 1), from one
    scan of the texts."""
    sums = [F.count(F.lit(1)).alias("n")]
    for name in ("question", "answer"):
        size = F.length(name)
        sums += [F.min(size).alias(f"{name}_min"), F.max(size).alias(f"{name}_max"),
                 F.sum(size).alias(f"{name}_sum")]
    rolled = df.groupBy("language").agg(*sums).rollup("language").agg(
        F.grouping("language").cast("int").alias("_overall"),
        F.sum("n").alias("qa_pairs"),
        *[
            getattr(F, how)(f"{name}_{how}").alias(f"{name}_{how}")
            for name in ("question", "answer") for how in ("min", "max", "sum")
        ],
    )
    return rolled.withColumns({
        f"{name}_avg": F.col(f"{name}_sum") / F.col("qa_pairs") for name in ("question", "answer")
    })


def _labelled(faq: DataFrame, labels: DataFrame, large) -> DataFrame:
    return faq.filter(_is_large(large)).select("language", "id").join(labels, ["language", "id"])


def label_counts(faq: DataFrame, labels: DataFrame, large=C.LARGE_LANGUAGES) -> DataFrame:
    """Rows per language, topic and question type of the large languages."""
    return _labelled(faq, labels, large).groupBy("language", "topic", "question_type").agg(
        F.count(F.lit(1)).alias("n")
    )


def _pairs_per(labelled: DataFrame, name: str) -> DataFrame:
    per = labelled.filter(F.col(name).isNotNull()).groupBy("language", name).agg(
        F.count(F.lit(1)).alias("n")
    )
    return per.groupingSets([("language", name), (name,)], "language", name).agg(
        F.sum("n").alias("qa_pairs")
    )


def pairs_per_topic(faq: DataFrame, labels: DataFrame, large=C.LARGE_LANGUAGES) -> DataFrame:
    return _pairs_per(_labelled(faq, labels, large), "topic")


def pairs_per_question_type(faq: DataFrame, labels: DataFrame,
                            large=C.LARGE_LANGUAGES) -> DataFrame:
    return _pairs_per(_labelled(faq, labels, large), "question_type")


def _flagged(faq: DataFrame, labels: DataFrame, flags: DataFrame, large) -> DataFrame:
    """Rows of the large languages with readable label and flag rows."""
    readable = labels.filter("topic is not null and question_type is not null")
    return (
        faq.filter(_is_large(large))
        .select("language", "id", "scheme_host")
        .join(readable.select("language", "id"), ["language", "id"])
        .join(flags, ["language", "id"])
        .filter(F.col("filter").isNotNull() & F.col("near_duplicate_similarity").isNotNull())
    )


def filtered_counts(faq: DataFrame, labels: DataFrame, flags: DataFrame,
                    limits=C.REPORTED_SIMILARITIES, large=C.LARGE_LANGUAGES) -> DataFrame:
    """Filtered and kept rows per similarity limit, per language and overall."""
    rows = _flagged(faq, labels, flags, large)
    out = [
        F.col("filter") | (F.col("near_duplicate_similarity") >= F.lit(limit)) for limit in limits
    ]
    counts = [F.count_if(c).alias(f"n{i}") for i, c in enumerate(out)]
    per = rows.groupBy("language").agg(F.count(F.lit(1)).alias("total"), *counts)
    totals = per.rollup("language").agg(
        F.sum("total").alias("total"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(out))]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(float(limit)).alias("similarity"),
                F.col(f"n{i}").alias("filtered"),
                (F.col("total") - F.col(f"n{i}")).alias("kept"),
            )
            for i, limit in enumerate(limits)
        ]
    )
    return totals.select("language", F.inline(entries))


def multilingual_hosts(faq: DataFrame, labels: DataFrame, flags: DataFrame,
                       limit: float | None = None, large=C.LARGE_LANGUAGES) -> DataFrame:
    """Rows per language of hosts with unflagged rows in more than one large
    language. The published job does not look at the similarity; `limit` does.
    The list per host is bounded by the number of large languages."""
    rows = _flagged(faq, labels, flags, large).filter(~F.col("filter"))
    if limit is not None:
        rows = rows.filter(F.col("near_duplicate_similarity") < limit)
    per = rows.groupBy("scheme_host", "language").agg(F.count(F.lit(1)).alias("n"))
    return (
        per.groupBy("scheme_host")
        .agg(F.sort_array(F.collect_list(F.struct("language", "n"))).alias("entries"))
        .filter(F.size("entries") > 1)
        .select("scheme_host", F.map_from_entries("entries").alias("counts"))
    )
