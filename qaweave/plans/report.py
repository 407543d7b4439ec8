"""The statistics report and its JSON form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaweave import constants as C
from qaweave.operators import stats


def _sorted_map(key, value, keep=None):
    """Map of a handful of keys; rows outside `keep` are left out."""
    entry = F.struct(key.alias("k"), value.alias("v"))
    return F.map_from_entries(
        F.sort_array(F.collect_list(entry if keep is None else F.when(keep, entry)))
    )


def _classes(labelled: DataFrame, name: str) -> DataFrame:
    """Counts per class, overall and per language."""
    per = labelled.filter(F.col(name).isNotNull()).groupBy("language", name).agg(
        F.sum("n").alias("n")
    )
    overall = per.groupBy(name).agg(F.sum("n").alias("n")).agg(
        _sorted_map(F.col(name), F.col("n")).alias(f"qa_pairs_per_{name}_overall")
    )
    nested = per.groupBy("language").agg(_sorted_map(F.col(name), F.col("n")).alias("m")).agg(
        F.map_from_entries(F.collect_list(F.struct("language", "m"))).alias(
            f"qa_pairs_per_{name}_and_language")
    )
    return _beside([overall, nested])


def _beside(parts: list[DataFrame]) -> DataFrame:
    """One-row tables side by side."""
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    return reduce(lambda x, y: x.join(F.broadcast(y), "_one"), keyed).drop("_one")


def statistics_report(faq: DataFrame, labels: DataFrame, flags: DataFrame,
                      large=C.LARGE_LANGUAGES) -> DataFrame:
    """One row with all metrics. Texts are scanned once for all counts and
    lengths, labels are joined once for both classes, flags once for all limits;
    what is collected is one entry per language, topic or question type."""
    lang = F.col("language")
    overall = F.col("_overall") == 1

    def both(name, value, keep=F.lit(True), note=""):
        return [
            F.max(F.when(keep & overall, value)).alias(f"{name}_overall{note}"),
            _sorted_map(lang, value, keep & ~overall).alias(f"{name}_per_language{note}"),
        ]

    sizes = stats.corpus_sizes(faq)
    lengths = {
        name: F.struct(*[F.col(f"{name}_{x}").alias(x) for x in ("min", "max", "avg")])
        for name in ("question", "answer")
    }
    counted = sizes.agg(
        *both("qa_pairs", F.col("qa_pairs")),
        *both("question_lengths", lengths["question"]),
        *both("answer_lengths", lengths["answer"]),
    )
    hosts = stats.hosts_per_language(faq).agg(
        _sorted_map(lang, F.col("scheme_hosts")).alias("scheme_hosts")
    )
    classes = stats.label_counts(faq, labels, large)
    filtered = stats.filtered_counts(faq, labels, flags, large=large).withColumn(
        "_overall", F.when(lang.isNull(), 1).otherwise(0)
    )
    pair = F.array("filtered", "kept")
    kept = filtered.agg(*[
        column for limit in C.REPORTED_SIMILARITIES
        for column in both("qa_pairs_filtered/unfiltered", pair,
                           F.col("similarity") == F.lit(limit), f" ({limit})")
    ])
    # Names of the report's fields.
    lists = stats.language_lists(faq, large).withColumnsRenamed({
        "large_languages": "languages_ge_100_scheme_hosts",
        "small_languages": "languages_l_100_scheme_hosts",
        "num_large_languages": "num_languages_ge_100_scheme_hosts",
        "num_small_languages": "num_languages_l_100_scheme_hosts",
    })
    return _beside([
        lists, counted, hosts,
        _classes(classes, "topic"), _classes(classes, "question_type"), kept,
    ])


def write_statistics(report: DataFrame, hosts: DataFrame, path: str) -> None:
    """The report as one JSON object; the host map as JSON lines, since it grows
    with the corpus."""
    report.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/statistics")
    hosts.write.mode("overwrite").json(f"{path}/scheme_hosts_languages")
