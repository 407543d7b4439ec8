"""Filters, cleaning, language and identity of question-answer rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaweave import constants as C
from qaweave.functions import grams
from qaweave.functions import text as X


def qa_filters(df: DataFrame) -> DataFrame:
    """Length, newline and question-mark rules, on the text before cleaning."""
    newlines = F.length("answer") - F.length(F.replace(F.col("answer"), F.lit("\n"), F.lit("")))
    return df.filter(
        (F.length("question") >= C.MIN_QUESTION_LENGTH)
        & (F.length("answer") >= C.MIN_ANSWER_LENGTH)
        & ~F.col("answer").contains("?")
        & (newlines < C.MAX_ANSWER_NEWLINES)
    )


def add_scheme_host(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("scheme_host", X.scheme_host(F.col(url))).filter("scheme_host is not null")


def clean_pairs(df: DataFrame) -> DataFrame:
    """Prefixes, then quotes, then emoji; step by step, as each rule looks at the
    result of the one before more than once."""
    q, a = F.col("question"), F.col("answer")
    return (
        df.withColumns({
            "question": X.strip_question_prefixes(q), "answer": X.strip_answer_prefixes(a),
        })
        .withColumns({"question": X.strip_quotes(q), "answer": X.strip_quotes(a)})
        .withColumns({"question": X.strip_emoji(q), "answer": X.strip_emoji(a)})
    )


def add_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", X.qa_id(F.col("question"), F.col("answer")))


@dataclass(frozen=True)
class LanguageModel:
    """Log weights per language and three-gram bucket; its size is the number of
    languages times the number of buckets, whatever it was trained on."""

    names: list[str]
    weights: np.ndarray
    prior: np.ndarray


def train_language_model(df: DataFrame, text: str, language: str, buckets: int = 1 << 13,
                         smoothing: float = 1.0) -> LanguageModel:
    """Three-gram counts per language: summed per task, then over tasks; only the
    counts, of fixed size, come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[str, int] = {}
        total = np.zeros((0, buckets), np.int64)
        for batch in batches:
            known = np.array([codes.setdefault(name, len(codes)) for name in batch["language"]], np.int64)
            if len(codes) > len(total):
                total = np.concatenate((total, np.zeros((len(codes) - len(total), buckets), np.int64)))
            for start, group in grams.groups(batch["text"].tolist()):
                of, slot = grams.slots(group, buckets)
                total += np.bincount(known[start + of] * buckets + slot, minlength=total.size).reshape(-1, buckets)
        for name, row in zip(codes, total):
            there = np.flatnonzero(row)
            yield pd.DataFrame({"language": name, "slot": there, "n": row[there]})

    rows = df.select(F.col(language).alias("language"), F.col(text).alias("text")).dropna()
    table = (
        rows.mapInPandas(count, "language string, slot long, n long")
        .groupBy("language", "slot").agg(F.sum("n").alias("n")).toPandas()
    )
    names = sorted(table["language"].unique())
    total = np.full((len(names), buckets), smoothing)
    place = table["language"].map({n: i for i, n in enumerate(names)}).to_numpy()
    total[place, table["slot"].to_numpy()] += table["n"].to_numpy()
    mass = total.sum(axis=1, keepdims=True)
    return LanguageModel(names, np.log(total / mass), np.log(mass[:, 0] / mass.sum()))


def model_detector(model: LanguageModel):
    """A detector: adds `label` and `confidence` for a text column.

    Any function of this form, for example around an outside model in a pandas
    UDF, can take its place."""
    by_slot = np.ascontiguousarray(model.weights.T)

    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            score = grams.sums([t or "" for t in texts], by_slot) + model.prior
            share = np.exp(score - score.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            yield pd.DataFrame({
                "label": [model.names[i] for i in best],
                "confidence": share[np.arange(len(best)), best],
            })

    guess_udf = F.pandas_udf(guess, "label string, confidence double")

    def detect(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("_guess", guess_udf(F.col(column))).select(*df.columns, "_guess.*")

    return detect


def detect_language(df: DataFrame, detector, limit: float = C.LANGUAGE_CONFIDENCE) -> DataFrame:
    """Language and confidence of question and answer; rows below the limit or
    with an unknown code are dropped."""
    with_text = df.withColumn("_text", X.match_text(F.col("question"), F.col("answer")))
    return (
        detector(with_text, "_text")
        .filter(F.col("confidence") >= limit)
        .withColumn("language", X.map_iso_code(F.col("label")))
        .filter("language is not null")
        .drop("_text", "label")
    )
