"""Annotation requests, label replies and the label classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaweave import constants as C
from qaweave.functions.text import parse_label, render

NAMES = {"topic": C.TOPICS, "question_type": C.QUESTION_TYPES}


def annotation_prompt(df: DataFrame, kind: str) -> DataFrame:
    if kind == "topic":
        text = render(C.TOPIC_PROMPT, question=F.col("question"), answer=F.col("answer"))
    else:
        text = render(C.QUESTION_TYPE_PROMPT, question=F.col("question"))
    return df.withColumn("prompt", text)


def annotations(sample: DataFrame, replies: DataFrame, kind: str,
                limit: int = C.ANNOTATION_LIMIT) -> DataFrame:
    """The first `limit` rows per language whose reply is a class number. The
    sample is bounded per language, so are the windows."""
    parsed = replies.select(
        "language", "pos", parse_label(F.col("reply"), len(NAMES[kind])).alias("label")
    ).filter("label is not null")
    order = Window.partitionBy("language").orderBy("pos")
    return (
        sample.join(parsed, ["language", "pos"])
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= limit)
        .drop("_rn")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per value; the window runs over one row per value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(everything)).orderBy(column)


def class_weights(df: DataFrame, column: str = "label") -> DataFrame:
    return value_counts(df, column).select(column, (1 - F.col("share")).alias("weight"))


def label_text(df: DataFrame, with_answer: bool = False) -> DataFrame:
    """Classifier text and zero-based label."""
    text = F.concat_ws(" ### ", "question", "answer") if with_answer else F.col("question")
    return df.withColumns({"text": text, "labels": F.col("label") - 1})


def train_label_classifier(df: DataFrame, weights: DataFrame | None = None,
                           buckets: int = 1 << 14, max_iter: int = 20) -> PipelineModel:
    """Weighted multi-class classifier on `text` and `labels`.

    `weights` has one row per class (ten at most)."""
    if weights is None:
        weighted = df.withColumn("weight", F.lit(1.0))
    else:
        weighted = df.join(F.broadcast(weights), "labels")
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=buckets),
            IDF(inputCol="_counts", outputCol="_features"),
            LogisticRegression(
                featuresCol="_features", labelCol="labels", weightCol="weight",
                predictionCol="prediction", maxIter=max_iter, regParam=0.01,
                family="multinomial",
            ),
        ]
    ).fit(weighted.select("text", F.col("labels").cast("double").alias("labels"), "weight"))


def predict_labels(df: DataFrame, model: PipelineModel, kind: str) -> DataFrame:
    """Class names for every row of `text`."""
    names = F.array(*[F.lit(n) for n in NAMES[kind]])
    return (
        model.transform(df)
        .withColumn(kind, F.try_element_at(names, F.col("prediction").cast("int") + 1))
        .drop("_words", "_counts", "_features", "rawPrediction", "probability")
    )


def weighted_f1(predicted: DataFrame, label: str = "labels",
                prediction: str = "prediction") -> DataFrame:
    """F1 averaged by class share, from the confusion counts."""
    cells = predicted.groupBy(
        F.col(label).cast("int").alias("truth"), F.col(prediction).cast("int").alias("guess")
    ).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        F.inline(F.array(
            F.struct(F.col("truth").alias("cls"), F.col("n").alias("support"),
                     F.lit(0).cast("long").alias("guessed"),
                     F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("right")),
            F.struct(F.col("guess").alias("cls"), F.lit(0).cast("long").alias("support"),
                     F.col("n").alias("guessed"), F.lit(0).cast("long").alias("right")),
        ))
    )
    per_class = sides.groupBy("cls").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"),
        F.sum("right").alias("right"),
    )
    f1 = 2 * F.col("right") / (F.col("support") + F.col("guessed"))
    return per_class.agg(
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1")
    )
