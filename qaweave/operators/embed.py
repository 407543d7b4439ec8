"""Batch vectors with a pluggable encoder.

An encoder factory is called once per task and returns a function from a list of
texts to a matrix. The default needs no model: hashed character three-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from qaweave import constants as C
from qaweave.functions.grams import signed_counts

#: Rows and bytes of text that are encoded at a time.
SLICE_ROWS, SLICE_BYTES = 1024, 1 << 20


def hashed_grams(dims: int = 256):
    """Factory of the default encoder: signed counts of character three-grams."""

    def load():
        def encode(texts: list[str]) -> np.ndarray:
            out = signed_counts([t or "" for t in texts], dims)
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return encode

    return load


def _slices(batch: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, at most SLICE_ROWS and about SLICE_BYTES of text (or one row) at a time."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def _encoded(df: DataFrame, keys: list[str], dims: int | None = None, **texts) -> DataFrame:
    """The `keys` of `df` and a vector, cut to `dims`, for each of `texts` (name: encoder
    factory and column). Only a slice of the texts is in Python at a time, whatever Spark
    hands over at once, and vectors leave as Arrow lists."""
    rows = df.select(*keys, *[column.alias(name) for name, (_, column) in texts.items()])
    factories = {name: factory for name, (factory, _) in texts.items()}
    schema = StructType([rows.schema[k] for k in keys] + [StructField(name, ArrayType(FloatType())) for name in texts])

    def vectors(encode, column) -> pa.ListArray:
        m = np.asarray(encode(column.to_pylist()), np.float32)[:, :dims]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {name: factory() for name, factory in factories.items()}
        for batch in batches:
            for part in _slices(batch, list(encoders)):
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in keys], *[vectors(encode, part.column(name)) for name, encode in encoders.items()]], [*keys, *encoders])

    return rows.mapInArrow(run, schema)


def embed_text(df: DataFrame, factory=None) -> DataFrame:
    """One vector per row of question and answer together."""
    text = F.trim(F.concat_ws(" ", "question", "answer"))
    return _encoded(df, ["language", "id"], embedding=(factory or hashed_grams(), text))


def embed_qa(df: DataFrame, query_factory=None, passage_factory=None,
             dims: int = C.RETRIEVAL_DIMS) -> DataFrame:
    """A query vector of the question and a passage vector of the answer, cut to
    the leading dimensions."""
    return _encoded(df, ["language", "id"], dims, question_embedding=(query_factory or hashed_grams(), F.col("question")),
                    answer_embedding=(passage_factory or hashed_grams(), F.trim(F.col("answer"))))


def embed_missing(df: DataFrame, existing: DataFrame, embed=embed_text) -> DataFrame:
    """Vectors for the rows that have none yet, to be appended."""
    done = existing.select("language", "id")
    return embed(df.join(done, ["language", "id"], "left_anti"))


def passage_text(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "passage", F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("text")))
    )


def query_text(df: DataFrame, instruction: str = C.QUERY_INSTRUCTION) -> DataFrame:
    return df.withColumn(
        "query", F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), F.col("text"))
    )


def encoded_set(queries: DataFrame, corpus: DataFrame, factory=None) -> tuple[DataFrame, DataFrame]:
    """Query and passage vectors of a retrieval set."""
    encode = factory or hashed_grams()
    return (
        _encoded(query_text(queries), ["language", "query_id"], embedding=(encode, F.col("query"))),
        _encoded(passage_text(corpus), ["language", "doc_id"], embedding=(encode, F.col("passage"))),
    )
