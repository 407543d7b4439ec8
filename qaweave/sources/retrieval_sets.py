"""Retrieval sets: queries, corpus and judgements in their four layouts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaweave import schemas


@dataclass(frozen=True)
class Layout:
    """Names of the id, text and judgement columns of a layout, and its split."""

    query_id: str
    query_text: str
    doc_id: str
    judged_query: str
    judged_doc: str
    split: str
    judged_only: bool = False
    last_judgement: bool = False


_UNDERSCORE = dict(query_id="_id", query_text="text", doc_id="_id",
                   judged_query="query-id", judged_doc="corpus-id")
_NAMED = dict(query_id="query_id", query_text="query", doc_id="docid",
              judged_query="query_id", judged_doc="docid")

# "own" keeps one judgement per query and only judged queries. "pooled" sets use
# the first form for most languages and the second for the others.
LAYOUTS = {
    "own": Layout(**_UNDERSCORE, split="test", judged_only=True, last_judgement=True),
    "passages": Layout(**_UNDERSCORE, split="test"),
    "named": Layout(**_NAMED, split="dev"),
    "pooled": Layout(**_UNDERSCORE, split="dev"),
}

# Languages of the pooled set with the first form.
POOLED_LANGUAGES = ("tha", "eng", "deu", "fra", "spa", "rus", "jpn", "fas", "ara", "fin",
                    "kor", "ind", "tel", "hin", "zho")


def layout_of(task: str, language: str) -> Layout:
    if task == "pooled" and language not in POOLED_LANGUAGES:
        return LAYOUTS["named"]
    return LAYOUTS[task]


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def qrels_last_wins(qrels: DataFrame, pos: str = "pos") -> DataFrame:
    """One judgement per query: the last row."""
    last = F.max_by(F.struct("doc_id", "score"), pos).alias("_last")
    return qrels.groupBy("query_id").agg(last).select("query_id", "_last.*")


def map_retrieval_set(queries: DataFrame, corpus: DataFrame, qrels: DataFrame,
                      layout: Layout) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The common three tables; ids are always text. A layout that keeps the last
    judgement needs a `pos` column in `qrels`."""
    q = queries.select(_text(layout.query_id).alias("query_id"),
                       F.col(layout.query_text).alias("text"))
    c = corpus.select(_text(layout.doc_id).alias("doc_id"), "title", "text")
    judged = [_text(layout.judged_query).alias("query_id"),
              _text(layout.judged_doc).alias("doc_id"), F.col("score").cast("int").alias("score")]
    if layout.last_judgement:
        r = qrels_last_wins(qrels.select(*judged, "pos"))
    else:
        r = qrels.select(*judged)
    if layout.judged_only:
        q = q.join(r.select("query_id"), "query_id", "left_semi")
    return q, c, r


def load_retrieval_set(spark: SparkSession, path: str, task: str, language: str,
                       corpus_split: str = "corpus", query_split: str = "queries"):
    """Local copy of a set: JSON lines under `{language}-corpus/`,
    `{language}-queries/` and `{language}-qrels/`, one file per split."""
    layout = layout_of(task, language)
    id_columns = {"own": "`_id` string", "named": "docid string"}
    doc = id_columns["named" if layout.doc_id == "docid" else "own"]
    query_schema = f"`{layout.query_id}` string, {layout.query_text} string"
    judged = f"`{layout.judged_query}` string, `{layout.judged_doc}` string, score int"
    corpus = spark.read.schema(f"{doc}, title string, text string").json(
        f"{path}/{language}-corpus/{corpus_split}.jsonl")
    queries = spark.read.schema(query_schema).json(
        f"{path}/{language}-queries/{query_split}.jsonl")
    qrels = spark.read.schema(judged).json(f"{path}/{language}-qrels/{layout.split}.jsonl")
    # File order decides the last judgement: file, split of the file, row of the split.
    place = F.struct(
        F.col("_metadata.file_name"), F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id().alias("row"),
    )
    qrels = qrels.withColumn("pos", place)
    return map_retrieval_set(queries, corpus, qrels, layout)


#: What stands for a character that would end a line or begin an escape.
_ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"))


def _on_one_line(name: str) -> Column:
    """Text with its line breaks written out, so that a row is a line."""
    col = F.col(name).cast("string")
    for character, written in _ESCAPES:
        col = F.replace(col, F.lit(character), F.lit(written))
    return col.alias(name)


def _as_it_was(name: str) -> Column:
    """Undoes `_on_one_line`: between written-out backslashes there are only line breaks."""
    parts = F.split(F.col(f"`{name}`"), r"\\\\", -1)
    breaks = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(breaks, "\\").alias(name)


def write_retrieval_set(queries: DataFrame, corpus: DataFrame, qrels: DataFrame,
                        path: str) -> None:
    """Queries as TSV without header, corpus as JSON lines without title,
    judgements as TSV with header. Line breaks are written out as two characters in
    the TSV files, so that a file can be read by many tasks."""
    def tsv(df, header):
        return df.write.mode("overwrite").option("sep", "\t").option("header", header).option(
            "escape", '"'
        )

    tsv(queries.select(_on_one_line("query_id"), _on_one_line("text")), False).csv(f"{path}/queries")
    corpus.select(F.col("doc_id").alias("id"), F.col("text").alias("contents")).write.mode(
        "overwrite"
    ).json(f"{path}/corpus")
    renamed = qrels.select(_on_one_line("query_id").alias("query-id"),
                           _on_one_line("doc_id").alias("corpus-id"), "score")
    tsv(renamed, True).csv(f"{path}/qrels")


def read_retrieval_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries and judgements back from TSV, ids as text. A row is a line: files are split."""
    def tsv(schema, header, name):
        return (
            spark.read.schema(schema).option("sep", "\t").option("header", header)
            .option("escape", '"').csv(f"{path}/{name}")
        )

    queries = tsv(schemas.QUERIES, False, "queries").select(_as_it_was("query_id"), _as_it_was("text"))
    qrels = tsv("`query-id` string, `corpus-id` string, score int", True, "qrels").select(
        _as_it_was("query-id").alias("query_id"), _as_it_was("corpus-id").alias("doc_id"), "score"
    )
    return queries, qrels
