"""Commands over a dataset folder: `spark-submit -m qaweave` or `python -m qaweave`.

Folder layout: downloads/*.gz, entities/, parts/, faq/, embeddings/,
retrieval_embeddings/, labels/, flags/, hosts/, statistics/, candidates/,
replies/, scores/, bitexts/, fine_tune/, annotations/.
Tables are parquet; candidates, scores and bitexts are JSON lines.
"""

from __future__ import annotations

import argparse
import importlib
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaweave import schemas
from qaweave.operators import clean, dedup, embed, labels, metrics, neardup, parallel, runs, sampling, stats
from qaweave.operators.ranking import bm25_topk, dense_topk
from qaweave.plans.evaluate import RUN_DEPTH, evaluate_dense, evaluate_hybrid, evaluate_sparse
from qaweave.plans.extract import extract_faq
from qaweave.plans.mine import mine_pairs
from qaweave.plans.report import statistics_report, write_statistics
from qaweave.sources import lines as L
from qaweave.session import stored
from qaweave.sources.entity_store import checkpoint_entities, finished_files
from qaweave.sources.retrieval_sets import load_retrieval_set, write_retrieval_set


class Folder:
    """Named tables of one dataset."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def has(self, name: str) -> bool:
        try:
            self.read(name)
        except AnalysisException:
            return False
        return True

    def save(self, df: DataFrame, name: str, mode: str = "overwrite") -> None:
        df.write.mode(mode).partitionBy("language").parquet(self.path(name))

    def replace(self, df: DataFrame, name: str, *keys: str) -> None:
        """Puts rows in place of earlier ones with the same keys; others stay."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(self.path(name))


def extract(f: Folder, a) -> None:
    """Quad files with a prefix to parts; the language model is trained on a
    parquet table (text, language)."""
    entities = f.path("entities")
    files = stored(L.quad_files(f.spark, f.path("downloads"), a.prefix), "quad-files")
    new = files.join(finished_files(f.spark, entities), "file", "left_anti")
    store = checkpoint_entities(f.spark, L.read_quad_lines(f.spark, new), entities, files=new)
    known = f.spark.read.parquet(a.language_table)
    detector = clean.model_detector(clean.train_language_model(known, "text", "language"))
    rows = extract_faq(store.filter(F.col("file").startswith(a.prefix)), detector)
    L.write_by_language(rows, f.path("parts"), "parquet", files)


def merge(f: Folder, a) -> None:
    parts = f.read("parts").withColumn("part", F.col("file")).withColumn("row", F.col("pos"))
    earlier = None
    if a.extend:
        # A copy, as the corpus may extend itself: a failed write leaves it in the shared folder.
        earlier = stored(f.read(a.extend).withColumns({"part": F.lit("~"), "row": F.col("pos")}), "earlier")
    merged = dedup.in_merge_order(dedup.merge_parts(parts.drop("pos"), earlier))
    L.write_merged(merged.drop("late", "part", "row", "file", "pos"), f.path("faq"))


def _encoder(name: str | None):
    """An encoder factory named as module:function; without a name the built-in one."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


def _embed(f: Folder, name: str, make) -> None:
    """Vectors for the rows of the corpus that have none yet."""
    if f.has(name):
        f.save(embed.embed_missing(f.read("faq"), f.read(name), make), name, "append")
    else:
        f.save(make(f.read("faq")), name)


def embed_text(f: Folder, a) -> None:
    encoder = _encoder(a.encoder)
    _embed(f, "embeddings", lambda df: embed.embed_text(df, encoder))


def embed_qa(f: Folder, a) -> None:
    encoder = _encoder(a.encoder)
    _embed(f, "retrieval_embeddings", lambda df: embed.embed_qa(df, encoder, encoder))


def near_duplicates(f: Folder, a) -> None:
    f.save(neardup.make_flags(f.read("faq"), f.read("retrieval_embeddings")), "flags")


def offsets(f: Folder, a) -> None:
    f.save(runs.host_runs(f.read("faq")), "hosts")


def statistics(f: Folder, a) -> None:
    tables = f.read("faq"), f.read("labels"), f.read("flags")
    write_statistics(statistics_report(*tables), stats.multilingual_hosts(*tables), f.path("statistics"))


def candidates(f: Folder, a) -> None:
    faq, lab, flags = f.read("faq"), f.read("labels"), f.read("flags")
    hosts = stats.multilingual_hosts(faq, lab, flags)
    docs = parallel.candidate_docs(faq, hosts, flags, lab, f.read("embeddings"))
    mine_pairs(docs).write.mode("overwrite").json(f.path("candidates"))


def score(f: Folder, a) -> None:
    """Without replies: requests for the sampled pairs. With replies: scores."""
    keyed = L.read_many(f.spark, f.path("candidates"), schemas.CANDIDATES).withColumn(
        "key", F.md5(F.to_json(F.struct("scheme_host", "languages", "urls", "questions")).cast("binary")))
    if a.replies:
        replies = f.spark.read.schema("key string, reply string").json(a.replies)
        out = parallel.attach_scores(keyed, replies, ["key"]).drop("key")
        out.write.mode("overwrite").json(f.path("scores"))
    else:
        sampled = parallel.sample_for_scoring(keyed, ["key"]).filter("sampled")
        parallel.scoring_prompt(sampled).select("key", "prompt").write.mode("overwrite").json(
            f.path("score_requests"))


def assess(f: Folder, a) -> None:
    """Counts, histograms and the precision-recall sweep of the scores."""
    scores = L.read_many(f.spark, f.path("scores"), schemas.SCORES)
    for table in (parallel.pair_counts(scores), parallel.score_histogram(scores).orderBy("score"),
                  parallel.mean_score_by_similarity(scores).orderBy("bucket"),
                  parallel.precision_recall_sweep(scores).orderBy("score_limit", F.desc("similarity_limit"))):
        table.show(100, False)


def transform(f: Folder, a) -> None:
    scores = L.read_many(f.spark, f.path("scores"), schemas.SCORES)
    L.write_bitexts(parallel.to_bitexts(scores), f.path("bitexts"))


def _with_language(tables, language):
    return [t.withColumn("language", F.lit(language)) for t in tables]


def generate_jsonl(f: Folder, a) -> None:
    """A folder for each task and language."""
    tables = load_retrieval_set(f.spark, a.sets, a.task, a.language)
    write_retrieval_set(*tables, f.path(f"bm25/{a.task}/{a.language}"))


def evaluate(f: Folder, a) -> None:
    """Results of the languages named (joined by commas), in one job: BM25, and with an
    encoder the dense and the fused run. All runs are kept in result_runs/; results/ has the
    run of each entry that began last, so a run that ends late does not replace a newer one."""
    run = f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%S.%f} {uuid.uuid4().hex}"
    sets = [_with_language(load_retrieval_set(f.spark, a.sets, a.task, x), x) for x in a.language.split(",")]
    queries, corpus, qrels = (reduce(DataFrame.unionByName, tables) for tables in zip(*sets))
    out = evaluate_sparse(queries, corpus, qrels, a.task)
    if a.encoder:
        encoded = embed.encoded_set(queries, corpus, _encoder(a.encoder))
        sparse, dense = bm25_topk(queries, corpus, RUN_DEPTH), stored(dense_topk(*encoded, RUN_DEPTH), "dense-run")
        out = out.unionByName(evaluate_dense(*encoded, qrels, a.task, a.encoder, run=dense)).unionByName(
            evaluate_hybrid(sparse, dense, qrels, a.task))
    out.withColumn("run", F.lit(run)).write.mode("append").parquet(f.path("result_runs"))
    _newest(f, a.task, a.language.split(","))


def _newest(f: Folder, task: str, languages: list[str]) -> None:
    runs = f.read("result_runs").filter((F.col("task") == task) & F.col("language").isin(languages))
    f.replace(metrics.newest_results(runs).drop("run"), "results", "task", "language", "model")


def sample(f: Folder, a) -> None:
    q, c, r = _with_language(load_retrieval_set(f.spark, a.sets, a.task, a.language), a.language)
    placed = r.withColumn("pos", F.monotonically_increasing_id())
    path = f.path("training_qrels")
    placed.write.mode("overwrite").parquet(path)
    chosen = sampling.circular_sample(f.spark.read.parquet(path))
    pairs = sampling.training_pairs(chosen, q, c).select("language", "sample_pos", "query", "positive")
    f.replace(pairs.withColumn("task", F.lit(a.task)), "fine_tune", "task", "language")


def batches(f: Folder, a) -> None:
    rows = f.read("fine_tune").drop("task").withColumnRenamed("sample_pos", "pos")
    sampling.in_batch_order(sampling.monolingual_batches(rows)).write.mode("overwrite").parquet(
        f.path("batches"))


def annotate(f: Folder, a) -> None:
    """Without replies: requests for the sample. With replies: annotations."""
    chosen = sampling.annotation_sample(f.read("faq"))
    if a.replies:
        replies = f.spark.read.schema("language string, pos long, reply string").json(a.replies)
        f.save(labels.annotations(chosen, replies, a.kind), f"annotations/{a.kind}")
    else:
        labels.annotation_prompt(chosen, a.kind).select("language", "pos", "prompt").write.mode(
            "overwrite").json(f.path(f"annotation_requests/{a.kind}"))


def train_labels(f: Folder, a) -> None:
    """A classifier from annotations, and names for all rows of the corpus."""
    with_answer = a.kind == "topic"
    rows = sampling.split_dataset(
        labels.label_text(f.read(f"annotations/{a.kind}"), with_answer), ["language", "pos"])
    train = rows.filter("split = 'train'")
    model = labels.train_label_classifier(train, labels.class_weights(train, "labels"))
    model.write().overwrite().save(f.path(f"models/{a.kind}"))
    tested = labels.predict_labels(rows.filter("split = 'validation'"), model, a.kind)
    labels.weighted_f1(tested).show()
    texts = labels.label_text(f.read("faq").withColumn("label", F.lit(1)), with_answer)
    f.save(labels.predict_labels(texts, model, a.kind).select("language", "id", a.kind),
           f"labels_{a.kind}")
    if f.has("labels_topic") and f.has("labels_question_type"):
        f.save(f.read("labels_topic").join(f.read("labels_question_type"), ["language", "id"]), "labels")


COMMANDS = {
    "extract": (extract, ["prefix", "language_table"]), "merge": (merge, ["--extend"]),
    "embed-text": (embed_text, ["--encoder"]), "embed-qa": (embed_qa, ["--encoder"]),
    "near-duplicates": (near_duplicates, []), "offsets": (offsets, []),
    "statistics": (statistics, []), "candidates": (candidates, []),
    "score": (score, ["--replies"]), "assess": (assess, []), "transform": (transform, []),
    "generate-jsonl": (generate_jsonl, ["sets", "task", "language"]),
    "evaluate": (evaluate, ["sets", "task", "language", "--encoder"]),
    "sample": (sample, ["sets", "task", "language"]), "batches": (batches, []),
    "annotate": (annotate, ["kind", "--replies"]), "train-labels": (train_labels, ["kind"]),
}


def main(argv=None) -> None:
    parser = argparse.ArgumentParser(prog="qaweave", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (run, arguments) in COMMANDS.items():
        command = sub.add_parser(name, help=run.__doc__)
        command.add_argument("folder")
        for argument in arguments:
            command.add_argument(argument)
        command.set_defaults(run=run)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"qaweave {args.command}").getOrCreate()
    args.run(Folder(spark, args.folder), args)


if __name__ == "__main__":
    main()
