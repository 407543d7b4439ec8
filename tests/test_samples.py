"""Samples, labels and vectors."""

import numpy as np
from pyspark.sql import functions as F

from qaweave.operators import embed, labels, parallel, sampling


def ordered_rows(spark, n, language="e"):
    return spark.createDataFrame([(language, i, f"q{i}", f"d{i}") for i in range(n)],
                                 "language string, pos long, query_id string, doc_id string")


def test_circular_sample(spark):
    df = ordered_rows(spark, 5).unionByName(ordered_rows(spark, 4, "none"))
    for seed in range(6):
        got = [r.pos for r in sampling.circular_sample(df, {"e": 4}, seed, rows=2).orderBy("sample_pos").collect()]
        assert len(got) == 4 and all((b - a) % 5 == 1 for a, b in zip(got, got[1:]))
    assert sampling.circular_sample(df, {"e": 99}).count() == 5


def test_batches(spark):
    out = sampling.monolingual_batches(ordered_rows(spark, 5).unionByName(ordered_rows(spark, 1, "f")), 2, rows=2)
    assert {(r.pos, r.batch) for r in out.collect()} == {(0, 0), (1, 0), (2, 1), (3, 1)}
    order = [r.batch for r in sampling.in_batch_order(out).collect()]
    assert order in ([0, 0, 1, 1], [1, 1, 0, 0])


def test_annotation_sample_and_labels(spark):
    data = [("e", i, f"h{i // 2}", f"q{i}", "a") for i in range(40)] + [("f", 0, "h", "q", "a")]
    faq = spark.createDataFrame(data, "language string, pos long, scheme_host string, question string, answer string")
    sample = sampling.annotation_sample(faq, 15, 10, rows=4)
    assert sorted(r.pos for r in sample.collect()) == list(range(0, 30, 2))
    replies = sample.select("language", "pos", F.when(F.col("pos") % 4 == 0, "Label: 2").otherwise("?").alias("reply"))
    kept = labels.annotations(sample, replies, "topic", 5)
    assert sorted((r.pos, r.label) for r in kept.collect()) == [(0, 2), (4, 2), (8, 2), (12, 2), (16, 2)]


def test_prompts(spark):
    df = spark.createDataFrame([("Why?", "So.")], "question string, answer string")
    topic = labels.annotation_prompt(df, "topic").first().prompt
    assert topic.endswith("Q&A pair: Why? ### So.\nLabel: ")
    kind = labels.annotation_prompt(df, "question_type").first().prompt
    assert kind.endswith("Question: Why?\nLabel: ")
    pair = spark.createDataFrame([(["eng", "deu"], ["q1", "q2"], ["a1", "a2"])],
                                 "languages array<string>, questions array<string>, answers array<string>")
    assert parallel.scoring_prompt(pair).first().prompt.endswith(
        'eng source: "q1 a1"\ndeu translation: "q2 a2"\nScore: ')


def test_histogram_truncates(spark):
    df = spark.createDataFrame([(0.29,), (0.28,), (1.0000001,)], "similarity double")
    assert {(r.bucket, r.n) for r in parallel.similarity_histogram(df).collect()} == {(0.28, 2), (1.0, 1)}


def test_sweep_with_empty_buckets(spark):
    df = spark.createDataFrame([(0.95, 90), (0.95, 10), (0.85, 95), (0.99, -2)], "similarity double, score int")
    rows = {(r.score_limit, r.similarity_limit): r for r in parallel.precision_recall_sweep(df).collect()}
    assert len(rows) == 60
    assert rows[(80, 0.99)].precision is None and rows[(80, 0.95)].precision == 0.5
    assert rows[(80, 0.8)].recall == 1.0 and abs(rows[(90, 0.8)].share - 2 / 3) < 1e-9


def test_split_shares(spark):
    parts = {r.split: r["count"] for r in sampling.split_dataset(spark.range(4000).withColumnRenamed("id", "k"), ["k"])
             .groupBy("split").count().collect()}
    assert abs(parts["train"] - 3200) < 120 and abs(parts["test"] - 400) < 80


def test_weighted_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "labels int, prediction int")
    f1 = (2 * (2 / 3) + 1 * (1 / 2) + 0) / 4
    assert abs(labels.weighted_f1(df).first().weighted_f1 - f1) < 1e-9


def test_classifier(spark):
    data = [(f"apple pear {i}", 1) for i in range(12)] + [(f"bolt screw {i}", 2) for i in range(12)]
    df = labels.label_text(spark.createDataFrame(data, "question string, label int"))
    weights = labels.class_weights(df, "labels")
    model = labels.train_label_classifier(df, weights, 1 << 8, 5)
    out = labels.predict_labels(df, model, "topic")
    assert {(r.labels, r.topic) for r in out.collect()} == {
        (0, "Products and Commercial Services"), (1, "Traveling and Hospitality")}


def test_embeddings(spark):
    faq = spark.createDataFrame([("e", "1", "one two", "three"), ("e", "2", "", "")],
                                "language string, id string, question string, answer string")
    found = {r.id: r.embedding for r in embed.embed_text(faq).collect()}
    assert len(found["1"]) == 256 and abs(np.linalg.norm(found["1"]) - 1) < 1e-6
    both = embed.embed_qa(faq, dims=32).filter("id = '1'").first()
    assert len(both.question_embedding) == 32 and len(both.answer_embedding) == 32
    done = embed.embed_text(faq.filter("id = '1'"))
    assert [r.id for r in embed.embed_missing(faq, done).collect()] == ["2"]
    rows = spark.createDataFrame([("t", " x "), (None, "y")], "title string, text string")
    assert {r.passage for r in embed.passage_text(rows).collect()} == {"t  x", "y"}


def test_bitexts(spark):
    def pair(i, similarity, q2="b", a2="d", languages=("deu", "eng")):
        return ("h", similarity, list(languages), ["u1", "u2"], ["a", q2], ["c", a2], ["-", "-"], ["-", "-"], 1)

    from qaweave.schemas import SCORES

    data = [pair(0, 0.9), pair(1, 0.95), pair(2, 0.89), pair(3, 0.95, q2="a"), pair(4, 0.95, a2="c"),
            pair(5, 0.95, languages=("deu", "fra"))]
    out = parallel.to_bitexts(spark.createDataFrame(data, SCORES), min_rows=2)
    assert [(r.pair, r.labse_similarity) for r in out.orderBy("labse_similarity").collect()] == [
        ("deu_eng", 0.9), ("deu_eng", 0.95)]


def test_texts_are_encoded_a_slice_at_a_time(spark):
    def sizes():
        def encode(texts):
            return np.array([[len(texts), sum(len(t or "") for t in texts), 7.0]] * len(texts))

        return encode

    rows = [("e", str(i), "q" * 3000 if i % 2 else None, " a ") for i in range(3000)]
    df = spark.createDataFrame(rows, "language string, id string, question string, answer string").coalesce(1)
    out = embed.embed_qa(df, sizes, sizes, 2).collect()
    assert len(out) == 3000 and {len(r.question_embedding) for r in out} == {2}
    assert max(r.answer_embedding[0] for r in out) <= embed.SLICE_ROWS
    assert max(r.question_embedding[1] for r in out) <= embed.SLICE_BYTES
    assert {r.answer_embedding[1] / r.answer_embedding[0] for r in out} == {1.0}
