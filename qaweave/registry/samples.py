"""Sampling, annotation and the label classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaweave import constants as C
from qaweave.functions.text import parse_label
from qaweave.operators import labels as B
from qaweave.operators import sampling as S
from qaweave.registry import adapters as A
from qaweave.registry import query
from qaweave.registry.adapters import sql
from qaweave.registry.retrieval import _SET, _corpus, _qrels, _queries

_DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"

# ---------------------------------------------------------------- samples


def _lines(spark, sf):
    """Judgements at size: one row per order, its status as language."""
    return A.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("language"), F.col("o_orderkey").alias("pos"),
        F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("doc_id"))


_LINES = """
lines AS (
  SELECT o_orderstatus AS language, o_orderkey AS pos, o_custkey AS query_id, o_orderpriority AS doc_id FROM orders),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY language ORDER BY pos) - 1 AS i,
    count(*) OVER (PARTITION BY language) AS n FROM lines)
"""
_LIMITS = {"F": 500, "O": 4000, "P": 10_000_000}


@query("circular_sample", "WITH " + _LINES.strip() + f""",
turned AS (
  SELECT *, ((i - {_DRAW.format("'42|' || language")} % n) + n) % n AS sample_pos,
    CASE language WHEN 'F' THEN 500 WHEN 'O' THEN 4000 WHEN 'P' THEN 10000000 END AS lim FROM placed)
SELECT language, pos, query_id, doc_id, sample_pos FROM turned WHERE sample_pos < lim""")
def _(spark, sf):
    return S.circular_sample(_lines(spark, sf), _LIMITS)


@query("training_pairs", sql("""
SELECT r.language, r.query_id, r.doc_id, r.score, q.text AS query, c.text AS positive FROM qrels r
JOIN queries q ON q.language = r.language AND q.query_id = r.query_id
JOIN corpus c ON c.language = r.language AND c.doc_id = r.doc_id""", _SET))
def _(spark, sf):
    return S.training_pairs(_qrels(spark, sf).drop("pos"), _queries(spark, sf), _corpus(spark, sf))


@query("monolingual_batches", "WITH " + _LINES.strip() + f"""
SELECT language, pos, query_id, doc_id, i // 128 AS batch,
  {_DRAW.format("'42|' || language || '|' || (i // 128)")} AS batch_draw,
  {_DRAW.format("'43|' || language || '|' || pos")} AS row_draw
FROM placed WHERE i // 128 < n // 128""")
def _(spark, sf):
    return S.in_batch_order(S.monolingual_batches(_lines(spark, sf)))


_SAMPLE = """
firsts AS (
  SELECT * FROM (
    SELECT *, lag(scheme_host) OVER (PARTITION BY language ORDER BY pos) AS before FROM faq)
  WHERE before IS DISTINCT FROM scheme_host),
sampled AS (
  SELECT *, row_number() OVER (PARTITION BY language ORDER BY pos) AS sample_rank,
    count(*) OVER (PARTITION BY language) AS n FROM firsts),
sample AS (SELECT language, pos, id, question, answer, sample_rank FROM sampled WHERE sample_rank <= 400 AND n >= 110)
"""


def _sample(spark, sf):
    return S.annotation_sample(A.faq(spark, sf), 400, 110).select(
        "language", "pos", "id", "question", "answer", "sample_rank")


@query("annotation_sample", sql("SELECT language, pos, id, sample_rank FROM sample", _SAMPLE))
def _(spark, sf):
    return _sample(spark, sf).select("language", "pos", "id", "sample_rank")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_sql(template):
    parts = template.replace("{answer}", "{question}").split("{question}")
    fields = ["question", "answer"][: len(parts) - 1]
    out = [_quoted(parts[0])]
    for field, part in zip(fields, parts[1:]):
        out += [field, _quoted(part)]
    return " || ".join(out)


@query("annotation_prompt", sql(f"""
SELECT pos, 'topic' AS kind, {_prompt_sql(C.TOPIC_PROMPT)} AS prompt FROM faq
UNION ALL SELECT pos, 'question_type', {_prompt_sql(C.QUESTION_TYPE_PROMPT)} FROM faq"""))
def _(spark, sf):
    rows = A.faq(spark, sf)
    topic, question = [
        B.annotation_prompt(rows, kind).select("pos", F.lit(kind).alias("kind"), "prompt")
        for kind in ("topic", "question_type")
    ]
    return topic.unionAll(question)


def _replies(spark, sf):
    """Replies in all forms, numbers 0 to 11."""
    n = (F.col("pos") % 12).cast("string")
    turn = F.col("pos") % 7
    forms = [n, F.concat(F.lit("Label: "), n), F.concat(F.lit("label: "), n), F.concat(n, F.lit(")")),
             F.concat(n, F.lit(") "), "question"), F.concat(F.lit(" "), n, F.lit(" ")), F.col("question")]
    return A.faq(spark, sf).select(
        "language", "pos", F.coalesce(*[F.when(turn == i, f) for i, f in enumerate(forms)]).alias("reply"))


def _labels_sql(classes):
    number = "[1-8]" if classes == 8 else "10|[1-9]"
    return f"""
reply_rows AS (
  SELECT language, pos, trim(CASE pos % 7 WHEN 0 THEN n WHEN 1 THEN 'Label: ' || n WHEN 2 THEN 'label: ' || n
    WHEN 3 THEN n || ')' WHEN 4 THEN n || ') ' || question WHEN 5 THEN ' ' || n || ' ' ELSE question END) AS reply
  FROM (SELECT *, (pos % 12)::VARCHAR AS n FROM faq)),
reply_labels AS (
  SELECT language, pos, coalesce(
    nullif(regexp_extract(reply, '^(?:[Ll]abel: )?({number})$', 1), ''),
    nullif(regexp_extract(reply, '^({number})\\)$', 1), ''),
    nullif(regexp_extract(reply, '(?s)^({number})\\)\\s+.*', 1), ''))::INT AS label FROM reply_rows)
"""


def _parsed(spark, sf, classes):
    return _replies(spark, sf).select(
        "language", "pos", parse_label(F.col("reply"), classes).alias("label"))


@query("parse_topic_label", sql("SELECT * FROM reply_labels", _labels_sql(8)))
def _(spark, sf):
    return _parsed(spark, sf, 8)


@query("parse_question_type_label", sql("SELECT * FROM reply_labels", _labels_sql(10)))
def _(spark, sf):
    return _parsed(spark, sf, 10)


_ANNOTATED = """
annotated AS (
  SELECT s.*, l.label FROM sample s JOIN reply_labels l USING (language, pos) WHERE l.label IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY s.language ORDER BY s.pos) <= 300),
split_rows AS (
  SELECT *, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM (
    SELECT *, """ + _DRAW.format("'42|' || id") + """ / 4294967296.0::DOUBLE AS u FROM annotated))
"""
_LABELLED = (_SAMPLE, _labels_sql(8), _ANNOTATED)


def _annotated(spark, sf):
    return B.annotations(_sample(spark, sf), _replies(spark, sf), "topic", 300)


def _split(spark, sf):
    return S.split_dataset(_annotated(spark, sf), ["id"])


@query("annotations", sql("SELECT language, pos, question, answer, label FROM annotated", *_LABELLED))
def _(spark, sf):
    return _annotated(spark, sf).select("language", "pos", "question", "answer", "label")


@query("split_dataset", sql("SELECT language, pos, label, split FROM split_rows", *_LABELLED))
def _(spark, sf):
    return _split(spark, sf).select("language", "pos", "label", "split")


@query("value_counts", sql("""
SELECT 'label' AS kind, label::VARCHAR AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM annotated GROUP BY label
UNION ALL SELECT 'language', language, count(*), round(count(*) / sum(count(*)) OVER (), 6) FROM annotated GROUP BY language""", *_LABELLED))
def _(spark, sf):
    rows = _annotated(spark, sf)

    def counted(column):
        return B.value_counts(rows, column).select(
            F.lit(column).alias("kind"), F.col(column).cast("string").alias("value"), "n",
            F.round("share", 6).alias("share"))

    return counted("label").unionAll(counted("language"))


@query("class_weights", sql("""
SELECT label, round(1 - count(*) / sum(count(*)) OVER (), 6) AS weight FROM split_rows WHERE split = 'train' GROUP BY label""", *_LABELLED))
def _(spark, sf):
    weights = B.class_weights(_split(spark, sf).filter("split = 'train'"))
    return weights.withColumn("weight", F.round("weight", 6))


@query("label_text", sql("""
SELECT pos, question || ' ### ' || answer AS text, label - 1 AS labels FROM annotated""", *_LABELLED))
def _(spark, sf):
    return B.label_text(_annotated(spark, sf), True).select("pos", "text", "labels")


def _language_rows(spark, sf):
    """Documents with their language as label: a task the classifier can learn."""
    names = F.array(*[F.lit(x) for x in ("deu", "eng", "fra", "spa")])
    return B.label_text(
        A.faq(spark, sf).withColumn("label", F.array_position(names, F.col("language")).cast("int")), True)


def _predicted(spark, sf):
    rows = S.split_dataset(_language_rows(spark, sf), ["id"])
    train = rows.filter("split = 'train'")
    weights = B.class_weights(train, "labels")
    return B.predict_labels(rows, B.train_label_classifier(train, weights, 1 << 10, 10), "topic")


@query("train_label_classifier", None)
def _(spark, sf):
    return B.weighted_f1(_predicted(spark, sf).filter("split <> 'train'")).withColumn(
        "weighted_f1", F.round("weighted_f1", 4))


@query("predict_labels", None)
def _(spark, sf):
    return _predicted(spark, sf).select("language", "id", "topic")


@query("weighted_f1", """
WITH cells AS (SELECT l_linenumber AS truth, (l_partkey % 7 + 1) AS guess, count(*) AS n FROM lineitem GROUP BY ALL),
classes AS (SELECT cls, sum(s) AS support, sum(g) AS guessed, sum(r) AS good FROM (
  SELECT truth AS cls, n AS s, 0 AS g, CASE WHEN truth = guess THEN n ELSE 0 END AS r FROM cells
  UNION ALL SELECT guess, 0, n, 0 FROM cells) GROUP BY cls)
SELECT round(sum(2 * good / (support + guessed) * support) / sum(support), 6) AS weighted_f1 FROM classes""")
def _(spark, sf):
    rows = A.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("labels"), (F.col("l_partkey") % 7 + 1).alias("prediction"))
    return B.weighted_f1(rows).withColumn("weighted_f1", F.round("weighted_f1", 6))
