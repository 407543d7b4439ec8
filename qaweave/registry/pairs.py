"""Parallel corpus mining and assessment."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaweave.functions.text import SCORE_PATTERNS, parse_score
from qaweave.operators import parallel as P
from qaweave.operators import stats
from qaweave.plans.mine import mine_pairs
from qaweave.registry import adapters as A
from qaweave.registry import query
from qaweave.registry.adapters import LARGE, LARGE_SQL, sql
from qaweave.sources.lines import write_bitexts

LIMIT = 0.3  # same-label vectors of the test table are not close


def _docs(spark, sf):
    """Rows with vectors; the group number of the vector is the host."""
    return A.faq(spark, sf).drop("scheme_host").join(
        A.vectors(spark, sf).select("language", "id", F.col("vec_group").alias("scheme_host"), "embedding"),
        ["language", "id"],
    ).join(A.labels(spark, sf), ["language", "id"], "left").withColumns(
        {c: F.coalesce(c, F.lit("-")) for c in ("topic", "question_type")})


_MUTUAL = f"""
sims AS (
  SELECT a.vec_group AS scheme_host, a.language AS l1, b.language AS l2, a.pos AS pos1, b.pos AS pos2,
    round(list_dot_product(a.embedding, b.embedding)
      / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))), 12) AS s
  FROM vec a JOIN vec b ON a.vec_group = b.vec_group AND a.language < b.language),
best AS (
  SELECT *, row_number() OVER (PARTITION BY scheme_host, l1, l2, pos1 ORDER BY s DESC, pos2) AS r,
    max(s) OVER (PARTITION BY scheme_host, l1, l2, pos2) AS c FROM sims),
mutual AS (SELECT scheme_host, l1, l2, pos1, pos2, s AS similarity FROM best WHERE r = 1 AND s >= {LIMIT} AND s >= c)
"""

# Score table: every row of faq with a partner twenty positions on, in another
# language, scored by arithmetic on the positions.
_SCORES = """
scores AS (
  SELECT a.scheme_host, a.language AS l1, b.language AS l2, a.question AS q1, b.question AS q2,
    a.answer AS a1, b.answer AS a2, a.pos AS pos1, b.pos AS pos2, a.url AS url1, b.url AS url2,
    0.8::DOUBLE + ((a.pos * 31 + b.pos * 17) % 211) / 1000.0::DOUBLE AS similarity,
    CASE WHEN a.pos % 5 = 0 THEN -2 WHEN a.pos % 7 = 0 THEN -1 ELSE (a.pos * 31 + b.pos * 17) % 101 END AS score
  FROM pairs a JOIN pairs b ON b.pos = a.pos + 20 WHERE a.language <> b.language)
"""


def _scores(spark, sf):
    a = A.pairs(spark, sf)
    b = a.select((F.col("pos") - 20).alias("pos"), *[
        F.col(c).alias(f"{c}2") for c in ("language", "url", "question", "answer")])
    mixed = F.col("pos") * 31 + (F.col("pos") + 20) * 17
    both = a.join(b, "pos").filter("language <> language2")
    return both.select(
        F.col("pos").alias("pos1"), (F.col("pos") + 20).alias("pos2"), "scheme_host",
        (F.lit(0.8) + (mixed % 211) / F.lit(1000.0)).alias("similarity"),
        F.array("language", "language2").alias("languages"),
        F.array("url", "url2").alias("urls"),
        F.array("question", "question2").alias("questions"),
        F.array("answer", "answer2").alias("answers"),
        F.array(F.lit("-"), F.lit("-")).alias("topics"),
        F.array(F.lit("-"), F.lit("-")).alias("question_types"),
        F.when(F.col("pos") % 5 == 0, F.lit(-2)).when(F.col("pos") % 7 == 0, F.lit(-1))
        .otherwise((mixed % 101).cast("int")).alias("score"),
    )


@query("candidate_docs", sql(f"""
SELECT f.scheme_host, f.language, f.id, f.pos, l.topic, l.question_type
FROM (
  SELECT f.* FROM faq f JOIN (
    SELECT scheme_host, language FROM (
      SELECT scheme_host, language, count(*) OVER (PARTITION BY scheme_host) AS n
      FROM faq JOIN label_rows USING (language, id) JOIN flag_rows g USING (language, id)
      WHERE language IN {LARGE_SQL} AND NOT g.filter GROUP BY scheme_host, language) WHERE n > 1) h
    USING (scheme_host, language)
  QUALIFY row_number() OVER (PARTITION BY f.scheme_host, f.language, f.question ORDER BY f.pos) = 1) f
JOIN flag_rows g USING (language, id) JOIN label_rows l USING (language, id) JOIN vec v USING (language, id)
WHERE NOT g.filter AND g.near_duplicate_similarity < 0.7"""))
def _(spark, sf):
    f, l, g = A.faq(spark, sf), A.labels(spark, sf), A.flags(spark, sf)
    hosts = stats.multilingual_hosts(f, l, g, large=LARGE)
    return P.candidate_docs(f, hosts, g, l, A.vectors(spark, sf), large=LARGE).select(
        "scheme_host", "language", "id", "pos", "topic", "question_type")


@query("mutual_best_pairs", sql("""
SELECT scheme_host, l1, l2, pos1, pos2, round(similarity, 6) AS similarity FROM mutual""", _MUTUAL))
def _(spark, sf):
    return P.mutual_best_pairs(_docs(spark, sf), LIMIT).withColumn(
        "similarity", F.round("similarity", 6))


@query("pair_record", sql("""
SELECT m.scheme_host, round(m.similarity, 6) AS similarity, m.l1 || ',' || m.l2 AS languages,
  a.url || ',' || b.url AS urls, a.question || '|' || b.question AS questions, a.answer || '|' || b.answer AS answers,
  coalesce(la.topic, '-') || ',' || coalesce(lb.topic, '-') AS topics,
  coalesce(la.question_type, '-') || ',' || coalesce(lb.question_type, '-') AS question_types
FROM mutual m JOIN faq a ON a.pos = m.pos1 JOIN faq b ON b.pos = m.pos2
LEFT JOIN label_rows la ON la.language = a.language AND la.id = a.id
LEFT JOIN label_rows lb ON lb.language = b.language AND lb.id = b.id""", _MUTUAL))
def _(spark, sf):
    separators = {"languages": ",", "urls": ",", "questions": "|", "answers": "|",
                  "topics": ",", "question_types": ","}
    return mine_pairs(_docs(spark, sf), LIMIT).select(
        "scheme_host", F.round("similarity", 6).alias("similarity"),
        *[F.array_join(c, s).alias(c) for c, s in separators.items()])


@query("similarity_histogram", sql("""
SELECT trunc(similarity * 100) / 100.0::DOUBLE AS bucket, count(*) AS n FROM scores GROUP BY 1""", _SCORES))
def _(spark, sf):
    return P.similarity_histogram(_scores(spark, sf))


_DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


@query("sample_for_scoring", sql(f"""
SELECT pos1, pos2, {_DRAW.format("'42|' || pos1 || '|' || pos2")} / 4294967296.0::DOUBLE < 0.25 AS sampled FROM scores""", _SCORES))
def _(spark, sf):
    return P.sample_for_scoring(_scores(spark, sf), ["pos1", "pos2"], 0.25).select(
        "pos1", "pos2", "sampled")


_PROMPT = """'Score the following translation from ' || l1 || ' to ' || l2 || ' on a
continuous scale from 0 to 100, where score of zero means "no meaning preserved" and
score of one hundred means "perfect meaning and grammar". Please provide a short,
concise answer.
' || l1 || ' source: "' || q1 || ' ' || a1 || '"
' || l2 || ' translation: "' || q2 || ' ' || a2 || '"
Score: '"""


@query("scoring_prompt", sql(f"SELECT pos1, pos2, {_PROMPT} AS prompt FROM scores", _SCORES))
def _(spark, sf):
    return P.scoring_prompt(_scores(spark, sf)).select("pos1", "pos2", "prompt")


def _reply_sql(number):
    return f"""CASE pos1 % 8 WHEN 0 THEN {number} || '' WHEN 1 THEN 'Score: ' || {number}
  WHEN 2 THEN 'Score: **' || {number} || '**' WHEN 3 THEN q1 || chr(10) || ' ' || {number} || ' '
  WHEN 4 THEN 'A solid ' || {number} || '/100 here' WHEN 5 THEN 'I would rate it ' || {number}
  WHEN 6 THEN 'It is **' || {number} || '** out of 100' ELSE a1 END"""


_NUMBER = "((pos1 * 7 + pos2) % 101)"
_REPLIES = f"replies AS (SELECT *, {_reply_sql(_NUMBER)} AS reply FROM scores)"
_FIRST = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(line, '(?s){p}', 1), '')" for p in SCORE_PATTERNS) + ")"
_PARSED = f"""
lines AS (
  SELECT pos1, pos2, unnest(string_split(reply, chr(10))) AS raw, generate_subscripts(string_split(reply, chr(10)), 1) AS n FROM replies),
numbers AS (SELECT pos1, pos2, n, {_FIRST} AS v FROM (SELECT *, trim(raw) AS line FROM lines)),
parsed AS (SELECT pos1, pos2, coalesce(arg_min(v, n) FILTER (v IS NOT NULL), '-1')::INT AS score FROM numbers GROUP BY pos1, pos2)
"""


def _replies(spark, sf):
    pos1 = F.col("pos1")
    n = ((pos1 * 7 + F.col("pos2")) % 101).cast("string")
    turn = pos1 % 8
    q, a = F.col("questions")[0], F.col("answers")[0]
    forms = [n, F.concat(F.lit("Score: "), n), F.concat(F.lit("Score: **"), n, F.lit("**")),
             F.concat(q, F.lit("\n "), n, F.lit(" ")), F.concat(F.lit("A solid "), n, F.lit("/100 here")),
             F.concat(F.lit("I would rate it "), n), F.concat(F.lit("It is **"), n, F.lit("** out of 100")), a]
    return _scores(spark, sf).withColumn(
        "reply", F.coalesce(*[F.when(turn == i, f) for i, f in enumerate(forms)]))


@query("parse_score", sql("SELECT * FROM parsed", _SCORES, _REPLIES, _PARSED))
def _(spark, sf):
    return _replies(spark, sf).select("pos1", "pos2", parse_score(F.col("reply")).alias("score"))


@query("attach_scores", sql("""
SELECT s.pos1, s.pos2, s.similarity, CASE WHEN s.score = -2 THEN -2 ELSE p.score END AS score
FROM scores s JOIN parsed p USING (pos1, pos2)""", _SCORES, _REPLIES, _PARSED))
def _(spark, sf):
    # Only sampled pairs were sent out, so only they have a reply.
    replies = _replies(spark, sf).filter("score <> -2").select("pos1", "pos2", "reply")
    return P.attach_scores(_scores(spark, sf).drop("score"), replies, ["pos1", "pos2"]).select(
        "pos1", "pos2", "similarity", "score")


@query("pair_counts", sql("""
SELECT least(l1, l2) || '_' || greatest(l1, l2) AS languages, count(*) AS n,
  count(*) FILTER (q1 = q2) AS same_questions, count(*) FILTER (a1 = a2) AS same_answers,
  count(*) FILTER (q1 = q2 AND a1 = a2) AS same_both FROM scores GROUP BY 1""", _SCORES))
def _(spark, sf):
    return P.pair_counts(_scores(spark, sf)).withColumn("languages", F.array_join("languages", "_"))


@query("score_histogram", sql("SELECT score::INT AS score, count(*) AS n FROM scores GROUP BY 1", _SCORES))
def _(spark, sf):
    return P.score_histogram(_scores(spark, sf))


_BUCKETS = """
buckets AS (
  SELECT trunc(similarity * 100) / 100.0::DOUBLE AS bucket, score FROM scores WHERE score >= 0),
inside AS (SELECT * FROM buckets WHERE bucket >= 0.8 AND bucket < 1.0)
"""


@query("mean_score_by_similarity", sql("""
SELECT bucket, count(*) AS n, round(avg(score), 6) AS mean_score FROM inside GROUP BY bucket""", _SCORES, _BUCKETS))
def _(spark, sf):
    return P.mean_score_by_similarity(_scores(spark, sf)).withColumn("mean_score", F.round("mean_score", 6))


@query("precision_recall_sweep", sql("""
, grid AS (SELECT unnest(range(80, 100)) / 100.0::DOUBLE AS bucket),
counts AS (
  SELECT g.bucket, l.score_limit, count(i.score) AS n, count(*) FILTER (i.score >= l.score_limit) AS good
  FROM grid g CROSS JOIN (SELECT unnest([80, 85, 90]) AS score_limit) l LEFT JOIN inside i ON i.bucket = g.bucket
  GROUP BY 1, 2),
summed AS (
  SELECT score_limit, bucket AS similarity_limit,
    (sum(n) OVER w)::BIGINT AS extracted, (sum(good) OVER w)::BIGINT AS correct,
    sum(n) OVER (PARTITION BY score_limit) AS total, sum(good) OVER (PARTITION BY score_limit) AS total_good
  FROM counts WINDOW w AS (PARTITION BY score_limit ORDER BY bucket DESC)),
rates AS (
  SELECT *, total_good / nullif(total, 0) AS share, correct / nullif(extracted, 0) AS precision,
    correct / nullif(total_good, 0) AS recall FROM summed)
SELECT score_limit, similarity_limit, extracted, correct, round(share, 6) AS share, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1 FROM rates
""", _SCORES, _BUCKETS).replace("\n, grid", ",\ngrid"))
def _(spark, sf):
    sweep = P.precision_recall_sweep(_scores(spark, sf))
    return sweep.withColumns({c: F.round(c, 6) for c in ("share", "precision", "recall", "f1")})


_BITEXTS = """
kept AS (
  SELECT *, l1 || '_' || l2 AS pair, count(*) OVER (PARTITION BY l1, l2) AS n
  FROM scores WHERE similarity >= 0.9 AND q1 <> q2 AND a1 <> a2)
"""
_BITEXT_SQL = """
SELECT pair, scheme_host AS origin, round(similarity, 6) AS labse_similarity, q1 AS question1, q2 AS question2,
  a1 AS answer1, a2 AS answer2, url1 || ',' || url2 AS urls FROM kept WHERE n >= 20"""


def _flat(bitexts):
    return bitexts.select(
        "pair", "origin", F.round("labse_similarity", 6).alias("labse_similarity"),
        "question1", "question2", "answer1", "answer2",
        F.array_join("details.urls", ",").alias("urls"))


@query("to_bitexts", sql(_BITEXT_SQL, _SCORES, _BITEXTS))
def _(spark, sf):
    return _flat(P.to_bitexts(_scores(spark, sf), min_rows=20))


@query("write_bitexts", sql(_BITEXT_SQL, _SCORES, _BITEXTS))
def _(spark, sf):
    path = A.scratch(spark, "bitexts")
    write_bitexts(P.to_bitexts(_scores(spark, sf), min_rows=20), path)
    schema = (
        "origin string, labse_similarity double, question1 string, question2 string, answer1 string, "
        "answer2 string, details struct<urls: array<string>>, pair string"
    )
    return _flat(spark.read.schema(schema).json(path))


