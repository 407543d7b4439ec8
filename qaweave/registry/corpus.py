"""Merge, flags, host runs and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaweave.functions.vectors import cosine, l2_normalize, norm
from qaweave.operators import clean, dedup, neardup, runs, stats
from qaweave.operators.ordered import numbered
from qaweave.plans.report import statistics_report, write_statistics
from qaweave.registry import adapters as A
from qaweave.registry import query
from qaweave.registry.adapters import LARGE, LARGE_SQL, sql
from qaweave.sources.lines import write_merged

# ---------------------------------------------------------------- merge


def _parts(spark, sf):
    return clean.add_id(A.pairs(spark, sf)).select(
        "language", "id", "url", F.col("source").alias("part"), F.col("pos").alias("row"))


_PARTS = """
parts AS (
  SELECT language, md5(replace(question || ' ' || answer, chr(10), ' ')) AS id, url,
    source AS part, pos AS row FROM pairs)
"""


@query("merge_parts", sql("""
SELECT language, id, url, part, row FROM parts
QUALIFY row_number() OVER (PARTITION BY language, id ORDER BY url, part, row) = 1""", _PARTS))
def _(spark, sf):
    return dedup.merge_parts(_parts(spark, sf)).drop("late")


@query("merge_extend", sql("""
SELECT language, id, url, late, part, row FROM (
  SELECT *, false AS late FROM parts WHERE part >= 'src5'
  UNION ALL SELECT language, id, replace(url, '/src3', '/src15'), part, row, true FROM (
    SELECT * FROM parts WHERE part < 'src5'
    QUALIFY row_number() OVER (PARTITION BY language, id ORDER BY url, part, row) = 1))
QUALIFY row_number() OVER (PARTITION BY language, id ORDER BY url, late, part, row) = 1""", _PARTS))
def _(spark, sf):
    rows = _parts(spark, sf)
    earlier = dedup.merge_parts(rows.filter("part < 'src5'")).drop("late").withColumn(
        "url", F.replace(F.col("url"), F.lit("/src3"), F.lit("/src15")))
    return dedup.merge_parts(rows.filter("part >= 'src5'"), earlier)


@query("merge_order", sql("""
SELECT language, id, url, row_number() OVER (PARTITION BY language ORDER BY url, part, row) AS n FROM (
  SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY language, id ORDER BY url, part, row) = 1)""", _PARTS))
def _(spark, sf):
    path = A.scratch(spark, "merged")
    write_merged(dedup.in_merge_order(dedup.merge_parts(_parts(spark, sf))), path)
    return numbered(spark.read.parquet(path), ["language"], "pos", "n").select(
        "language", "id", "url", "n")


# ---------------------------------------------------------------- vectors, flags

_COS = "list_dot_product(embedding, answer_embedding) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(answer_embedding, answer_embedding)))"


@query("cosine", sql(f"SELECT language, id, round({_COS}, 6) AS similarity FROM vec"))
def _(spark, sf):
    similarity = cosine(F.col("question_embedding"), F.col("answer_embedding"))
    return A.vectors(spark, sf).select("language", "id", F.round(similarity, 6).alias("similarity"))


@query("l2_normalize", """
SELECT vec_id, 1.0::DOUBLE AS length, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first
FROM embeddings""")
def _(spark, sf):
    doubled = F.transform("embedding", lambda x: x * 3)
    unit = A.table(spark, sf, "embeddings").select("vec_id", l2_normalize(doubled).alias("u"))
    return unit.select("vec_id", F.round(norm(F.col("u")), 6).alias("length"),
                       F.round(F.col("u")[0], 6).alias("first"))


@query("flag_exact_question", sql("""
SELECT language, id, row_number() OVER (PARTITION BY language, question ORDER BY pos) > 1 AS exact_duplicate FROM faq"""))
def _(spark, sf):
    return neardup.flag_exact_question(A.faq(spark, sf)).select("language", "id", "exact_duplicate")


@query("flag_qa_mismatch", sql(f"SELECT language, id, {_COS} < 0.7 AS qa_mismatch FROM vec"))
def _(spark, sf):
    return neardup.flag_qa_mismatch(A.vectors(spark, sf), 0.7).select("language", "id", "qa_mismatch")


@query("near_duplicate_similarity", """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.label, a.vec_id, round(greatest(0, coalesce(max(list_dot_product(a.v, b.v)
  / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))), 0)), 6) AS near_duplicate_similarity
FROM e a LEFT JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label, a.vec_id""")
def _(spark, sf):
    return neardup.near_duplicate_similarity(
        A.table(spark, sf, "embeddings"), ["label"], "vec_id", "embedding"
    ).withColumn("near_duplicate_similarity", F.round("near_duplicate_similarity", 6))


_FLAGS = f"""
marked AS (
  SELECT language, id, scheme_host, row_number() OVER (PARTITION BY language, question ORDER BY pos) > 1 AS dup FROM faq),
tested AS (
  SELECT m.language, m.id, m.scheme_host, v.embedding, {_COS} < 0.7 AS mismatch
  FROM marked m JOIN vec v USING (language, id) WHERE NOT dup),
near AS (
  SELECT a.language, a.id, greatest(0, coalesce(max(list_dot_product(a.embedding, b.embedding)), 0)) AS s
  FROM tested a LEFT JOIN tested b ON a.language = b.language AND a.scheme_host = b.scheme_host
    AND a.id <> b.id AND NOT b.mismatch
  WHERE NOT a.mismatch GROUP BY a.language, a.id),
made AS (
  SELECT m.language, m.id, m.dup OR coalesce(t.mismatch, false) AS filter,
    coalesce(n.s, 0) AS near_duplicate_similarity
  FROM marked m LEFT JOIN tested t USING (language, id) LEFT JOIN near n USING (language, id))
"""


def _made_flags(spark, sf):
    return neardup.make_flags(A.faq(spark, sf), A.vectors(spark, sf).select(
        "language", "id", "question_embedding", "answer_embedding"), 0.7)


@query("make_flags", sql(
    "SELECT language, id, filter, round(near_duplicate_similarity, 6) AS near_duplicate_similarity FROM made", _FLAGS))
def _(spark, sf):
    return _made_flags(spark, sf).withColumn(
        "near_duplicate_similarity", F.round("near_duplicate_similarity", 6))


@query("apply_flags", sql("""
SELECT f.language, f.id, f.url FROM faq f JOIN made m USING (language, id)
WHERE NOT m.filter AND m.near_duplicate_similarity < 0.2""", _FLAGS))
def _(spark, sf):
    return neardup.apply_flags(
        A.faq(spark, sf).select("language", "id", "url"), _made_flags(spark, sf), 0.2)


# ---------------------------------------------------------------- runs

_RUNS = """
starts AS (
  SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS start
  FROM (SELECT event_id, 'd' || (user_id % 3) AS grp, event_type FROM events)
  WINDOW w AS (PARTITION BY grp ORDER BY event_id)),
numbered AS (SELECT *, sum(start) OVER (PARTITION BY grp ORDER BY event_id) AS run_id FROM starts)
"""


def _events(spark, sf):
    group = F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string"))
    return A.table(spark, sf, "events").select("event_id", group.alias("grp"), "event_type")


@query("host_runs", "WITH " + _RUNS.strip() + """
SELECT grp, event_type, run_id::BIGINT AS run_id, min(event_id) AS first_pos, count(*) AS n_rows
FROM numbered GROUP BY grp, event_type, run_id""")
def _(spark, sf):
    return runs.host_runs(_events(spark, sf), ["grp"], "event_id", "event_type")


@query("first_of_run", "WITH " + _RUNS.strip() + "\nSELECT grp, event_id, event_type FROM starts WHERE start = 1")
def _(spark, sf):
    return runs.first_of_run(_events(spark, sf), ["grp"], "event_id", "event_type").select(
        "grp", "event_id", "event_type")


@query("rows_of_host", sql("""
SELECT language, id, scheme_host FROM faq WHERE scheme_host IN (
  SELECT 'https://src' || s_suppkey || '.example.org' FROM supplier WHERE s_nationkey < 10)"""))
def _(spark, sf):
    hosts = A.table(spark, sf, "supplier").filter("s_nationkey < 10").select(
        F.concat(F.lit("https://src"), F.col("s_suppkey").cast("string"), F.lit(".example.org")).alias("scheme_host"))
    return runs.rows_of_host(A.faq(spark, sf), hosts).select("language", "id", "scheme_host")


# ---------------------------------------------------------------- statistics


def _joined(column):
    return F.array_join(column, ",").alias(column)


@query("language_lists", sql(f"""
SELECT string_agg(language, ',' ORDER BY language) AS languages,
  string_agg(language, ',' ORDER BY language) FILTER (language IN {LARGE_SQL}) AS large_languages,
  string_agg(language, ',' ORDER BY language) FILTER (language NOT IN {LARGE_SQL}) AS small_languages,
  count(*) AS num_languages, count(*) FILTER (language IN {LARGE_SQL}) AS num_large_languages,
  count(*) FILTER (language NOT IN {LARGE_SQL}) AS num_small_languages
FROM (SELECT DISTINCT language FROM faq)"""))
def _(spark, sf):
    lists = stats.language_lists(A.faq(spark, sf), LARGE)
    names = ["languages", "large_languages", "small_languages"]
    counts = [F.col(f"num_{n}").cast("long").alias(f"num_{n}") for n in names]
    return lists.select(*[_joined(n) for n in names], *counts)


@query("pairs_per_language", sql("SELECT language, count(*) AS qa_pairs FROM faq GROUP BY ROLLUP (language)"))
def _(spark, sf):
    return stats.pairs_per_language(A.faq(spark, sf))


@query("hosts_per_language", sql(
    "SELECT language, count(DISTINCT scheme_host) AS scheme_hosts FROM faq GROUP BY language"))
def _(spark, sf):
    return stats.hosts_per_language(A.faq(spark, sf))


def _length_sql(column):
    return sql(f"""
SELECT language, min(length({column})) AS min_length, max(length({column})) AS max_length,
  round(avg(length({column})), 6) AS avg_length FROM faq GROUP BY ROLLUP (language)""")


@query("question_lengths", _length_sql("question"))
def _(spark, sf):
    return stats.question_lengths(A.faq(spark, sf)).withColumn("avg_length", F.round("avg_length", 6))


@query("answer_lengths", _length_sql("answer"))
def _(spark, sf):
    return stats.answer_lengths(A.faq(spark, sf)).withColumn("avg_length", F.round("avg_length", 6))


def _per_sql(name):
    return sql(f"""
SELECT language, {name}, count(*) AS qa_pairs FROM label_rows
WHERE language IN {LARGE_SQL} GROUP BY GROUPING SETS ((language, {name}), ({name}))""")


@query("pairs_per_topic", _per_sql("topic"))
def _(spark, sf):
    return stats.pairs_per_topic(A.faq(spark, sf), A.labels(spark, sf), LARGE)


@query("pairs_per_question_type", _per_sql("question_type"))
def _(spark, sf):
    return stats.pairs_per_question_type(A.faq(spark, sf), A.labels(spark, sf), LARGE)


_FLAGGED = f"""
flagged AS (
  SELECT f.language, f.scheme_host, g.filter, g.near_duplicate_similarity
  FROM faq f JOIN label_rows l USING (language, id) JOIN flag_rows g USING (language, id)
  WHERE f.language IN {LARGE_SQL})
"""


@query("filtered_counts", sql("""
SELECT language, similarity, count(*) FILTER (filter OR near_duplicate_similarity >= similarity) AS filtered,
  count(*) FILTER (NOT (filter OR near_duplicate_similarity >= similarity)) AS kept
FROM flagged, (SELECT unnest([0.7::DOUBLE, 0.75::DOUBLE, 0.8::DOUBLE]) AS similarity)
GROUP BY GROUPING SETS ((language, similarity), (similarity))""", _FLAGGED))
def _(spark, sf):
    return stats.filtered_counts(
        A.faq(spark, sf), A.labels(spark, sf), A.flags(spark, sf), large=LARGE)


@query("multilingual_hosts", sql("""
SELECT scheme_host, language, n FROM (
  SELECT scheme_host, language, count(*) AS n, count(*) OVER (PARTITION BY scheme_host) AS languages
  FROM flagged WHERE NOT filter GROUP BY scheme_host, language)
WHERE languages > 1""", _FLAGGED))
def _(spark, sf):
    hosts = stats.multilingual_hosts(
        A.faq(spark, sf), A.labels(spark, sf), A.flags(spark, sf), large=LARGE)
    return hosts.select("scheme_host", F.explode("counts").alias("language", "n"))


@query("write_statistics", sql(f"""
SELECT (SELECT count(*) FROM faq) AS qa_pairs, (SELECT count(*) FROM faq WHERE language = 'fra') AS qa_pairs_fra,
  (SELECT round(avg(length(question)), 4) FROM faq) AS avg_question,
  (SELECT count(*) FROM label_rows WHERE topic = 'quality 1' AND language IN {LARGE_SQL}) AS topic_1,
  (SELECT count(*) FROM label_rows WHERE topic = 'quality 1' AND language = 'eng') AS topic_1_eng,
  (SELECT count(*) FROM flagged WHERE filter OR near_duplicate_similarity >= 0.75) AS filtered_075,
  (SELECT count(*) FROM (SELECT scheme_host FROM flagged WHERE NOT filter GROUP BY scheme_host
    HAVING count(DISTINCT language) > 1)) AS hosts""", _FLAGGED))
def _(spark, sf):
    f, l, g = A.faq(spark, sf), A.labels(spark, sf), A.flags(spark, sf)
    path = A.scratch(spark, "statistics")
    write_statistics(statistics_report(f, l, g, LARGE), stats.multilingual_hosts(f, l, g, large=LARGE), path)
    schema = (
        "qa_pairs_overall long, qa_pairs_per_language map<string,long>, "
        "question_lengths_overall struct<avg: double>, qa_pairs_per_topic_overall map<string,long>, "
        "qa_pairs_per_topic_and_language map<string,map<string,long>>, "
        "`qa_pairs_filtered/unfiltered_overall (0.75)` array<long>"
    )
    hosts = spark.read.text(f"{path}/scheme_hosts_languages").agg(F.count(F.lit(1)).alias("hosts"))
    report = spark.read.schema(schema).json(f"{path}/statistics").select(
        F.col("qa_pairs_overall").alias("qa_pairs"),
        F.col("qa_pairs_per_language")["fra"].alias("qa_pairs_fra"),
        F.round("question_lengths_overall.avg", 4).alias("avg_question"),
        F.col("qa_pairs_per_topic_overall")["quality 1"].alias("topic_1"),
        F.col("qa_pairs_per_topic_and_language")["eng"]["quality 1"].alias("topic_1_eng"),
        F.col("`qa_pairs_filtered/unfiltered_overall (0.75)`")[0].alias("filtered_075"),
        F.lit(1).alias("one"))
    # Two one-row tables.
    return report.join(hosts.withColumn("one", F.lit(1)), "one").drop("one")
