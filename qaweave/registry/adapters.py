"""Stand-ins for the corpus tables, derived from the given test tables.

Every function has its SQL twin in `CTE`, so oracle texts start from the given
tables as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaweave.functions.text import map_iso_code
from qaweave.operators.clean import add_id
from qaweave.operators.dedup import dedup_exact
from qaweave.session import new_path, written

# Spanish plays the small language.
LARGE = ("deu", "eng", "fra")
LARGE_SQL = "('deu','eng','fra')"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pairs(spark, sf) -> DataFrame:
    """First line of a document as question, the rest as answer."""
    cut = F.instr("text", "\n")
    host = F.concat(F.lit("https://"), "source", F.lit(".example.org"))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"), "source", "n_chars",
        host.alias("scheme_host"),
        F.concat(host, F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        map_iso_code(F.col("lang")).alias("language"),
        F.when(cut > 0, F.substring(F.col("text"), F.lit(1), cut - 1))
        .otherwise(F.col("text")).alias("question"),
        F.when(cut > 0, F.substring(F.col("text"), cut + 1, F.length("text")))
        .otherwise(F.lit("")).alias("answer"),
    )


_WRITTEN: dict[tuple[str, str], str] = {}


def faq(spark, sf) -> DataFrame:
    """The merged table: first row per id of a language. Like the corpus it stands
    for it is a stored table, written once per session and scanned by the jobs
    with their own column selection."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN:
        rows = dedup_exact(add_id(pairs(spark, sf)), ["language"], ["pos"])
        _WRITTEN[key] = written(rows, "faq", compression="zstd")
    return spark.read.parquet(_WRITTEN[key])


def labels(spark, sf) -> DataFrame:
    l = table(spark, sf, "labels").withColumnRenamed("doc_id", "pos")
    return faq(spark, sf).select("language", "id", "pos").join(l, "pos").select(
        "language", "id",
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("topic"),
        F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("question_type"),
    )


def flags(spark, sf) -> DataFrame:
    return faq(spark, sf).select(
        "language", "id",
        (F.col("n_chars") % 7 == 0).alias("filter"),
        ((F.col("n_chars") % 100) / F.lit(100.0)).alias("near_duplicate_similarity"),
    )


def half(vector: Column) -> Column:
    """The vector with the second half of its dimensions set to zero."""
    return F.transform(vector, lambda x, i: F.when(i < 32, x).otherwise(F.lit(0.0).cast("float")))


def vectors(spark, sf) -> DataFrame:
    """faq rows that have a vector, with the group number of the vector."""
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "pos")
    return faq(spark, sf).join(e, "pos").select(
        "language", "id", "pos", F.col("label").cast("string").alias("vec_group"),
        "embedding", F.col("embedding").alias("question_embedding"),
        half(F.col("embedding")).alias("answer_embedding"),
    )


def _escaped(column: str) -> Column:
    text = F.replace(F.col(column), F.lit("&"), F.lit("&amp;amp;"))
    text = F.replace(text, F.lit('"'), F.lit('\\"'))
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def quad_lines(spark, sf) -> DataFrame:
    """Eight lines per document: page, question and answer entity; ten documents
    of a source share a page, a source is a file."""
    d = F.col("pos").cast("string")
    graph = F.concat(F.lit("<"), F.col("scheme_host"), F.lit("/"),
                     F.floor(F.col("pos") / 200).cast("string"), F.lit(">   ."))
    kind = F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>")

    def line(subject, predicate, obj):
        return F.concat_ws(" ", F.concat(F.lit(f"_:{subject}"), d), predicate, obj, graph)

    def schema(name):
        return F.lit(f"<http://schema.org/{name}>")

    def literal(column):
        return F.concat(F.lit('"'), _escaped(column), F.lit('"@'), F.col("language"))

    lines = F.array(
        line("p", kind, schema("FAQPage")),
        line("p", schema("mainEntity"), F.concat(F.lit("_:q"), d)),
        line("q", kind, schema("Question")),
        line("q", schema("name"), literal("question")),
        line("q", schema("acceptedAnswer"), F.concat(F.lit("_:a"), d)),
        line("a", kind, schema("Answer")),
        line("a", schema("text"), literal("answer")),
        line("a", schema("url"), F.col("url")),
    )
    return pairs(spark, sf).select(
        F.concat(F.lit("part-"), "source").alias("file"), "pos",
        F.posexplode(lines).alias("k", "value"),
    ).select("file", (F.col("pos") * 8 + F.col("k")).alias("pos"), "value")


def scratch(spark, name: str) -> str:
    return new_path(spark, name)


_PAIRS = """
pairs AS (
  SELECT doc_id AS pos, source, n_chars,
    'https://' || source || '.example.org' AS scheme_host,
    'https://' || source || '.example.org/' || doc_id AS url,
    CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' END AS language,
    CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS question,
    CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS answer
  FROM documents),
faq AS (
  SELECT * FROM (
    SELECT *, md5(replace(question || ' ' || answer, chr(10), ' ')) AS id FROM pairs)
  QUALIFY row_number() OVER (PARTITION BY language, id ORDER BY pos) = 1),
label_rows AS (
  SELECT f.language, f.id, 'quality ' || l.quality AS topic, 'toxic ' || l.toxic AS question_type
  FROM faq f JOIN labels l ON l.doc_id = f.pos),
flag_rows AS (
  SELECT language, id, n_chars % 7 = 0 AS filter, (n_chars % 100) / 100.0::DOUBLE AS near_duplicate_similarity
  FROM faq),
vec AS (
  SELECT f.language, f.id, f.pos, e.label::VARCHAR AS vec_group, f.question, f.answer,
    e.embedding::DOUBLE[] AS embedding,
    list_concat(list_slice(e.embedding::DOUBLE[], 1, 32), list_transform(range(32), lambda x: 0.0::DOUBLE)) AS answer_embedding
  FROM faq f JOIN embeddings e ON e.vec_id = f.pos)
"""


def sql(body: str, *ctes: str) -> str:
    """An oracle text on top of the stand-ins."""
    return "WITH " + ",\n".join([_PAIRS.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()
