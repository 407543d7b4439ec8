"""Sources, quad parsing, entities, cleaning and identity."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from qaweave import schemas
from qaweave.constants import SPLIT_SEED
from qaweave.functions import text as X
from qaweave.functions.seeded import unit_draw
from qaweave.operators import clean, dedup, entities, quads
from qaweave.plans.extract import extract_faq, qa_rows
from qaweave.registry import adapters as A
from qaweave.registry import query
from qaweave.registry.adapters import sql
from qaweave.sources import lines as L
from qaweave.sources.entity_store import checkpoint_entities

# ---------------------------------------------------------------- SQL twins

_ESC = r"""replace(replace(replace({0}, '&', '&amp;amp;'), '"', '\"'), chr(10), '\n')"""
_GRAPH = "(scheme_host || '/' || (pos // 200))"
_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_S = "http://schema.org/"

LINE_CTE = f"""
line_parts AS (
  SELECT 'part-' || source AS file, pos * 8 + k AS pos, {_GRAPH} AS graph, pos AS doc, k,
    CASE WHEN k < 2 THEN '_:p' WHEN k < 5 THEN '_:q' ELSE '_:a' END || pos AS subject,
    CASE k WHEN 0 THEN '{_RDF}' WHEN 1 THEN '{_S}mainEntity' WHEN 2 THEN '{_RDF}'
      WHEN 3 THEN '{_S}name' WHEN 4 THEN '{_S}acceptedAnswer' WHEN 5 THEN '{_RDF}'
      WHEN 6 THEN '{_S}text' ELSE '{_S}url' END AS predicate,
    CASE k WHEN 0 THEN '{_S}FAQPage' WHEN 1 THEN '_:q' || pos WHEN 2 THEN '{_S}Question'
      WHEN 3 THEN question WHEN 4 THEN '_:a' || pos WHEN 5 THEN '{_S}Answer'
      WHEN 6 THEN answer ELSE url END AS object,
    CASE k WHEN 0 THEN '<{_S}FAQPage>' WHEN 1 THEN '_:q' || pos WHEN 2 THEN '<{_S}Question>'
      WHEN 3 THEN '"' || {_ESC.format('question')} || '"@' || language WHEN 4 THEN '_:a' || pos
      WHEN 5 THEN '<{_S}Answer>' WHEN 6 THEN '"' || {_ESC.format('answer')} || '"@' || language
      ELSE url END AS written
  FROM pairs, (SELECT unnest(range(8)) AS k)),
quad_lines AS (
  SELECT *, subject || ' <' || predicate || '> ' || written || ' <' || graph || '>   .' AS value
  FROM line_parts)
"""
# Entities of the rendered lines; the url line is dropped before parsing.
QA_CTE = f"""
found AS (
  SELECT 'part-' || source AS file, {_GRAPH} AS graph, question,
    max(pos) AS doc, min(pos) * 8 + 2 AS pos FROM pairs WHERE question <> '' GROUP BY ALL),
joined AS (
  SELECT f.file, f.graph, f.question, f.pos, p.answer, p.scheme_host, p.language
  FROM found f JOIN pairs p ON p.pos = f.doc)
"""
_FILTER = """length(question) >= 10 AND length(answer) >= 30 AND NOT contains(answer, '?')
  AND length(answer) - length(replace(answer, chr(10), '')) < 10"""
_TRIM = r"regexp_replace({0}, '\A\s+|\s+\z', '', 'g')"


def _nest(column, steps):
    for pattern, to in steps:
        column = f"regexp_replace({column}, '{pattern}', '{to}')"
    return column


_Q_PREFIX = [(r"\AQ:\s+", ""), (r"\AQuestion:\s+", ""), (r"\A\d+\.\d*\s+", "")]
_A_PREFIX = [(r"\AA:\s+", ""), (r"\AAnswer:\s+", ""), (r"\A\d+\.\d*\s+", "")]
_QUOTES = [('(?s)\\A"(?:(.*)")?\\z', "\\1"), ("(?s)\\A“(.*)”\\z", "\\1"),
           ("(?s)\\A‘(.*)’\\z", "\\1"), ("(?s)\\A‟(.*)”\\z", "\\1"),
           ("(?s)\\A„(.*)”\\z", "\\1"), ("(?s)\\A„(.*)“\\z", "\\1")]


def _cleaned(column, prefixes):
    body = _nest(column, prefixes + _QUOTES)
    return _TRIM.format(f"regexp_replace({body}, '{X.emoji_pattern()}', '', 'g')")


CLEAN_Q = _cleaned("question", _Q_PREFIX)
CLEAN_A = _cleaned("answer", _A_PREFIX)
_ID = "md5(replace(question || ' ' || answer, chr(10), ' '))"

# ---------------------------------------------------------------- sources


def _written_lines(spark, sf):
    path = A.scratch(spark, "quads")
    (A.quad_lines(spark, sf).repartition("file").sortWithinPartitions("file", "pos")
     .select("value").write.option("compression", "gzip").text(path))
    return path


@query("read_quads", sql(
    "SELECT graph, value, row_number() OVER (PARTITION BY graph ORDER BY pos) AS line_in_graph FROM quad_lines",
    LINE_CTE))
def _(spark, sf):
    lines = L.read_quad_lines(spark, L.quad_files(spark, _written_lines(spark, sf), "part-"))
    graph = F.regexp_extract("value", r"<([^<>]*)>\s{3}\.$", 1)
    order = Window.partitionBy("file", "graph").orderBy("pos")
    return lines.withColumn("graph", graph).select(
        "graph", "value", F.row_number().over(order).alias("line_in_graph"))


@query("read_jsonl_tolerant", sql("""
SELECT CASE WHEN pos % 10 = 0 THEN 'bad' ELSE id END AS id,
  CASE WHEN pos % 10 = 0 THEN '{"id": "' || id ELSE question END AS text FROM faq"""))
def _(spark, sf):
    path = A.scratch(spark, "faq-lines")
    rows = A.faq(spark, sf)
    broken = F.concat(F.lit('{"id": "'), "id")
    rows.select(
        F.when(F.col("pos") % 10 == 0, broken)
        .otherwise(F.to_json(F.struct("id", "url", "question", "answer"))).alias("value")
    ).write.text(path)
    good, bad = L.read_jsonl(spark, path, schemas.FAQ)
    return good.select("id", F.col("question").alias("text")).unionAll(
        bad.select(F.lit("bad").alias("id"), F.col("line").alias("text")))


@query("write_by_language", sql("SELECT language, source AS file, id, answer FROM faq"))
def _(spark, sf):
    path = A.scratch(spark, "by-language")
    L.write_by_language(
        A.faq(spark, sf).select("language", F.col("source").alias("file"), "id", "answer"), path)
    return spark.read.schema("id string, answer string, language string, file string").json(path)


@query("read_many", sql("SELECT id, language FROM faq"))
def _(spark, sf):
    path = A.scratch(spark, "parts")
    A.faq(spark, sf).select("source", "id", "language").write.partitionBy("source").json(path)
    return L.read_many(spark, f"{path}/source=src*/part-*.json", "id string, language string")


@query("checkpoint_entities", sql("""
SELECT file, graph, subject, pos - CASE WHEN k < 2 THEN k WHEN k < 5 THEN k - 2 ELSE k - 5 END AS pos,
  CASE WHEN k < 2 THEN 'FAQPage' WHEN k < 5 THEN 'Question' ELSE 'Answer' END AS type,
  predicate, pos AS value_pos, object AS value
FROM quad_lines WHERE k IN (1, 3, 4, 6)""", LINE_CTE))
def _(spark, sf):
    path = A.scratch(spark, "entities")
    lines = A.quad_lines(spark, sf)
    checkpoint_entities(spark, lines, path)
    again = checkpoint_entities(spark, lines, path)
    return again.withColumn("type", F.regexp_replace("type", "^http://schema.org/", ""))


# ---------------------------------------------------------------- quads


@query("drop_url_lines", sql("SELECT file, pos, value FROM quad_lines WHERE k <> 7", LINE_CTE))
def _(spark, sf):
    return quads.drop_url_lines(A.quad_lines(spark, sf))


@query("parse_quads", sql(
    "SELECT file, pos, graph, subject, predicate, object FROM quad_lines WHERE k <> 7", LINE_CTE))
def _(spark, sf):
    return quads.parse_quads(A.quad_lines(spark, sf))


@query("decode_literal", sql("SELECT pos, question, answer FROM pairs"))
def _(spark, sf):
    literal = lambda c: F.concat(F.lit('"'), A._escaped(c), F.lit('"'))
    rows = A.pairs(spark, sf).select("pos", *[literal(c).alias(c) for c in ("question", "answer")])
    return X.decode_literals(X.decode_literals(rows, "question"), "answer")


def _unescaped(column):
    """The entities that the pages hold, in one pass: the ampersand is the last."""
    for name, character in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        column = f"replace({column}, '&{name};', '{character}')"
    return column


def _html_sql():
    """Pages as text: elements without text, then block tags as blanks, then other tags."""
    text = f"""replace({_unescaped(r"replace(html, chr(10), '\\n')")}, '\\t', ' ')""".replace("\\\\", "\\")
    for pattern, to in (
        ("(?is)<script\\b.*?</script\\s*>", ""), ("(?is)<style\\b.*?</style\\s*>", ""), ("(?s)<!--.*?-->", ""), ("<![^>]*>", ""),
        (f"(?i)</?(?:{'|'.join(sorted(X.BLOCK_TAGS))})(?:[\\s/][^>]*)?>", " "), ("</?[a-zA-Z][^>]*>", ""),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    text = f"trim(regexp_replace({_unescaped(text)}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"
    lines = f"string_split(replace(replace(replace({text}, '\\\"', '\"'), '\\r\\n', chr(10)), '\\n', chr(10)), chr(10))"
    return f"""
SELECT page_id, array_to_string(list_filter(list_transform({lines}, lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM pages"""


@query("html_to_text", _html_sql())
def _(spark, sf):
    written = F.concat(F.lit('"'), F.replace(F.col("html"), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return X.decode_literals(A.table(spark, sf, "pages").select("page_id", written.alias("text")), "text")


@query("normalize_newlines", r"""
SELECT doc_id, regexp_replace(regexp_replace(
  replace(replace(replace(text, 'the ', 'the \r\n '), '\r\n', chr(10)), '\n', chr(10)),
  '\A\s+|\s+\z', '', 'g'), '\s*\n\s*', chr(10), 'g') AS text FROM documents""")
def _(spark, sf):
    marked = F.replace(F.col("text"), F.lit("the "), F.lit("the \\r\\n "))
    return A.table(spark, sf, "documents").select("doc_id", X.normalize_newlines(marked).alias("text"))


@query("strip_angles", r"""
SELECT page_id, regexp_replace('<' || url || '>', '\A[<>]+|[<>]+\z', '', 'g') AS url,
  regexp_replace(html, '\A[<>]+|[<>]+\z', '', 'g') AS html FROM pages""")
def _(spark, sf):
    wrapped = F.concat(F.lit("<"), "url", F.lit(">"))
    return A.table(spark, sf, "pages").select(
        "page_id", X.strip_angles(wrapped).alias("url"), X.strip_angles(F.col("html")).alias("html"))


# ---------------------------------------------------------------- entities


def _entities(spark, sf):
    return entities.build_entities(
        quads.split_lines(quads.drop_url_lines(A.quad_lines(spark, sf))), raw=True)


@query("build_entities", sql("""
SELECT file, graph, subject, pos - CASE WHEN k < 2 THEN k WHEN k < 5 THEN k - 2 ELSE k - 5 END AS pos,
  CASE WHEN k < 2 THEN 'FAQPage' WHEN k < 5 THEN 'Question' ELSE 'Answer' END AS type,
  predicate, pos AS value_pos, object AS value
FROM quad_lines WHERE k IN (1, 3, 4, 6)""", LINE_CTE))
def _(spark, sf):
    return _entities(spark, sf).withColumn("type", F.regexp_replace("type", "^http://schema.org/", ""))


@query("keep_types", """
SELECT p_partkey, 'https://schema.org/' || CASE p_partkey % 4 WHEN 0 THEN 'FAQPage'
  WHEN 1 THEN 'Question' ELSE 'Answer' END AS type
FROM part WHERE p_partkey % 4 < 3""")
def _(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("FAQPage", "Question", "Answer", "answer")])
    kind = F.try_element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int"))
    return entities.keep_types(A.table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("https://schema.org/"), kind).alias("type")))


@query("page_main_entities", sql("SELECT file, graph, object AS subject FROM quad_lines WHERE k = 1", LINE_CTE))
def _(spark, sf):
    return entities.page_main_entities(_entities(spark, sf))


@query("questions", sql(f"""
SELECT 'part-' || source AS file, {_GRAPH} AS graph, '_:q' || pos AS subject, pos * 8 + 2 AS pos,
  question, '_:a' || pos AS answer_subject FROM pairs"""))
def _(spark, sf):
    return entities.questions(_entities(spark, sf))


@query("questions_last_wins", sql("""
SELECT file, graph, question, '_:q' || doc AS subject, '_:a' || doc AS answer_subject, pos FROM found""", QA_CTE))
def _(spark, sf):
    return entities.questions_last_wins(entities.questions(_entities(spark, sf)))


@query("answers", sql(f"""
SELECT 'part-' || source AS file, {_GRAPH} AS graph, '_:a' || pos AS answer_subject, answer FROM pairs"""))
def _(spark, sf):
    return entities.answers(_entities(spark, sf))


@query("join_qa", sql("SELECT file, graph, question, pos, answer FROM joined", QA_CTE))
def _(spark, sf):
    e = _entities(spark, sf)
    found = entities.questions_last_wins(entities.questions(e))
    return entities.join_qa(found, entities.page_main_entities(e), entities.answers(e)).select(
        "file", "graph", "question", "pos", "answer")


# ---------------------------------------------------------------- cleaning


@query("qa_filters", sql(f"SELECT pos, question, answer FROM pairs WHERE {_FILTER}"))
def _(spark, sf):
    return clean.qa_filters(A.pairs(spark, sf).select("pos", "question", "answer"))


@query("match_text", sql("SELECT pos, replace(question || ' ' || answer, chr(10), ' ') AS text FROM pairs"))
def _(spark, sf):
    return A.pairs(spark, sf).select(
        "pos", X.match_text(F.col("question"), F.col("answer")).alias("text"))


@query("scheme_host", r"""
WITH urls AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '.example.', '.Example.')
    WHEN 1 THEN regexp_replace(url, '(example\.[a-z]+)', '\1:8080')
    WHEN 2 THEN url ELSE regexp_replace(url, '://', '://user@') END AS url FROM pages),
parts AS (
  SELECT *, regexp_extract(url, '\A([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 1) AS scheme,
    regexp_extract(url, '\A([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 2) AS authority FROM urls),
hosts AS (
  SELECT *, lower(regexp_extract(authority, '\A(?:.*@)?([^:]*)', 1)) AS host FROM parts)
SELECT page_id, url, scheme || '://' || host AS scheme_host FROM hosts
WHERE host <> '' AND NOT contains(authority, '[') AND starts_with(lower(authority), host)""")
def _(spark, sf):
    turn = F.col("page_id") % 4
    url = (
        F.when(turn == 0, F.replace(F.col("url"), F.lit(".example."), F.lit(".Example.")))
        .when(turn == 1, F.regexp_replace("url", r"(example\.[a-z]+)", "$1:8080"))
        .when(turn == 2, F.col("url")).otherwise(F.regexp_replace("url", "://", "://user@"))
    )
    return clean.add_scheme_host(A.table(spark, sf, "pages").select("page_id", url.alias("url")))


def _numbered(column, mark):
    """Every third row gets a leading mark, every third a number."""
    turn = F.col("pos") % 3
    return F.when(turn == 0, F.concat(F.lit(mark), column)).when(
        turn == 1, F.concat(F.lit("12.3  "), column)).otherwise(F.col(column))


@query("strip_prefixes", sql(f"""
SELECT pos, {_nest("CASE pos % 3 WHEN 0 THEN 'Q:  ' || question WHEN 1 THEN '12.3  ' || question ELSE question END", _Q_PREFIX)} AS question,
  {_nest("CASE pos % 3 WHEN 0 THEN 'Answer: ' || answer WHEN 1 THEN '12.3  ' || answer ELSE answer END", _A_PREFIX)} AS answer
FROM pairs"""))
def _(spark, sf):
    return A.pairs(spark, sf).select(
        "pos", X.strip_question_prefixes(_numbered("question", "Q:  ")).alias("question"),
        X.strip_answer_prefixes(_numbered("answer", "Answer: ")).alias("answer"))


@query("strip_quotes", sql(f"""
SELECT pos, {_nest("CASE pos % 3 WHEN 0 THEN '“' || question || '”' WHEN 1 THEN '„' || question || '“' ELSE '\"' || question || '\"' END", _QUOTES)} AS question
FROM pairs"""))
def _(spark, sf):
    turn, q = F.col("pos") % 3, F.col("question")
    quoted = (
        F.when(turn == 0, F.concat(F.lit("“"), q, F.lit("”")))
        .when(turn == 1, F.concat(F.lit("„"), q, F.lit("“")))
        .otherwise(F.concat(F.lit('"'), q, F.lit('"')))
    )
    return A.pairs(spark, sf).select("pos", X.strip_quotes(quoted).alias("question"))


@query("strip_emoji", sql(f"""
SELECT pos, {_TRIM.format("replace(answer, 'the ', 'the  ')")} AS answer FROM pairs"""))
def _(spark, sf):
    marked = F.replace(F.col("answer"), F.lit("the "), F.lit("the 👍🏽❤️👨‍👩‍👧 "))
    return A.pairs(spark, sf).select("pos", X.strip_emoji(marked).alias("answer"))


@query("map_iso_code", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' END AS language,
  CASE WHEN length(source) = 3 THEN source END AS from_source
FROM (SELECT doc_id, lang, substr(source, 1, 3 + doc_id % 2) AS source FROM documents)""")
def _(spark, sf):
    code = F.substring(F.col("source"), F.lit(1), (F.col("doc_id") % 2 + 3).cast("int"))
    return A.table(spark, sf, "documents").select(
        "doc_id", X.map_iso_code(F.col("lang")).alias("language"),
        X.map_iso_code(code).alias("from_source"))


@query("qa_id", sql(f"SELECT pos, {_ID} AS id FROM pairs"))
def _(spark, sf):
    return clean.add_id(A.pairs(spark, sf)).select("pos", "id")


@query("dedup_exact_file", sql(f"""
SELECT source AS file, {_ID} AS id, url, pos FROM pairs
QUALIFY row_number() OVER (PARTITION BY source, {_ID} ORDER BY url, pos) = 1"""))
def _(spark, sf):
    rows = clean.add_id(A.pairs(spark, sf)).select(F.col("source").alias("file"), "id", "url", "pos")
    return dedup.dedup_exact(rows, ["file"], ["url", "pos"])


def _trained_detector(spark, sf):
    """Learnt from a seeded half of the documents; it judges all of them."""
    half = A.table(spark, sf, "documents").filter(unit_draw(SPLIT_SEED, F.col("doc_id").cast("string")) < 0.5)
    model = clean.train_language_model(half.select("lang", F.translate("text", "\n", " ").alias("text")), "text", "lang")
    return clean.model_detector(model)


def _slots(name, source, key):
    """Buckets of the three-grams of (key, t) in `source`, with their number."""
    return f"""
{name}_codes AS (SELECT {key}, list_transform(string_split(' ' || t || ' ', ''), lambda x: unicode(x)) AS c FROM {source}),
{name} AS (
  SELECT {key}, ((((c[i]::HUGEINT * 1000003 + c[i + 1] * 8191 + c[i + 2]) * 11400714819323198485::HUGEINT)
    % 18446744073709551616::HUGEINT) // 1048576 % 8192)::INT AS slot, count(*) AS n
  FROM (SELECT *, unnest(range(1, len(c) - 1)) AS i FROM {name}_codes) GROUP BY ALL)"""


def _detected(source, key):
    """The detector said in SQL: counts of half of the documents, add one, best language
    and its share for the texts t of `source`."""
    return (f"""
known AS (SELECT lang, replace(text, chr(10), ' ') AS t FROM documents
  WHERE ('0x' || substr(md5('{SPLIT_SEED}|' || doc_id), 1, 8))::BIGINT < 2147483648)""", _slots("known_slots", "known", "lang"), """
mass AS (SELECT lang, sum(n) + 8192 AS m FROM known_slots GROUP BY lang),
prior AS (SELECT lang, m, ln(m / sum(m) OVER ()) AS p FROM mass)""", _slots("found_slots", source, key), f"""
heard AS (
  SELECT {key}, lang, sum(s.n * ln((1 + coalesce(k.n, 0)) / m)) + any_value(p) AS score
  FROM found_slots s CROSS JOIN prior LEFT JOIN known_slots k USING (lang, slot) GROUP BY {key}, lang),
detected AS (
  SELECT {key}, arg_max(lang, score) AS label, 1 / sum(exp(score - top)) AS confidence
  FROM (SELECT *, max(score) OVER (PARTITION BY {key}) AS top FROM heard) GROUP BY {key})""")


_CODE = "CASE label WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' END AS language"


@query("detect_language", sql(
    f"SELECT pos, {_CODE}, round(confidence, 6) AS confidence FROM detected WHERE confidence >= 0.63",
    "texts AS (SELECT pos, replace(question || ' ' || answer, chr(10), ' ') AS t FROM pairs)", *_detected("texts", "pos")))
def _(spark, sf):
    rows = A.pairs(spark, sf).select("pos", "question", "answer")
    return clean.detect_language(rows, _trained_detector(spark, sf)).select(
        "pos", "language", F.round("confidence", 6).alias("confidence"))


_QA_ROWS = f"""
cleaned AS (
  SELECT file, graph AS url, scheme_host, pos, {CLEAN_Q} AS question, {CLEAN_A} AS answer, language
  FROM joined WHERE {_FILTER})
"""


@query("qa_rows", sql("SELECT * EXCLUDE (language) FROM cleaned", QA_CTE, _QA_ROWS))
def _(spark, sf):
    return qa_rows(_entities(spark, sf))


@query("extract_faq", sql(f"""
SELECT id, url, scheme_host, {_CODE}, round(confidence, 6) AS confidence, question, answer, file, pos
FROM (SELECT * EXCLUDE (language), {_ID} AS id FROM cleaned) JOIN detected USING (file, pos) WHERE confidence >= 0.63
QUALIFY row_number() OVER (PARTITION BY file, id ORDER BY url, pos) = 1""", QA_CTE, _QA_ROWS,
                          "texts AS (SELECT file, pos, replace(question || ' ' || answer, chr(10), ' ') AS t FROM cleaned)",
                          *_detected("texts", "file, pos")))
def _(spark, sf):
    store = checkpoint_entities(spark, A.quad_lines(spark, sf), A.scratch(spark, "entities"),
                                entities.QA_PROPERTIES)
    return extract_faq(store, _trained_detector(spark, sf)).select(
        "id", "url", "scheme_host", "language", F.round("confidence", 6).alias("confidence"), "question", "answer", "file", "pos")
