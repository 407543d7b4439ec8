"""One registered query for each operator, over whole tables, with its SQL if there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaweave.llm import exact_dedup, lattice_lm, lexical_search, line_dedup, mixing, packing, prefix_trie, quality, secrets, sharding, simhash, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="largest")


SQL["op1_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


@query
def op2_mix_sources(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_simhash(spark, sf_dir):
    return simhash.near_dedup(documents(spark, sf_dir)).select(
        "doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(documents(spark, sf_dir), window=50).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op4_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
     firsts AS (SELECT s, min(doc_id) AS lo FROM windows GROUP BY s),
     gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (
         SELECT doc_id, i, unnest(range(0, 50)) AS k FROM windows JOIN firsts USING (s) WHERE lo < doc_id)),
     words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op5_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(documents(spark, sf_dir)).select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op6_pack(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), capacity=2048)


@query
def op7_secrets(spark, sf_dir):
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secrets.find_secrets(documents(spark, sf_dir)).select(
        "doc_id", *map(count, ("assign", "access", "hex")),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


@query
def op8_toxicity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted")


@query
def op9_quality(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "chars_per_token", "byte_share", "entropy")


@query
def op10_shard(spark, sf_dir):
    """Near equal bytes in 40 shards."""
    return sharding.shard(documents(spark, sf_dir), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op11_prefix_trie(spark, sf_dir):
    c = F.col("conv_id")
    lists = prefix_trie.rebuilt(
        prefix_trie.turn_lists(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
        c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, most=5)
    return prefix_trie.prefix_trie(lists).drop("k1", "k2")


SQL["op11_prefix_trie"] = r"""
WITH turns AS (SELECT conv_id, turn, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
     lists AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, substr(sha256(len(t.r)::varchar || ':' || t.r || t.t), 1, 32)) AS l FROM turns GROUP BY conv_id),
     crc AS (SELECT *, xor(4294967295, list_reduce(
         [4294967295::bigint] || list_transform(range(1, len(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint),
         lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h FROM lists),
     built AS (SELECT c.conv_id, coalesce(b.l[1:c.h], []) || c.l[c.h + 1:] AS l FROM crc c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 100),
     prefixes AS (SELECT conv_id, d, l[1:d] AS p, len(l) = d AS whole FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM built)),
     nodes AS (SELECT d AS depth, p, min(conv_id) AS conv_id, count(*) AS n_convs,
                      sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (whole), '')) AS ends_sha256 FROM prefixes GROUP BY d, p),
     children AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
     own AS (SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(n.p[depth].t) END AS saved
             FROM nodes n LEFT JOIN children c ON c.p = n.p),
     subtree AS (SELECT p[1:k] AS p, sum(saved)::bigint AS saved_tokens, sum((n_children = 0)::int)::bigint AS n_leaves
                 FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM own) GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM own n JOIN subtree s ON s.p = n.p LEFT JOIN nodes u ON n.depth > 0 AND u.p = n.p[1:n.depth - 1]
"""


@query
def op12_lexical_search(spark, sf_dir):
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


SQL["op12_lexical_search"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     t AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
     tf AS (SELECT doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
     s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::bigint AS words FROM d),
     df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
     q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     hits AS (SELECT item_id, doc_id, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint
                     * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS x
              FROM q JOIN df USING (term) JOIN tf USING (term) CROSS JOIN s),
     scored AS (SELECT item_id, doc_id, sum(x)::bigint AS score FROM hits GROUP BY ALL),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query
def op13_lattice_lm(spark, sf_dir):
    return lattice_lm.score_documents(documents(spark, sf_dir))
