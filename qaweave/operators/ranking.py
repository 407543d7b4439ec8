"""BM25, dense and hybrid ranking of a corpus for many queries at once.

`language` is a key everywhere, so all languages of a task are ranked in one
job. A task holds a block of queries and the best `k` documents of each while a
part of the corpus streams past in stripes; only those leave it, so the rows that
leave do not grow with the number of stripes. Per-language tables hold one row per
language code (three letters, at most 17,576), which bounds what is broadcast.

A `Search` is a ranking that has not run. One task then reads a block of queries and after
it the whole corpus of their language from stored tables, so ranks are whole where they
arise and no hit, document or query is copied or moved to meet another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaweave import constants as C
from qaweave.operators.postings import CHUNK_DOCS, NEAR, PIECE, Chunk, Queries, chunks, indexed
from qaweave.operators.streams import HELD, PASSING, Best, Deep, in_cells, matrix, runs, streamed
from qaweave.session import FREE_SHUFFLES, new_path, stored

# A document is copied once for each block of queries, a query once for each part of
# the corpus; a query gives back at most k rows for each part.
QUERY_ROWS = 65536
DOC_ROWS = 262144
#: Kept hits of a block of queries (12 bytes each), scores of a stripe of vectors.
MOST_KEPT, MOST_SCORES = 8_000_000, 1_000_000
#: Below so many rows blocks are not cut to give every core one; cells a core then has.
LEAST_QUERY_ROWS, LEAST_DOC_ROWS, CELLS = 256, 16384, 4
#: Tasks of about equal work that a core has where one task reads the whole corpus of a language.
TASKS = 8
#: Documents of a task that indexes, unless it has them all.
LEAST_INDEXED = 4096
#: Documents of a language that all judged queries see first (and at least so many times
#: `k`); each further round sees up to so many times as many.
FIRST_ROWS, FIRST_TIMES, WIDER = 4096, 8, 8
SCORE_DIGITS = 9
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
_CELL = ["language", "q_block", "d_block"]
_RUN = "language string, query_id string, doc_id string, score double"
#: Rows of a run that leave a task at a time.
LEAVING = 1 << 17


def _tokens(text):
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))


def _block_counts(queries: DataFrame, corpus: DataFrame, k: int, q_rows: int | None, d_rows: int | None) -> DataFrame:
    """One row per language: into how many blocks queries and documents are cut. Without
    given sizes, blocks of queries are as large as their hits allow, and the cells are
    enough for every core; where few hits leave, the corpus is cut for that, else the queries."""
    cores = queries.sparkSession.sparkContext.defaultParallelism

    def sized(df, name):
        return df.groupBy("language").agg(F.count(F.lit(1)).alias(name))

    large = q_rows or max(1, min(QUERY_ROWS, MOST_KEPT // k))
    least = max(LEAST_DOC_ROWS, 1600 * k)
    n_q, n_d = F.ceil(F.col("q") / large), F.ceil(F.col("d") / F.lit(d_rows or max(DOC_ROWS, 16 * k)))
    if not d_rows:
        n_d = F.greatest(n_d, F.least(F.ceil(F.col("d") / least), F.ceil(F.lit(CELLS * cores) / n_q)))
    if not q_rows:
        n_q = F.greatest(n_q, F.least(F.ceil(F.col("q") / LEAST_QUERY_ROWS), F.ceil(F.lit(cores) / n_d)))
    return sized(queries, "q").join(sized(corpus, "d"), "language").select(
        "language", F.greatest(F.lit(1), n_q).cast("int").alias("n_q"), F.greatest(F.lit(1), n_d).cast("int").alias("n_d"))


def _cells(df: DataFrame, counts: DataFrame, side: int, key: str, own: str, n_own: str, other: str,
           n_other: str) -> DataFrame:
    """Each row to its own block and once to every block of the other side.
    Columns get new identities, since both sides may come from one table."""
    return (
        df.join(F.broadcast(counts), "language")
        .select(*[F.col(c).alias(c) for c in [*df.columns, "n_q", "n_d"]], F.lit(side).alias("side"))
        .withColumn(own, F.pmod(F.xxhash64(key), F.col(n_own)).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
        .drop("n_q", "n_d")
        .withColumnRenamed(key, "row_id")
    )


def _searched(queries: DataFrame, corpus: DataFrame, counts: DataFrame, search, schema: str) -> DataFrame:
    """What `search` makes of the held rows of `queries` (query_id) and the passing ones of
    `corpus` (doc_id), alike in their other columns. Documents pass in descending order of
    their id, which settles ties."""
    left = _cells(queries, counts, HELD, "query_id", "q_block", "n_q", "d_block", "n_d")
    right = _cells(corpus, counts, PASSING, "doc_id", "d_block", "n_d", "q_block", "n_q")

    def run(batches):
        for held, passing in streamed(batches, _CELL):
            if held is not None:
                yield from search(held, passing)

    return in_cells(left.unionByName(right), _CELL, F.desc("row_id")).mapInArrow(run, schema)


def _found(held: pa.Table, best: Best) -> Iterator[pa.RecordBatch]:
    for q, doc_id, score in best.parts():
        if len(q):
            own = [held.column(c).combine_chunks().take(pa.array(q)) for c in ("language", "row_id")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(doc_id, pa.string()), pa.array(score)], ["language", "query_id", "doc_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("language", "query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _terms(df: DataFrame, key: str) -> DataFrame:
    """Each text's number of words and their 64-bit hashes."""
    code = F.transform(F.col("tokens"), lambda t: F.xxhash64(t))
    return df.select("language", key, _tokens(F.col("text")).alias("tokens")).select(
        "language", key, F.size("tokens").alias("size"), code.alias("codes"))


def _weighted(queries: DataFrame, df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Queries with the terms that they share with the corpus, and their weights."""
    query_terms = (
        _terms(queries, "query_id").select("language", "query_id", F.explode("codes").alias("code"))
        .groupBy("language", "query_id", "code").agg(F.count(F.lit(1)).alias("q_tf"))
    )
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return (
        query_terms.join(df, ["language", "code"]).join(F.broadcast(sizes), "language")
        .groupBy("language", "query_id").agg(
            F.collect_list("code").alias("codes"), F.collect_list(idf * F.col("q_tf")).alias("weights")))


def _postings(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with the terms they share with the corpus and their weights, documents with
    all their terms (repeats included) and the part of their length in the score. A term is
    its 64-bit hash. A text is cut into tokens once, and no token is a row that moves."""
    postings = stored(
        _terms(corpus, "doc_id").groupBy("language", "doc_id").agg(
            F.first("size").alias("doc_len"), F.sort_array(F.flatten(F.collect_list("codes"))).alias("codes")), "postings")
    sizes = postings.groupBy("language").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    df = postings.select("language", F.explode(F.array_distinct("codes")).alias("code")).groupBy("language", "code").agg(
        F.count(F.lit(1)).alias("df"))
    weighted = stored(_weighted(queries, df, sizes), "query-terms")
    return weighted, postings.join(F.broadcast(sizes), "language")


#: Sides of a search by terms and of one by vectors: what is held, what passes.
_ASKED, _NEAREST, _PIECES, _VECTORS = range(4)
_COLUMNS = {"row_id": "string", "weights": "array<double>", "embedding": "array<double>", "avg_len": "double",
            **{n: t for n, t in (c.split() for c in PIECE.split(", ")) if n != "language"}}


class Search(NamedTuple):
    """A ranking that has not run: rows to hold and rows to pass (language and `_COLUMNS`),
    and what makes a running best of the held rows and the passing batches."""

    held: DataFrame
    passing: DataFrame
    sides: tuple[int, int]
    k: int
    q_rows: int | None
    best: Callable

    @staticmethod
    def of(held, passing, sides, k, q_rows, best) -> Search:
        def wide(df, side):
            null = {c: F.lit(None).cast(t) for c, t in _COLUMNS.items() if c not in df.columns}
            return df.filter("language IS NOT NULL").withColumns(null).select("language", F.lit(side).alias("side"), *_COLUMNS)

        return Search(wide(held, sides[0]), wide(passing, sides[1]), sides, k, q_rows, best)


def _in_one_task(searches: list[Search], run, schema: str) -> DataFrame:
    """`run` over tasks that read the held rows of a block of queries of a language and then
    all that passes by there. A block is a folder of a stored table, the corpus of a language
    another, so a task reads them one after the other and nothing is dealt."""
    spark = searches[0].held.sparkSession
    held, passing = searches[0].held, searches[0].passing
    for s in searches[1:]:
        held, passing = held.unionAll(s.held), passing.unionAll(s.passing)
    many = {True: held.groupBy("language").agg(F.count_distinct("row_id").alias("n")),
            False: passing.groupBy("language").agg(F.sum(F.coalesce("n_names", F.lit(1))).alias("n"))}
    many = {side: {r.language: r.n for r in df.collect()} for side, df in many.items()}
    both = sorted(set(many[True]) & set(many[False]), key=lambda l: -many[False][l])
    cores, work = spark.sparkContext.defaultParallelism, sum(many[True][l] * many[False][l] for l in both)
    most = max(s.k for s in searches)
    blocks = {}
    for language in both:
        large = max(1, min(QUERY_ROWS, MOST_KEPT // most))
        alike = work // (TASKS * cores * max(1, many[False][language]))
        rows = searches[0].q_rows or min(large, max(LEAST_QUERY_ROWS, alike))
        blocks[language] = max(1, -(-many[True][language] // rows))
    places = spark.createDataFrame([(l, i, blocks[l]) for i, l in enumerate(both)], "language string, place int, n_blocks int")

    def table(df, block, name):
        """A stored table with a folder for each place and block."""
        path = new_path(spark, name)
        df = df.join(F.broadcast(places), "language").withColumn("block", block).drop("n_blocks")
        df = df.repartition("place", "block") if name == "blocks" else df
        before = spark.conf.get(FREE_SHUFFLES, "false")
        spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.partitionBy("place", "block").parquet(path)
        finally:
            spark.conf.set(FREE_SHUFFLES, before)
        return spark.read.schema(df.schema).parquet(path)

    if not both:
        return spark.createDataFrame([], schema)
    held = table(held, F.pmod(F.xxhash64("row_id"), "n_blocks").cast("int"), "blocks")
    passing = table(passing, F.lit(0), "passing")
    # Spark puts the partitions of a union in one where each side has one only; a table without rows keeps them apart.
    tasks = [held.filter("place < 0").drop("place", "block")]
    for i, language in enumerate(both):
        corpus = passing.filter(F.col("place") == i)
        for block in range(blocks[language]):
            tasks.append(held.filter((F.col("place") == i) & (F.col("block") == block)).unionAll(corpus).drop("place", "block").coalesce(1))
    while len(tasks) > 1:
        tasks = [a.unionAll(b) for a, b in zip(tasks[::2], tasks[1::2])] + tasks[len(tasks) // 2 * 2:]
    # Each partition is one task's rows as they are: what is held, then what passes in order of its id.
    return tasks[0].sortWithinPartitions("side", "part", F.desc("row_id")).mapInArrow(run, schema)


def _makers(*searches: Search) -> dict[int, tuple[int, Callable]]:
    return {s.sides[1]: (s.sides[0], s.best) for s in searches}


def _bests(makers: dict[int, tuple[int, Callable]], batches) -> Iterator[tuple[str, dict[int, tuple[pa.Array, Deep]]]]:
    """The language of a task, and by held side the ids of the held rows and their best.
    `makers`: by passing side the held one and what makes the best."""
    language, held, best = None, {}, {}

    def of_side(side):
        return pa.Table.from_batches(held[side]).combine_chunks()

    waiting = runs(batches, ["language"])
    ahead = next(waiting, None)
    while ahead is not None:
        (language,), side, rows = ahead
        if side not in makers:
            held.setdefault(side, []).append(rows)
            ahead = next(waiting, None)
            continue

        def passing(side=side):
            nonlocal ahead
            while ahead is not None and ahead[1] == side:
                yield ahead[2]
                ahead = next(waiting, None)

        (own, make), rest = makers[side], passing()
        if own in held:
            mine = of_side(own)
            best[own] = mine.column("row_id").combine_chunks(), make(mine, rest)
        for _ in rest:
            pass
    if best:
        yield language, best


def _leaving(language: str, columns: list[str], parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (query ids, document ids, numbers) of many queries as few batches."""
    waiting, n = [], 0

    def batch():
        q, d, *numbers = zip(*waiting)
        return pa.RecordBatch.from_arrays(
            [pa.array([language] * n, pa.string()), pa.concat_arrays(q), pa.concat_arrays(d), *[pa.array(np.concatenate(x)) for x in numbers]], columns)

    for part in parts:
        waiting.append(part)
        n += len(part[0])
        if n >= LEAVING:
            yield batch()
            waiting, n = [], 0
    if n:
        yield batch()


def _searched_run(search: Search) -> DataFrame:
    """The ranked run of one search."""
    makers = _makers(search)

    def ranked(batches):
        for language, best in _bests(makers, batches):
            (ids, found), = best.values()
            names = found.names()

            def parts():
                for q in range(found.n):
                    name, score = found.of(q)
                    yield (ids.take(pa.array(np.full(len(name), q))), names.take(pa.array(name)), score, np.arange(1, len(name) + 1, dtype=np.int32))

            yield from _leaving(language, ["language", "query_id", "doc_id", "score", "rank"], parts())

    return _in_one_task([search], ranked, _RUN + ", rank int")


def _bm25_search(queries: DataFrame, corpus: DataFrame, k: int, k1: float, b: float, q_rows: int | None, d_rows: int | None) -> Search:
    """Questions against pieces of an inverted index. Texts are dealt once, in order of
    their ids, and cut into words where they are indexed."""
    most, n, cores = d_rows or CHUNK_DOCS, corpus.count(), corpus.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // most), min(cores, -(-n // LEAST_INDEXED)))

    def pieces(batches):
        yield from indexed(batches, most, TaskContext.get().partitionId())

    there = corpus.filter("language IS NOT NULL").select("language", F.col("doc_id").cast("string").alias("doc_id"), "text")
    order = ["language", F.desc("doc_id")]
    pieces = stored(_terms(there.repartitionByRange(parts, *order).sortWithinPartitions(*order), "doc_id").mapInArrow(pieces, PIECE), "index")
    sizes = pieces.select("language", F.explode("doc_len").alias("doc_len")).groupBy("language").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    df = pieces.select("language", F.explode(F.arrays_zip("codes", "sizes")).alias("t")).select("language", "t.*").groupBy(
        "language", F.col("codes").alias("code")).agg(F.sum("sizes").alias("df"))
    weighted = stored(_weighted(queries, df, sizes), "query-terms")

    def best(held, passing):
        mine = Queries(held)
        found = Deep(mine.n, k)
        for batch in passing:
            for i in range(batch.num_rows):
                names, doc_len, codes, sizes, width = (batch.column(c)[i].values for c in ("names", "doc_len", "codes", "sizes", "bytes"))
                avg_len = batch.column("avg_len")[i].as_py()
                chunk = Chunk.of_piece(
                    mine, {"n_names": len(names), "codes": codes.to_numpy(), "sizes": sizes.to_numpy(), "doc_len": doc_len.to_numpy(zero_copy_only=False),
                           "bytes": width.to_pylist(), **{c: batch.column(c)[i].as_buffer() for c in ("docs", "counts")}},
                    lambda size: k1 * ((1 - b) + b * size / (avg_len or 1.0)))
                found.open(names)
                for q, docs, scores in chunk.above(mine, np.arange(mine.n), found.limit, k):
                    found.add(q, docs, np.round(scores, SCORE_DIGITS))
        return found

    return Search.of(weighted.withColumnRenamed("query_id", "row_id"), pieces.join(F.broadcast(sizes), "language"), (_ASKED, _PIECES), k, q_rows, best)


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, k1: float = 0.9,
              b: float = 0.4, q_rows: int | None = None, d_rows: int | None = None, judged: DataFrame | None = None,
              run: bool = True) -> DataFrame | Search:
    """queries (language, query_id, text), corpus (language, doc_id, text) to the
    first k documents with a common term.

    A task reads the lists of its queries' terms in one piece of an inverted index after
    the other. Without `run` the ranking is not run but given as a Search, to be fused.

    With `judged` (language, query_id, doc_id) only the rows of these pairs leave, each
    with its rank among all documents, if that is k at most. Nothing is kept for a query
    then but the number of documents before its judged ones, and a judged document with k
    before it is settled: later rounds, over more and more documents, leave it out."""
    if judged is None:
        search = _bm25_search(queries, corpus, k, k1, b, q_rows, d_rows)
        return _searched_run(search) if run else search
    weighted, postings = _postings(queries, corpus)
    length = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("doc_len") / F.col("avg_len"))
    documents = postings.select(
        "language", "doc_id", "codes", length.alias("length"), F.pmod(F.xxhash64("doc_id"), "n_docs").alias("place"), "n_docs")
    return _places(weighted, documents, judged, k, q_rows, d_rows)


def _places(weighted: DataFrame, documents: DataFrame, judged: DataFrame, k: int, q_rows: int | None, d_rows: int | None) -> DataFrame:
    """Score and rank of judged documents among the first k of their queries."""

    def scored(batches):
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            columns = [batch.column(c) for c in ("q_codes", "weights", "codes", "length")]
            for i in range(batch.num_rows):
                q_codes, weights, codes = (c[i].values.to_numpy() for c in columns[:3])
                known, tf = np.unique(codes, return_counts=True)
                if len(known):
                    at = np.minimum(np.searchsorted(known, q_codes), len(known) - 1)
                    there = known[at] == q_codes
                    tf = tf[at[there]]
                    scores[i] = np.sum(weights[there] * (tf / (tf + columns[3][i].as_py())))
            scores = np.round(scores, SCORE_DIGITS)
            rows = pa.RecordBatch.from_arrays([batch.column(c) for c in ("language", "query_id", "doc_id")] + [pa.array(scores)], ["language", "query_id", "doc_id", "score"])
            yield rows.filter(pa.array(scores > 0))

    keys = ["language", "query_id", "doc_id"]
    open_rows = stored(
        judged.select(*keys).distinct()
        .join(weighted.withColumnRenamed("codes", "q_codes"), ["language", "query_id"]).join(documents, ["language", "doc_id"])
        .select(*keys, "q_codes", "weights", "codes", "length").mapInArrow(scored, _RUN)
        .withColumn("before", F.lit(0).cast("long")), "judged")

    def search(held, passing):
        mine = Queries(held)
        lists = held.column("targets").combine_chunks()
        of = np.repeat(np.arange(mine.n), np.diff(lists.offsets.to_numpy()))
        first = np.searchsorted(of, np.arange(mine.n + 1))
        doc_id, score, known = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "score", "before"))
        before = known.copy()
        for names, chunk in chunks(mine, passing):
            floor = np.full(mine.n, np.inf)
            np.minimum.at(floor, of, np.where(before < k, score, np.inf))
            rows = np.flatnonzero(np.isfinite(floor))
            if not len(rows):
                break
            for q, docs, scores in chunk.above(mine, rows, floor):
                for t in range(first[q], first[q + 1]):
                    before[t] += np.count_nonzero(scores > score[t] + NEAR)
                    near = np.flatnonzero(np.abs(scores - score[t]) <= NEAR)
                    for name, s in zip(names[docs[near]], np.round(scores[near], SCORE_DIGITS)):
                        # A missing id comes last.
                        before[t] += name != doc_id[t] and bool(s > score[t] or (s == score[t] and name is not None and name > doc_id[t]))
        own = [held.column(c).combine_chunks().take(pa.array(of)) for c in ("language", "row_id")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(doc_id, pa.string()), pa.array(score), pa.array(np.minimum(before, k) - known)],
                                         ["language", "query_id", "doc_id", "score", "before"])

    kind = "array<struct<doc_id:string,score:double,before:bigint>>"
    passing = documents.withColumn("weights", F.array().cast("array<double>")).withColumn("targets", F.array().cast(kind))
    most = documents.agg(F.max("n_docs")).first()[0] or 0
    start, end = 0, max(FIRST_ROWS, FIRST_TIMES * k)
    while start < most:
        # A part of each language by the hash of the id; all parts together are all documents.
        part = passing.filter(F.col("place").between(start, end - 1)).drop("place", "n_docs")
        targets = open_rows.groupBy("language", "query_id").agg(F.collect_list(F.struct("doc_id", "score", "before")).cast(kind).alias("targets"))
        queries = weighted.join(targets, ["language", "query_id"]).withColumn("length", F.lit(0.0))
        found = _searched(queries, part, _block_counts(queries, part, 1, q_rows, d_rows), search, _RUN + ", before long")
        open_rows = stored(
            open_rows.unionByName(found).groupBy(*keys).agg(F.max("score").alias("score"), F.sum("before").alias("before"))
            .filter(F.col("before") < k), "judged")
        start, end = end, end * WIDER
    return open_rows.select(*keys, "score", (F.col("before") + 1).cast("int").alias("rank"))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def dense_hits(queries: DataFrame, corpus: DataFrame, k: int, q_rows: int | None = None, d_rows: int | None = None) -> DataFrame:
    """The k nearest documents of each query in every part of the corpus."""

    def search(held, passing):
        mine = _unit(matrix(held.column("embedding")))
        best = Best(len(held), k)
        rows = max(1, MOST_SCORES // len(held))
        for batch in passing:
            names = batch.column("row_id").to_numpy(zero_copy_only=False)
            for start in range(0, batch.num_rows, rows):
                scores = mine @ _unit(matrix(batch.column("embedding").slice(start, rows))).T
                q, d = np.nonzero(scores > best.limit[:, None] - 10.0 ** -SCORE_DIGITS)
                best.add(names[start:start + rows], q, d, np.round(scores[q, d], SCORE_DIGITS))
        yield from _found(held, best)

    counts = _block_counts(queries, corpus, k, q_rows, d_rows)
    kind = "array<double>"
    return _searched(queries.select("language", "query_id", F.col("embedding").cast(kind).alias("embedding")),
                     corpus.select("language", "doc_id", F.col("embedding").cast(kind).alias("embedding")), counts, search, _RUN)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 1000,
               q_rows: int | None = None, d_rows: int | None = None, run: bool = True) -> DataFrame | Search:
    """queries (language, query_id, embedding), corpus (language, doc_id, embedding)
    to the k nearest documents by cosine. Without `run` the ranking is given as a Search."""
    if run:
        return _ranked(dense_hits(queries, corpus, k, q_rows, d_rows), k)

    def best(held, passing):
        mine = _unit(matrix(held.column("embedding")))
        found = Deep(len(held), k, -np.inf)
        rows = max(1, MOST_SCORES // len(held))
        for batch in passing:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                found.open(part.column("row_id"))
                scores = mine @ _unit(matrix(part.column("embedding"))).T
                for q in np.flatnonzero(scores.max(axis=1) > found.limit - 10.0 ** -SCORE_DIGITS).tolist():
                    docs = np.flatnonzero(scores[q] > found.limit[q] - 10.0 ** -SCORE_DIGITS)
                    found.add(q, docs, np.round(scores[q, docs], SCORE_DIGITS))
        return found

    embedding = F.col("embedding").cast("array<double>").alias("embedding")
    return Search.of(queries.select("language", F.col("query_id").alias("row_id"), embedding),
                     corpus.select("language", F.col("doc_id").alias("row_id"), embedding), (_NEAREST, _VECTORS), k, q_rows, best)


def _fused(s: tuple[np.ndarray, np.ndarray], d: tuple[np.ndarray, np.ndarray], weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Names and scores, best first, of both runs of a query (names and scores, best first).
    Of a document named twice in a run, the last rank and the larger score count."""
    if not len(d[0]):
        return s[0], np.zeros(len(s[0]))
    names, at = np.unique(np.concatenate((s[0], d[0])), return_inverse=True)
    best, last = [], []
    for (name, score), own in zip((s, d), (at[:len(s[0])], at[len(s[0]):])):
        most, rank = np.full(len(names), -np.inf), np.full(len(names), -1.0)
        np.maximum.at(most, own, score)
        np.maximum.at(rank, own, np.arange(len(own)))
        best.append(most)
        last.append(np.where(rank < 0, np.inf, rank))
    both = np.isfinite(last[0]) & np.isfinite(last[1])
    score = np.zeros(len(names))
    score[both] = weight * best[1][both] + best[0][both]
    order = np.lexsort((last[1], last[0], -score))
    return names[order], score[order]


def _fused_searches(sparse: Search, dense: Search, weight: float) -> DataFrame:
    """`hybrid_scores` where both searches run: a task holds the questions of both."""
    nothing = np.zeros(0, np.int64), np.zeros(0)
    sides, depths, makers = [s.sides[0] for s in (sparse, dense)], (sparse.k, dense.k), _makers(sparse, dense)

    def fused(batches):
        for language, best in _bests(makers, batches):
            # Names of both runs as places in one list, rows of equal questions together.
            lists = [best[s][1].names() if s in best else pa.array([], pa.string()) for s in sides]
            names = pa.concat_arrays(lists).dictionary_encode(null_encoding="encode")
            place = names.indices.to_numpy()
            places = place[:len(lists[0])], place[len(lists[0]):]
            rows = {}
            for i, s in enumerate(sides):
                for row, q in enumerate(best[s][0].to_pylist() if s in best else ()):
                    rows.setdefault(q, ([], []))[i].append(row)

            def run(i, own):
                found = [best[sides[i]][1].of(row) for row in own]
                if not found:
                    return nothing
                name, score = (np.concatenate(x) for x in zip(*found))
                if len(found) > 1:
                    order = np.lexsort((name, -score))[:depths[i]]
                    name, score = name[order], score[order]
                return places[i][name], score

            def parts():
                for q, own in rows.items():
                    name, score = _fused(run(0, own[0]), run(1, own[1]), weight)
                    yield (pa.array([q], pa.string()).take(pa.array(np.zeros(len(name), np.int64))), names.dictionary.take(pa.array(name)),
                           score, np.arange(1, len(name) + 1, dtype=np.int32))

            yield from _leaving(language, ["language", "query_id", "doc_id", "score", "rank"], parts())

    return _in_one_task([sparse, dense], fused, _RUN + ", rank int")


def hybrid_scores(sparse: DataFrame | Search, dense: DataFrame | Search,
                  weight: float = C.DENSE_WEIGHT) -> DataFrame:
    """Union of two ranked runs: weighted sum where both found the document, else
    0. Ties keep the sparse order, then the dense one, in `rank`. Two searches are run
    together, and their hits are fused where they are found."""
    if isinstance(sparse, Search):
        return _fused_searches(sparse, dense, weight)
    keys = ["language", "query_id", "doc_id"]

    def side(run, own, other):
        null = {f"{other}_score": F.lit(None).cast("double"), f"{other}_rank": F.lit(None).cast("int")}
        return run.select(*keys, F.col("score").alias(f"{own}_score"), F.col("rank").alias(f"{own}_rank")).withColumns(null)

    # One exchange by query serves the meeting of both runs and the order of the result.
    both = F.col("s_score").isNotNull() & F.col("d_score").isNotNull()
    fused = (
        side(sparse, "s", "d").unionByName(side(dense, "d", "s")).repartition("language", "query_id")
        .groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("s_score", "s_rank", "d_score", "d_rank")])
        .withColumn("score", F.when(both, F.lit(weight) * F.col("d_score") + F.col("s_score")).otherwise(F.lit(0.0)))
    )
    order = Window.partitionBy("language", "query_id").orderBy(
        F.desc("score"), F.asc_nulls_last("s_rank"), F.asc_nulls_last("d_rank")
    )
    return fused.withColumn("rank", F.row_number().over(order)).select(*keys, "score", "rank")


def top_unique(hits: DataFrame, k: int = 10) -> DataFrame:
    """First k distinct documents of a ranked list that may name one twice."""
    keys = ["language", "query_id", "doc_id"]
    first = hits.groupBy(*keys).agg(
        F.min("rank").alias("first_rank"), F.max("score").alias("score")
    )
    order = Window.partitionBy("language", "query_id").orderBy("first_rank", F.desc("doc_id"))
    return (
        first.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .drop("first_rank")
    )
