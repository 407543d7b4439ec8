"""Ranking and metrics."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from qaweave.operators import metrics as M
from qaweave.operators import postings
from qaweave.operators import ranking as R
from qaweave.operators import streams
from qaweave.plans import evaluate as V

RUN = "language string, query_id string, doc_id string, score double"
QRELS = "language string, query_id string, doc_id string, score int"
RANKED = RUN + ", rank int"


def in_order(run, k):
    order = Window.partitionBy("language", "query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return run.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def value(df):
    return round(df.first().value, 6)


def test_ndcg_by_hand(spark):
    run = spark.createDataFrame([("e", "q", f"d{i}", 10.0 - i) for i in range(10)], RUN)
    qrels = spark.createDataFrame([("e", "q", "d2", 1)], QRELS)
    ranked = in_order(run, 10)
    assert value(M.ndcg_at_k(run, qrels)) == 0.5
    assert value(M.ndcg_gold_reordered(ranked, qrels)) == 1.0
    missing = spark.createDataFrame([("e", "q", "other", 1)], QRELS)
    assert value(M.ndcg_at_k(run, missing)) == 0.0
    assert value(M.ndcg_gold_reordered(ranked, missing)) == 0.0


def test_query_without_hits_counts_as_zero(spark):
    run = spark.createDataFrame([("e", "q1", "d", 1.0)], RUN)
    qrels = spark.createDataFrame([("e", "q1", "d", 1), ("e", "q2", "d", 1)], QRELS)
    values = M.cutoff_metrics(run, qrels, (1, 10))
    means = {(r.metric, r.k): r.value for r in M.mean_metric(values).collect()}
    assert {means[(m, 1)] for m in ("map", "mrr", "recall", "precision", "ndcg")} == {0.5}
    assert means[("precision", 10)] == 0.05


def test_ideal_run_is_one(spark):
    rng = np.random.default_rng(4)
    judged = [("e", f"q{q}", f"d{d}", int(rng.integers(0, 4))) for q in range(5) for d in range(12)]
    qrels = spark.createDataFrame(judged, QRELS)
    run = qrels.selectExpr("language", "query_id", "doc_id", "CAST(score AS double) AS score")
    assert {round(r.value, 9) for r in M.ndcg_at_k(run, qrels, (3, 10)).collect()} == {1.0}


def test_gold_reordering_is_never_worse(spark):
    rng = np.random.default_rng(5)
    qrels = spark.createDataFrame(
        [("e", f"q{q}", f"d{d}", int(rng.integers(0, 3))) for q in range(6) for d in range(0, 20, 2)], QRELS)
    run = spark.createDataFrame(
        [("e", f"q{q}", f"d{d}", float(rng.random())) for q in range(6) for d in range(20)], RUN)
    plain = {r.query_id: r.value for r in M.ndcg_at_k(run, qrels).collect()}
    gold = {r.query_id: r.value for r in M.ndcg_gold_reordered(in_order(run, 1000), qrels).collect()}
    assert all(gold[q] >= plain[q] - 1e-12 for q in plain)


def test_hybrid_by_hand(spark, rows):
    sparse = spark.createDataFrame([("e", "q", "d1", 2.0, 1), ("e", "q", "d2", 1.0, 2)], RANKED)
    dense = spark.createDataFrame([("e", "q", "d3", 0.9, 1), ("e", "q", "d2", 0.5, 2)], RANKED)
    fused = R.hybrid_scores(sparse, dense)
    assert [(r.doc_id, round(r.score, 6)) for r in fused.orderBy("rank").collect()] == [
        ("d2", 1.55), ("d1", 0.0), ("d3", 0.0)]


def test_top_unique(spark):
    hits = spark.createDataFrame([("e", "q", d, 1.0, i) for i, d in enumerate("abacbd")], RANKED)
    top = R.top_unique(hits, 3).orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in top] == [("a", 1), ("b", 2), ("c", 3)]


def brute_bm25(queries, docs, k):
    out = set()
    for language in {d[0] for d in docs}:
        mine = [(i, re.findall(r"\w+", t.lower())) for l, i, t in docs if l == language]
        avg = sum(len(t) for _, t in mine) / len(mine)
        for l, query, text in queries:
            if l != language:
                continue
            scored = []
            for doc, tokens in mine:
                score = 0.0
                for term in re.findall(r"\w+", text.lower()):
                    df = sum(term in t for _, t in mine)
                    tf = tokens.count(term)
                    if tf:
                        score += math.log(1 + (len(mine) - df + 0.5) / (df + 0.5)) * tf / (
                            tf + 0.9 * (0.6 + 0.4 * len(tokens) / avg))
                if score:
                    scored.append((round(score, 9), doc))
            best = sorted(scored, reverse=True)[:k]
            out |= {(l, query, d, round(s, 6), n + 1) for n, (s, d) in enumerate(best)}
    return out


@pytest.mark.parametrize("q_rows, d_rows", [(1000, 1000), (2, 5), (3, 1), (None, None)])
def test_bm25_for_every_block_size(spark, q_rows, d_rows):
    rng = np.random.default_rng(6)
    words = ["the"] * 6 + ["alpha", "beta", "gamma", "delta", "straße", "x1"]
    docs = [(l, f"{l}{i}", " ".join(rng.choice(words, int(rng.integers(1, 9)))))
            for l in ("e", "f") for i in range(17)]
    queries = [(l, f"q{i}", " ".join(rng.choice(words[4:], 3)) + " Alpha") for l in ("e", "f") for i in range(5)]
    out = R.bm25_topk(
        spark.createDataFrame(queries, "language string, query_id string, text string"),
        spark.createDataFrame(docs, "language string, doc_id string, text string"), 4,
        q_rows=q_rows, d_rows=d_rows)
    got = {(r.language, r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in out.collect()}
    assert got == brute_bm25(queries, docs, 4)


@pytest.mark.parametrize("q_rows, d_rows", [(1000, 1000), (3, 4), (1, 15), (None, None)])
def test_dense_for_every_block_size(spark, q_rows, d_rows):
    rng = np.random.default_rng(7)
    q, d = rng.integers(-2, 3, (7, 4)) + 0.5, rng.integers(-2, 3, (15, 4)) + 0.5
    out = R.dense_topk(
        spark.createDataFrame([("e", f"q{i}", v.tolist()) for i, v in enumerate(q)], "language string, query_id string, embedding array<float>"),
        spark.createDataFrame([("e", f"d{i:02}", v.tolist()) for i, v in enumerate(d)], "language string, doc_id string, embedding array<float>"),
        5, q_rows, d_rows)
    norm = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(norm(q) @ norm(d).T, 9)
    want = set()
    for i in range(7):
        order = sorted(range(15), key=lambda j: (s[i, j], f"d{j:02}"), reverse=True)[:5]
        want |= {(f"q{i}", f"d{j:02}", n + 1) for n, j in enumerate(order)}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in out.collect()} == want


def test_evaluation_tables(spark):
    text = spark.createDataFrame([("e", "1", "alpha beta"), ("e", "2", "gamma")], "language string, id string, text string")
    queries, corpus = text.withColumnRenamed("id", "query_id"), text.withColumnRenamed("id", "doc_id")
    qrels = spark.createDataFrame([("e", "1", "1", 1), ("e", "2", "2", 1)], QRELS)
    sparse = V.evaluate_sparse(queries, corpus, qrels, "own").collect()
    assert [(r.task, r.language, r.model, r.value) for r in sparse] == [("own", "e", "bm25", 1.0)]
    vectors = spark.createDataFrame([("e", "1", [1.0, 0.0]), ("e", "2", [0.0, 1.0])], "language string, id string, embedding array<float>")
    q, d = vectors.withColumnRenamed("id", "query_id"), vectors.withColumnRenamed("id", "doc_id")
    dense = V.evaluate_dense(q, d, qrels, "own", "m", 10)
    assert dense.filter("metric = 'ndcg' and k = 10").first().value == 1.0 and dense.count() == 35
    hybrid = V.evaluate_hybrid(R.bm25_topk(queries, corpus), R.dense_topk(q, d, 10), qrels, "own")
    assert hybrid.first().value == 1.0
    old = dense.withColumn("value", dense.value * 0)
    assert M.upsert_results(old, dense).filter("metric = 'ndcg' and k = 10").first().value == 1.0


def test_running_best_keeps_k_rows():
    """What a task holds and gives back is at most k rows a query, whatever passes."""
    rng = np.random.default_rng(1)
    scores = np.round(rng.random((7, 5000)), 2)
    for width in (1, 37, 5000):
        best = streams.Best(7, 10)
        for a in range(0, 5000, width):
            part = scores[:, a:a + width]
            q, d = np.nonzero(part > best.limit[:, None] - 1e-9)
            best.add(np.array([f"d{i}" for i in range(a, a + part.shape[1])], object), q, d, part[q, d])
            assert best._size <= 2 * 10 * 7 + 7 * width and len(best.names) <= best._size
        row, name, score = best.found()
        want = [(i, f"d{j}") for i in range(7) for j in sorted(range(5000), key=lambda j: (-scores[i, j], j))[:10]]
        assert list(zip(row, name)) == want and len(score) == 70


def test_rows_that_leave_a_task(spark):
    """k rows for each query and part, not for each batch of documents."""
    v = np.random.default_rng(2).random((400, 4))
    kind = "language string, {}_id string, embedding array<double>"
    q = spark.createDataFrame([("e", f"q{i}", x.tolist()) for i, x in enumerate(v[:10])], kind.format("query"))
    d = spark.createDataFrame([("e", f"d{i}", x.tolist()) for i, x in enumerate(v)], kind.format("doc"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        for d_rows, parts in ((1000, 1), (200, 2), (50, 8)):
            assert R.dense_hits(q, d, 5, 10, d_rows).count() == 10 * parts * 5
            assert R.dense_topk(q, d, 5, 10, d_rows).count() == 50
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("q_rows, d_rows, k", [(1000, 1000, 4), (2, 5, 4), (None, None, 100)])
def test_judged_rows_have_their_rank_in_the_run(spark, rows, q_rows, d_rows, k):
    """The judged rows of the full run, ties, strangers and repeated judgements included."""
    rng = np.random.default_rng(8)
    words = ["the"] * 4 + ["alpha", "beta", "gamma"]
    docs = [(l, f"{l}{i}", " ".join(rng.choice(words, int(rng.integers(1, 4))))) for l in ("e", "f") for i in range(23)]
    docs.append(("e", None, "alpha beta"))
    queries = [(l, f"q{i}", " ".join(rng.choice(words, 3))) for l in ("e", "f") for i in range(6)] + [("e", None, "beta")]
    judged = [(l, f"q{i}", f"{l}{int(d)}", 1) for l in ("e", "f") for i in range(7) for d in rng.integers(0, 26, 9)]
    q = spark.createDataFrame(queries, "language string, query_id string, text string")
    d = spark.createDataFrame(docs, "language string, doc_id string, text string")
    qrels = spark.createDataFrame(judged, QRELS)
    columns = ("language", "query_id", "doc_id", F.round("score", 6), "rank")
    full = R.bm25_topk(q, d, k, q_rows=q_rows, d_rows=d_rows).join(qrels.drop("score").distinct(), ["language", "query_id", "doc_id"], "left_semi")
    got = R.bm25_topk(q, d, k, q_rows=q_rows, d_rows=d_rows, judged=qrels)
    assert rows(got, *columns) == rows(full, *columns) != []


@pytest.mark.parametrize("k", [2, 10])
def test_settled_rows_leave_the_later_rounds(spark, rows, monkeypatch, k):
    """Ranks over three rounds of documents are those of the run; a judged row with k
    documents before it is not counted on, and no judged row is lost."""
    rng = np.random.default_rng(10)
    words = ["the"] * 4 + ["alpha", "beta", "gamma", "delta"]
    docs = [(l, f"{l}{i}", " ".join(rng.choice(words, int(rng.integers(1, 6))))) for l, n in (("e", 60), ("f", 3)) for i in range(n)]
    queries = [(l, f"q{i}", " ".join(rng.choice(words, 3))) for l in ("e", "f") for i in range(9)]
    judged = [(l, f"q{i}", f"{l}{int(d)}", 1) for l, n in (("e", 60), ("f", 3)) for i in range(9) for d in rng.integers(0, n, 6)]
    q = spark.createDataFrame(queries, "language string, query_id string, text string")
    d = spark.createDataFrame(docs, "language string, doc_id string, text string")
    qrels = spark.createDataFrame(judged, QRELS)
    passed, searched = [], R._searched
    monkeypatch.setattr(R, "_searched", lambda queries, corpus, *a: passed.append((queries.count(), corpus.count())) or searched(queries, corpus, *a))
    full = R.bm25_topk(q, d, k).join(qrels.drop("score").distinct(), ["language", "query_id", "doc_id"], "left_semi")
    columns = ("language", "query_id", "doc_id", F.round("score", 6), "rank")
    want = rows(full, *columns)
    passed.clear()
    monkeypatch.setattr(R, "FIRST_ROWS", 5)
    monkeypatch.setattr(R, "FIRST_TIMES", 1)
    monkeypatch.setattr(R, "WIDER", 4)
    assert rows(R.bm25_topk(q, d, k, judged=qrels), *columns) == want != []
    assert len(passed) >= 2 and sum(n for _, n in passed) == 63
    if k == 2:
        assert passed[-1][0] < passed[0][0]


@pytest.mark.parametrize("odd", [0, 5])
def test_sparse_evaluation_moves_judged_rows_only(spark, monkeypatch, odd):
    """The published score over the whole run, from a run that returns judged rows alone;
    whole runs only of queries that judge a document both above 0 and not."""
    text = [("e", f"{i}", " ".join("abcdefg"[j] * 2 for j in range(7) if (i + 3) >> j & 1)) for i in range(40)]
    q = spark.createDataFrame(text, "language string, query_id string, text string")
    d = spark.createDataFrame(text, "language string, doc_id string, text string")
    judged = [("e", f"{i}", f"{(i + j) % 40}", s) for i in range(40) for j, s in ((0, 2), (2, 1), (2, 1), (7, 0), (11, -1))]
    qrels = spark.createDataFrame(judged + [("e", f"{i}", f"{i + 2}", -(i % 2)) for i in range(odd)], QRELS)
    want = M.mean_metric(M.ndcg_gold_reordered(R.bm25_topk(q, d, 10), qrels)).first().value
    kept, topk = [], R.bm25_topk
    monkeypatch.setattr(R, "bm25_topk", lambda *a, **b: kept.append(topk(*a, **b)) or kept[-1])
    assert V.evaluate_sparse(q, d, qrels, "own").first().value == pytest.approx(want, abs=1e-12) and want > 0
    assert kept[0].join(qrels, ["language", "query_id", "doc_id"], "left_anti").count() == 0
    assert [run.select("query_id").distinct().count() for run in kept[1:]] == [odd] * (odd > 0)


def test_documents_that_reach_the_floor():
    """Scores of a chunk's documents against plain sums, for floors low and high."""
    rng = np.random.default_rng(9)
    codes = [np.sort(rng.choice(np.concatenate((np.repeat(np.arange(4), 30), np.arange(4, 90))), 40)) for _ in range(300)]
    own = [rng.choice(100, 12, replace=False) for _ in range(5)]
    weights = [rng.random(12) for _ in own]
    held = postings.pa.table({"codes": [x.tolist() for x in own], "weights": [x.tolist() for x in weights]})
    batch = postings.pa.RecordBatch.from_pydict({"row_id": [f"d{i}" for i in range(300)], "codes": [c.tolist() for c in codes], "length": [1.5] * 300})
    mine = postings.Queries(held)
    (names, chunk), = postings.chunks(mine, iter([batch]))
    share = lambda c, t: (c == t).sum() / ((c == t).sum() + 1.5)
    want = np.array([[sum(w * share(c, t) for t, w in zip(own[q], weights[q])) for c in codes] for q in range(5)])
    assert chunk.n == len(names) == 300 and 0 < len(chunk.matrix) < 90
    for floor in (0.0, np.median(want), np.sort(want.reshape(-1))[-3]):
        found = {q: (docs, scores) for q, docs, scores in chunk.above(mine, np.arange(5), np.full(5, floor))}
        for q in range(5):
            assert found[q][0].tolist() == np.flatnonzero((want[q] >= floor) & (want[q] > 0)).tolist()
            assert np.allclose(found[q][1], want[q][found[q][0]])


def test_running_best_is_lean_and_leaves_in_parts(monkeypatch):
    monkeypatch.setattr(streams.Best, "WAITING", 50)
    monkeypatch.setattr(streams.Best, "AT_ONCE", 64)
    best, scores = streams.Best(20, 10), np.random.default_rng(3).random((20, 400))
    for a in range(0, 400, 4):
        q, d = np.nonzero(scores[:, a:a + 4] > best.limit[:, None])
        best.add(np.array([f"d{i}" for i in range(a, a + 4)], object), q, d, scores[:, a:a + 4][q, d])
        assert best._size - best._kept <= 50 + 80
    assert best._score.nbytes + best._name.nbytes == 12 * 10 * 20
    parts = list(best.parts())
    assert max(len(x[0]) for x in parts) <= 64 and len(parts) > 1
    want = [(i, f"d{j}") for i in range(20) for j in np.argsort(-scores[i])[:10]]
    assert [(int(q), n) for row, name, _ in parts for q, n in zip(row, name)] == want


def test_ndcg_of_a_run_of_judged_rows(spark, rows):
    """nDCG at cutoffs over the whole run, from the judged rows of it and their ranks."""
    rng = np.random.default_rng(11)
    words = ["the"] * 4 + ["alpha", "beta", "gamma", "delta"]
    docs = [(l, f"{l}{i}", " ".join(rng.choice(words, int(rng.integers(1, 6))))) for l in ("e", "f") for i in range(30)]
    queries = [(l, f"q{i}", " ".join(rng.choice(words, 3))) for l in ("e", "f") for i in range(8)]
    judged = [(l, f"q{i}", f"{l}{int(d)}", int(s)) for l in ("e", "f") for i in range(9) for d, s in zip(rng.integers(0, 30, 9), rng.integers(-1, 4, 9))]
    q = spark.createDataFrame(queries, "language string, query_id string, text string")
    d = spark.createDataFrame(docs, "language string, doc_id string, text string")
    qrels = spark.createDataFrame(judged, QRELS)
    columns = ("language", "query_id", "k", F.round("value", 9))
    want = rows(M.ndcg_at_k(R.bm25_topk(q, d, 10), qrels, (3, 10)), *columns)
    run = R.bm25_topk(q, d, 10, judged=qrels)
    assert run.join(qrels, ["language", "query_id", "doc_id"], "left_anti").isEmpty()
    assert rows(M.ndcg_at_k(run, qrels, (3, 10), rank="rank"), *columns) == want != []


@pytest.mark.parametrize("q_rows, d_rows", [(None, None), (3, 5)])
def test_searches_fused_where_they_are_found(spark, rows, q_rows, d_rows):
    """Two searches fused in their tasks give the rows of two runs that are joined, with
    questions, documents and languages of one search only, ties and repeated rows; nothing
    is dealt after the search."""
    rng = np.random.default_rng(12)
    words = ["the"] * 4 + ["alpha", "beta", "gamma", "delta"]
    docs = [(l, f"{l}{i}", " ".join(rng.choice(words, int(rng.integers(1, 6))))) for l in ("e", "f", "g") for i in range(17)]
    docs += docs[3:5] + [("e", None, "alpha beta"), (None, "x", "alpha"), ("e", "y", None), ("e", "z", "")]
    queries = [(l, f"q{i}", " ".join(rng.choice(words, 3))) for l in ("e", "f", "h") for i in range(8)] + [("e", None, "beta"), ("e", "q1", "delta")]
    vectors = [(l, f"{l}{i}", x.tolist()) for l in ("e", "f", "h") for i, x in enumerate(rng.integers(-2, 3, (13, 4)) + 0.5)]
    asked = [(l, f"q{i}", x.tolist()) for l in ("e", "f", "g", "h") for i, x in enumerate(rng.integers(-2, 3, (10, 4)) + 0.5)]
    kind = "language string, {}_id string, {}"
    q, d = spark.createDataFrame(queries, kind.format("query", "text string")), spark.createDataFrame(docs, kind.format("doc", "text string"))
    vq = spark.createDataFrame(asked + asked[2:4], kind.format("query", "embedding array<float>"))
    vd = spark.createDataFrame(vectors, kind.format("doc", "embedding array<float>"))
    columns = ("language", "query_id", "doc_id", F.round("score", 6), "rank")
    runs = R.bm25_topk(q, d, 6, q_rows=q_rows, d_rows=d_rows), R.dense_topk(vq, vd, 7)
    fused = R.hybrid_scores(R.bm25_topk(q, d, 6, q_rows=q_rows, d_rows=d_rows, run=False), R.dense_topk(vq, vd, 7, q_rows=q_rows, run=False))
    assert rows(fused, *columns) == rows(R.hybrid_scores(*runs), *columns) != []
    for df in (fused, runs[0]):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width", [1, 37, 5000])
def test_deep_best_of_one_row_at_a_time(width):
    """Best rows with ties in the order they came, names of rows that went let go."""
    scores = np.round(np.random.default_rng(1).random((7, 5000)), 2)
    best = streams.Deep(7, 10)
    for a in range(0, 5000, width):
        best.open(postings.pa.array([f"d{i}" for i in range(a, min(5000, a + width))]))
        for q in range(7):
            part = scores[q, a:a + width]
            name = np.flatnonzero(part > best.limit[q])
            best.add(q, name, part[name])
    names = best.names().to_pylist()
    for q in range(7):
        name, score = best.of(q)
        want = sorted(range(5000), key=lambda j: (-scores[q, j], j))[:10]
        assert [names[i] for i in name] == [f"d{j}" for j in want] and score.tolist() == scores[q, want].tolist()


def test_names_of_a_deep_best_go():
    best = streams.Deep(1, 2)
    for i in range(40):
        best.open(postings.pa.array([f"{i}-{j}" for j in range(4000)]))
        best.add(0, np.array([7]), np.array([i + 1.0]))
    assert len(best.names()) < 75_000
    assert [best.names()[int(i)].as_py() for i in best.of(0)[0]] == ["39-7", "38-7"]


def test_pieces_of_an_index():
    """Words of each document in pieces of bounded size; rows of one id are one document."""
    rng = np.random.default_rng(13)
    codes = [rng.integers(0, 30, int(rng.integers(0, 20))).tolist() for _ in range(50)]
    ids = [f"{99 - i // 2 if i < 10 else 90 - i}" for i in range(50)]
    batch = postings.pa.RecordBatch.from_pydict({
        "language": ["e"] * 25 + ["f"] * 25, "doc_id": ids, "size": postings.pa.array([len(c) for c in codes], postings.pa.int32()),
        "codes": postings.pa.array(codes, postings.pa.list_(postings.pa.int64()))})
    pieces = [r for b in postings.indexed(iter([batch.slice(0, 7), batch.slice(7)]), 8, 3) for r in b.to_pylist()]
    assert [r["part"] for r in pieces] == [(3 << 32) + i for i in range(len(pieces))] and max(r["n_names"] for r in pieces) == 8
    want, got = {}, {}
    for l, i, c in zip(["e"] * 25 + ["f"] * 25, ids, codes):
        for t in c:
            want[l, i, t] = want.get((l, i, t), 0) + 1
    for r in pieces:
        n = sum(r["sizes"])
        doc, tf = (postings._unpacked(r[c], w, n) for c, w in zip(("docs", "counts"), r["bytes"]))
        for t, d, f in zip(np.repeat(r["codes"], r["sizes"]), doc, tf):
            assert got.setdefault((r["language"], r["names"][d], int(t)), int(f)) == f
    assert got == want and len({r["language"] for r in pieces}) == 2
