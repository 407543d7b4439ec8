"""Similarity, pairs and ordered operators against brute force on small data."""

import numpy as np
import pytest

from qaweave.operators import blocks, dedup, neardup, ordered, parallel, runs

VEC = "language string, scheme_host string, id string, question_embedding array<float>"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_near_duplicates_by_hand(spark, rows):
    data = [("e", "h", "1", [1.0, 0.0]), ("e", "h", "2", [0.8, 0.6]), ("e", "h", "3", [0.0, 1.0]),
            ("e", "solo", "4", [1.0, 0.0]), ("e", "o", "5", [1.0, 0.0]), ("e", "o", "6", [-1.0, 0.0])]
    out = neardup.near_duplicate_similarity(spark.createDataFrame(data, VEC))
    found = {r.id: round(r.near_duplicate_similarity, 6) for r in out.collect()}
    assert found == {"1": 0.8, "2": 0.8, "3": 0.6, "4": 0.0, "5": 0.0, "6": 0.0}


@pytest.mark.parametrize("block_rows, part_blocks", [(3, 1), (3, 4), (17, 2), (8192, 16)])
def test_near_duplicates_for_every_block_size(spark, block_rows, part_blocks):
    """One host holds most rows; blocks cut it, the result stays."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 6)).astype(np.float32)
    hosts = ["big"] * 60 + ["mid"] * 20 + [f"s{i}" for i in range(10)]
    data = [("e", h, str(i), x.tolist()) for i, (h, x) in enumerate(zip(hosts, v))]
    out = neardup.near_duplicate_similarity(
        spark.createDataFrame(data, VEC), block_rows=block_rows, part_blocks=part_blocks)
    found = {r.id: r.near_duplicate_similarity for r in out.collect()}
    u = unit(v.astype(np.float64))
    s = u @ u.T
    for i, h in enumerate(hosts):
        others = [s[i, j] for j in range(90) if j != i and hosts[j] == h]
        assert abs(found[str(i)] - max([0.0, *others])) < 1e-9
    assert len(found) == 90


def test_flags(spark):
    faq = spark.createDataFrame(
        [("e", "h", "a", 0, "q1"), ("e", "h", "b", 1, "q1"), ("e", "h", "c", 2, "q2"), ("e", "h", "d", 3, "q3"),
         ("f", "h", "b", 4, "q1"), ("e", "h", "x", 5, "q5")],
        "language string, scheme_host string, id string, pos long, question string")
    same, near, far = [1.0, 0.0], [0.8, 0.6], [0.0, 1.0]
    vectors = spark.createDataFrame(
        [("e", "a", same, same), ("e", "b", same, same), ("e", "c", near, near), ("e", "d", same, far), ("f", "b", same, same)],
        "language string, id string, question_embedding array<float>, answer_embedding array<float>")
    found = {(r.language, r.id): (r.filter, round(r.near_duplicate_similarity, 6))
             for r in neardup.make_flags(faq, vectors).collect()}
    assert found == {("e", "a"): (False, 0.8), ("e", "b"): (True, 0.0), ("e", "c"): (False, 0.8),
                     ("e", "d"): (True, 0.0), ("f", "b"): (False, 0.0), ("e", "x"): (False, 0.0)}


DOCS = "scheme_host string, language string, pos long, embedding array<float>"


def test_mutual_best_by_hand(spark, rows):
    data = [("h", "l1", 1, [1.0, 0.0]), ("h", "l1", 2, [0.8, 0.6]), ("h", "l2", 3, [1.0, 0.0]), ("h", "l2", 4, [0.0, 1.0])]
    out = parallel.mutual_best_pairs(spark.createDataFrame(data, DOCS), 0.8)
    assert rows(out, "pos1", "pos2") == [(1, 3)]


@pytest.mark.parametrize("block_rows, part_blocks", [(4, 1), (4, 3), (13, 16), (8192, 16)])
def test_mutual_best_against_brute_force(spark, rows, block_rows, part_blocks):
    rng = np.random.default_rng(2)
    data, limit = [], 0.5
    for pos in range(80):
        host, language = ("big" if pos % 4 else "small"), "abc"[int(rng.integers(3))]
        v = rng.integers(-2, 3, size=3).astype(float)  # few values: many exact ties
        data.append((host, language, pos, v.tolist() if v.any() else [1.0, 0.0, 0.0]))
    want = []
    for host in ("big", "small"):
        for l1, l2 in (("a", "b"), ("a", "c"), ("b", "c")):
            left = [d for d in data if d[0] == host and d[1] == l1]
            right = [d for d in data if d[0] == host and d[1] == l2]
            s = np.round(unit(np.array([d[3] for d in left])) @ unit(np.array([d[3] for d in right])).T, 12)
            for i in range(len(left)):
                j = int(s[i].argmax())
                if s[i, j] >= limit and s[i, j] >= s[:, j].max():
                    want.append((host, l1, l2, left[i][2], right[j][2]))
    out = parallel.mutual_best_pairs(spark.createDataFrame(data, DOCS), limit, block_rows, part_blocks)
    assert rows(out, "scheme_host", "l1", "l2", "pos1", "pos2") == sorted(want, key=repr)


@pytest.mark.parametrize("block_rows, part_blocks", [(10, 1), (10, 4), (100, 4), (1000, 16)])
def test_copies_of_a_row(spark, block_rows, part_blocks):
    """As often held as there are parts from its own on, as often passing as there are
    blocks before its own."""
    df = spark.range(1000).selectExpr("CASE WHEN id < 960 THEN 'big' ELSE concat('s', id) END AS host", "id")
    cells = blocks.in_block_cells(df, ["host"], ["id"], block_rows, part_blocks)
    n = max(1, -(-960 // block_rows))
    parts = -(-n // part_blocks)
    copies = cells.groupBy("host", "id").count().collect()
    assert len(copies) == 1000 and {r["count"] for r in copies if r.host != "big"} == {1}
    assert max(r["count"] for r in copies) <= n + parts
    assert sum(r["count"] for r in copies if r.host == "big") <= 960 * ((n + 1) / 2 + parts) * 1.3
    largest = cells.filter("side = 0").groupBy("host", "block", "part").count().agg({"count": "max"}).first()[0]
    assert largest <= block_rows * 2.5


def test_pairs_in_one_pass(spark):
    """No job runs while the plan is built, and the Python stage is there once."""
    data = [("h", "ab"[i % 2], i, [1.0, i / 9]) for i in range(40)]
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    df = spark.createDataFrame(data, DOCS)
    out = parallel.mutual_best_pairs(df, 0.5, 10)
    assert len(tracker.getJobIdsForGroup(None)) == before
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_ordered_for_every_chunk_size(spark, rows, chunk):
    rng = np.random.default_rng(3)
    data = []
    for group in "ab":
        for pos in sorted(rng.choice(60, 25, replace=False).tolist()):
            data.append((group, pos, [None, "x", "y"][int(rng.integers(3))], int(rng.integers(5))))
    df = spark.createDataFrame(data, "language string, pos long, scheme_host string, n int")
    want_n, want_sum, want_prev, want_runs = [], [], [], []
    for group in "ab":
        part = [d for d in data if d[0] == group]
        total, previous, run = 0, object(), None
        for i, (_, pos, host, n) in enumerate(part):
            total += n
            want_n.append((group, pos, i + 1))
            want_sum.append((group, pos, total))
            want_prev.append((group, pos, part[i - 1][2] if i else None))
            if host != previous:
                run = [group, host, (run[2] + 1) if run else 1, pos, 0]
                want_runs.append(run)
            run[4] += 1
            previous = host
    assert rows(ordered.numbered(df, ["language"], "pos", "x", chunk), "language", "pos", "x") == sorted(want_n, key=repr)
    assert rows(ordered.running_sum(df, ["language"], "pos", "n", "x", chunk), "language", "pos", "x") == sorted(want_sum, key=repr)
    assert rows(ordered.previous_value(df, ["language"], "pos", "scheme_host", "x", chunk), "language", "pos", "x") == sorted(want_prev, key=repr)
    got = rows(runs.host_runs(df, rows=chunk), "language", "scheme_host", "run_id", "first_pos", "n_rows")
    assert got == sorted([tuple(r) for r in want_runs], key=repr)
    starts = rows(runs.first_of_run(df, rows=chunk), "language", "pos")
    assert starts == sorted([(r[0], r[3]) for r in want_runs], key=repr)


PART = "language string, id string, url string, part string, row long"


def test_merge(spark, rows):
    parts = spark.createDataFrame(
        [("e", "id1", "b", "p1", 0), ("e", "id1", "a", "p2", 0), ("e", "id2", "c", "p2", 1), ("f", "id1", "z", "p1", 0)], PART)
    once = dedup.merge_parts(parts)
    assert rows(once, "language", "id", "url") == [("e", "id1", "a"), ("e", "id2", "c"), ("f", "id1", "z")]
    again = dedup.merge_parts(once.drop("late"))
    assert rows(again, "language", "id", "url") == rows(once, "language", "id", "url")
    assert [r.url for r in dedup.in_merge_order(once).collect()] == ["a", "c", "z"]
    newer = spark.createDataFrame([("e", "id1", "a", "p9", 0), ("e", "id3", "a", "p9", 1)], PART)
    extended = dedup.merge_parts(newer, once.drop("late"))
    assert rows(extended.filter("language = 'e'"), "id", "part") == [("id1", "p9"), ("id2", "p2"), ("id3", "p9")]
    merged_ids = {r.id for r in dedup.merge_parts(newer.unionByName(parts)).collect()}
    assert merged_ids == {r.id for r in extended.collect()}


def test_hot_key_leaves_one_row(spark):
    df = spark.range(5000).selectExpr(
        "'e' AS language", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS id", "id AS pos")
    out = dedup.first_per_key(df, ["language", "id"], ["pos"])
    assert out.count() == 3334 and out.filter("id = 'hot'").first().pos == 0


@pytest.mark.parametrize("partitions", ["1", "200"])
def test_partitions_do_not_matter(spark, rows, partitions):
    from qaweave.registry import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = rows(QUERIES["host_runs"](spark, "/root/testdata/sf0.001"))
        near = rows(QUERIES["near_duplicate_similarity"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == rows(QUERIES["host_runs"](spark, "/root/testdata/sf0.001"))
    assert near == rows(QUERIES["near_duplicate_similarity"](spark, "/root/testdata/sf0.001"))
