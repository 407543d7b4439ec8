from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from qaweave.llm import line_dedup, simhash, substring_dedup
from qaweave.llm.components import components
from tests.llm.conftest import ODD


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5)]
    root = union(461, edges)
    seen = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == {(x, root[x]) for x in seen}
    assert len(got) == len(seen)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(table):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice([f"v{i}" for i in range(50)], 120)) for _ in range(20)]
    texts = [*base]
    for k in range(120):
        words = base[k % 20].split()
        for at in rng.integers(0, 120, k % 4):
            words[at] = "changed"
        texts.append(" ".join(words).upper() if k % 7 == 0 else " ".join(words))
    texts += ["", None, "a", "A b", "a b c"]
    fps = [fingerprint(t or "") for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = union(len(fps), pairs)
    got = simhash.near_dedup(table([(1000 - i, t, "en", "a") for i, t in enumerate(texts)]))
    got = {r.doc_id: (r.f, r.component_id) for r in got.select("doc_id", simhash.as_hex(got.fp).alias("f"), "component_id").collect()}
    want = {1000 - i: (f"{fps[i]:016x}", min(1000 - j for j in range(len(fps)) if root[j] == root[i])) for i in range(len(fps))}
    assert got == want


@pytest.mark.parametrize("above", [2, 2048])
@pytest.mark.parametrize("words,distance", [(1, 3), (4, 39)])
def test_forest_connects_what_near_pairs_connect(above, words, distance):
    rng = np.random.default_rng(words)
    centres = rng.integers(0, 1 << 64, (6, words), np.uint64)
    fps = np.repeat(centres, 40, axis=0)
    for row in fps:
        for b in rng.integers(0, 64 * words, rng.integers(0, distance)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    run = np.repeat(np.arange(3), 80)
    label = simhash.forest(run, fps, simhash.pivots(8, words), distance, above)
    pairs = [(i, j) for i in range(240) for j in range(i) if run[i] == run[j] and int(simhash.bits_apart(fps[i], fps[j])) <= distance]
    assert label.tolist() == union(240, pairs)


def test_wide_fingerprints_find_similar_texts(table):
    rng = np.random.default_rng(8)
    rows, n = [], 60
    for k in range(n):
        words = [f"x{v}" for v in rng.integers(0, 5000, 300)]
        rows.append((2 * k, " ".join(words), "en", "a"))
        words[100:104] = ["a", "b", "c", "d"]
        rows.append((2 * k + 1, " ".join(words), "en", "a"))
    got = simhash.near_dedup(table(rows), simhash.distance_of(0.8, 4), 5, words=4).collect()
    assert sum(r.component_id == r.doc_id // 2 * 2 for r in got) >= 0.97 * 2 * n
    assert all(r.component_id in (r.doc_id, r.doc_id - 1) for r in got)


def test_simhash_of_odd_rows(odd, empty):
    got = simhash.near_dedup(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in ODD)
    assert {r.component_id for r in got if r.fp == 0} == {3}
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert simhash.near_dedup(empty).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, before = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[-1] + 1))
    return row[-1]


def line_rule(rows):
    """Rows (id, text) without the lines that repeat an earlier one, by definition."""
    lines = [(LAST if i is None else i, k, line.split()) for i, t in set(rows) for k, line in enumerate((t or "").split("\n")) if line.split()]
    gone = set()
    for i, k, w in lines:
        for j, m, v in lines:
            if (j, m) < (i, k) and (v == w or min(len(v), len(w)) >= 5 and abs(len(v) - len(w)) < 2 and edits(v, w) < 2):
                gone.add((i, k))
                break
    return {(i, t): "\n".join(x for k, x in enumerate((t or "").split("\n")) if (LAST if i is None else i, k) not in gone) for i, t in rows}


LAST = (1 << 63) - 1


def test_line_dedup(table):
    rng = np.random.default_rng(5)
    base = [[f"v{x}" for x in rng.integers(0, 30, n)] for n in rng.integers(1, 12, 40)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.integers(1, 5)):
            w = list(base[rng.integers(0, 40)])
            kind = rng.integers(0, 5)
            at = int(rng.integers(0, len(w)))
            if kind == 1:
                w[at] = "new"
            elif kind == 2:
                w.insert(at, f"in{rng.integers(0, 9)}")
            elif kind == 3:
                del w[at]
            lines.append((" " if kind else "  ").join(w))
        rows.append((i, "\n".join(lines), "en", "a"))
    want = line_rule([(i, t) for i, t, _, _ in rows])
    got = {(r.doc_id): r.text for r in line_dedup.line_dedup(table(rows)).collect()}
    assert got == {i: want[i, t] for i, t, _, _ in rows}


def test_line_dedup_of_odd_rows(odd, empty):
    df = line_dedup.line_dedup(odd)
    # The table has a column __lines, so the number of lines takes another name.
    assert line_dedup.count_columns(odd) == ("___lines", "__removed")
    assert df.columns == [*odd.columns, "___lines", "__removed"]
    got = df.collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got if r.doc_id not in (2, 9, None)}
    assert by_id[3].text is None and by_id[5].text == " \t\n \r " and by_id[1]["__removed"] == 0
    assert {r["__removed"] for r in got if r.doc_id == 2} == {1}
    assert by_id[12].text == "one two three four five six\n"
    assert {r["text"] for r in got if r.doc_id is None} == {""}
    assert line_dedup.line_dedup(empty).count() == 0


def passages(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = []
    for i, t in rows:
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < (LAST if i is None else i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("crowd", [0, 3, 20_000])
def test_substring_dedup(table, crowd):
    rng = np.random.default_rng(9)
    pool = [f"v{x}" for x in range(400)]
    shared = [list(rng.choice(pool, n)) for n in (9, 10, 12, 30)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.integers(0, 5)):
            words += shared[rng.integers(0, 4)] if rng.random() < 0.6 else list(rng.choice(pool, rng.integers(1, 15)))
        rows.append((200 - i, "  ".join(words), "en", "a"))
    got = substring_dedup.substring_dedup(table(rows), window=10, gram=3, crowd=crowd)
    assert Counter(map(tuple, got.collect())) == passages([(i, t) for i, t, _, _ in rows], 10)


def test_substring_dedup_of_odd_rows(odd, empty):
    ascii_rows = [(i, t) for i, t, _, _ in ODD]
    assert Counter(map(tuple, substring_dedup.substring_dedup(odd).collect())) == passages(ascii_rows, 50)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_passages_of_repeated_rows(table):
    """Rows alike in id and text cost their number, not its square."""
    passage = " ".join(f"q{i}" for i in range(80))
    rows = [(1, passage + " first", "en", "a")] + [(None, f"x {passage} y", "en", "a")] * 2000 + [(5, passage, "en", "a")]
    df = table(rows).repartition(4)
    spans = substring_dedup.stored(substring_dedup.spans(df, 50, 8, "doc_id", "text"), "spans")
    wanted = spans.select("minimiser", F.lit(False).alias("hot"), "id", "th", F.col("start"), F.col("windows"))
    n_spans = spans.select("id", "th", "start").distinct().groupBy("id", "th").count().agg(F.max("count")).first()[0]
    assert substring_dedup.packed(df, wanted, 50, "doc_id", "text").count() <= n_spans * len(rows)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert got == {(1, 81, 0): 1, (None, 82, 80): 2000, (5, 80, 80): 1}
