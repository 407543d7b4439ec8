import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaweave.llm import exact_dedup, mixing, sharding
from tests.llm.conftest import ODD


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(odd, keep):
    got = [tuple(r) for r in exact_dedup.exact_dedup(odd, keep=keep).collect()]
    groups = defaultdict(list)
    for i, t, _, _ in ODD:
        groups[t or ""].append(i)
    assert len(got) == len(ODD)
    pick = min if keep == "smallest" else max
    kept = Counter()
    for i, keep_id, size, stays, sha in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == sha)
        ids = [x for x in groups[text] if x is not None]
        assert (keep_id, size) == (pick(ids) if ids else None, len(groups[text]))
        kept[text] += stays
    assert set(kept.values()) == {1}


def test_exact_dedup_tells_colliding_texts_apart(odd):
    weak = exact_dedup.exact_dedup(odd, digest=lambda c: F.substring(F.md5(c), 1, 1)).collect()
    full = exact_dedup.exact_dedup(odd).collect()
    assert sorted(map(repr, weak)) == sorted(map(repr, full))


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.shard(empty, 4).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 7, 50, 99, 100, 131, 400, 10_000])
def test_fit_reaches_the_best_sum(budget):
    lengths, counts = np.array([3, 5, 11, 40]), np.array([2, 3, 1, 2])
    sums = {sum(x) for r in range(9) for x in combinations([3, 3, 5, 5, 5, 11, 40, 40], r)}
    take = mixing.fit(lengths, counts, budget)
    assert (take <= counts).all() and (take >= 0).all()
    assert int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def targets(sizes, weights, share, most):
    """Targets by handing the excess on until none is above."""
    limit, out = [most * s for s in sizes], [0.0] * len(sizes)
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > limit[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            return out
        for i in over:
            out[i] = limit[i]
        left -= sum(limit[i] for i in over)
        open_ -= over
    return out


def test_mix(table):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), "en", [None, "b", "a", "é", "a"][i % 5]) for i in range(900)]
    docs = table(rows)
    got = mixing.mix(docs, run_rows=5).collect()
    order = sorted({s for _, _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(1 + i % 37 for i, _, _, s in rows if s == name) for name in order]
    want = dict(zip(order, targets(sizes, [3, 1, 2, 3], 1.5, 2)))
    taken = defaultdict(int)
    for r in got:
        assert r.taken == r.times * r.size <= 2 * r.size
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for name in order:
        assert abs(taken[name] - want[name]) <= 1
    again = mixing.mix(docs.repartition(7), run_rows=5).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_of_odd_rows(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD)
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in ODD)
    assert {r.taken for r in got if not r.size} == {0}


def shards_of(df, n):
    rows = df.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(n))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return rows, by


def test_shard_balances_bytes_and_keeps_small_groups_together(table):
    rows = [(i, "copy of one text " * 20 if i % 3 == 0 else f"text {i // 2} " * (1 + i % 9), "en", "a") for i in range(3000)]
    got, by = shards_of(sharding.shard(table(rows), 8, run_rows=100), 8)
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t, _, _ in rows}
    sizes = [sum(r.size for r in by[k]) for k in range(8)]
    mean = sum(sizes) / 8
    assert all(abs(s - mean) <= 0.02 * mean + 400 for s in sizes)
    text = {i: t for i, t, _, _ in rows}
    where = defaultdict(set)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert len(where["copy of one text " * 20]) > 1
    assert sum(len(v) > 1 for v in where.values()) <= 8


def test_shard_of_odd_rows(odd):
    got, _ = shards_of(sharding.shard(odd, 5), 5)
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in ODD)
