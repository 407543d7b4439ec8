"""The prefix trie held against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from qaweave.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, n long, size long, k1 long, t_conv long, h int, run int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA)


def brute(convs):
    """Nodes of {conv_id: [(role, text), ...]} by listing every prefix."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for p, ids in members.items():
        inside = [q for q in members if q[:len(p)] == p]
        children = sum(len(q) == len(p) + 1 for q in inside)
        leaves = sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in inside) for q in inside)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in inside if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children, leaves, saved, sha))
    return sorted(out, key=repr)


def nodes(lists, turns_at_once=1_000_000):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(lists, turns_at_once).drop("k1", "k2").collect()), key=repr)


def listed(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}


@pytest.mark.parametrize("turns_at_once", [1, 7, 1_000_000])
def test_trie_of_many_ranges(spark, turns_at_once):
    draw = random.Random(3)
    rows = []
    for c in range(-40, 160):
        long = c % 50 == 0
        for turn in range(draw.choice((30, 60)) if long else draw.randint(1, 6)):
            word = "same" if long and turn < 25 else draw.choice("ab")
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", word * draw.choice((1, 1, 2)) if not long else word))
    rows += [(c, t, "user", "first") for c in range(200, 420) for t in range(2)]  # a third are one conversation
    lists = prefix_trie.turn_lists(table(spark, rows)).repartition(5)
    assert nodes(lists, turns_at_once) == brute(listed(rows))


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [(1, None, None, None), (1, 0, "user", "x"), (2, 0, "user", "x"), (2, None, "", ""), (3, 5, "user", "x"), (3, 5, "user", "x"),
            (None, 1, "user", "lost"), (4, 0, "user", long), (5, 0, "user", long), (6, 0, "user", long + "."), (70_000, 0, "user", long),
            (-9, 0, "12:user", "ß\U0001F600"), (7, 0, "1", "2:user"), (8, 0, "12", ":user"), (9, 0, "user", ""), (10, 0, "user", None)]
    assert nodes(prefix_trie.turn_lists(table(spark, rows))) == brute(listed(rows))
    assert nodes(prefix_trie.turn_lists(table(spark, rows)).limit(0)) == []
    assert nodes(prefix_trie.turn_lists(table(spark, []))) == []


def test_rebuilt(spark):
    draw = random.Random(5)
    rows = [(c, t, "user", draw.choice("abc")) for c in [*range(0, 30), *range(101, 140), *range(200, 230)] for t in range(draw.choice((1, 3, 8)))]
    own = listed(rows)
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    assert any(not v for v in want.values()), "a conversation without turns"
    c = F.col("conv_id")
    lists = prefix_trie.rebuilt(prefix_trie.turn_lists(table(spark, rows)), c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5)
    assert nodes(lists, 10) == brute(want)
