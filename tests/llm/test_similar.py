"""The near-duplicate stage held against brute-force Jaccard similarity."""

from collections import defaultdict

import numpy as np

import corpus_pipeline
from qaweave.llm import similar, simhash
from tests.llm.test_pairs_lines_passages import union


def shingle_set(text):
    return set(simhash.shingles((text or "").lower().encode().split(), 5))


def jaccard(a, b):
    return len(a & b) / max(len(a | b), 1) if a or b else 1.0


def pairs_at(rng, shared, changed):
    """Two texts that differ in their last `changed` words: similarity (shared - 4) / (shared - 4 + 2 * changed)."""
    head = [f"h{v}" for v in rng.integers(0, 1 << 40, shared)]
    return [" ".join(head + [f"t{v}" for v in rng.integers(0, 1 << 40, changed)]) for _ in range(2)]


def test_near_stage_by_jaccard(spark, table):
    rng = np.random.default_rng(8)
    texts = []
    for shared, changed in ((204, 25), (204, 24), (204, 26), (204, 33), (44, 5), (12, 1), (14, 2)):
        for _ in range(40):
            texts += pairs_at(rng, shared, changed)
    line = "a line that is there once or many times over in a text of this kind "
    body = " ".join(f"b{v}" for v in rng.integers(0, 1 << 40, 200))
    texts += [body + " " + line * 2, body + " " + line * 60, None, "", " \n", "one two", "one two", "One TWO", "one two three"]
    sets = [shingle_set(t) for t in texts]
    root = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    groups = defaultdict(list)
    for i, g in enumerate(root):
        groups[g].append(i)
    got = {r.doc_id for r in corpus_pipeline.near_stage(spark, table([(i, t, "en", "a") for i, t in enumerate(texts)]), "").collect()}
    assert got == {min(g) for g in groups.values()}


def test_links_of_a_crowded_group():
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            words[at] = f"x{rng.integers(0, 5)}"
        texts.append(" ".join(words).encode())
    sets = [shingle_set(t.decode()) for t in texts]
    want = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    hashes, n = similar.shingle_sets(texts, 5)
    got = union(len(texts), [(int(a), int(b)) for x, y in similar.similar_links(hashes, n, 0.8) for a, b in zip(x, y)])
    assert len(set(want)) > 1
    assert [want.index(g) for g in want] == [got.index(g) for g in got]


def test_bands_find_pairs_at_the_bound():
    rng = np.random.default_rng(10)
    texts = [t.encode() for _ in range(2000) for t in pairs_at(rng, 204, 25)]
    keys = similar.band_keys(*similar.shingle_sets(texts, 5))
    assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.998
