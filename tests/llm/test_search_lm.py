"""Ranked search and document likelihoods held against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from qaweave.llm import lattice_lm, lexical_search
from tests.llm.conftest import LONG, ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ranked(docs, items, k):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    split = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    split = [(i, c, sum(c.values())) for i, c in split if c]
    n_docs, n_terms = len(split), sum(n for _, _, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in split:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(TERM.findall((text or "").translate(LOWER))) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k,items_at_once,postings,width", [(5, 1000, 1_000_000, 512), (50, 4, 300, 3), (1, 1000, 1, 1), (1000, 1000, 5000, 64)])
def test_search(spark, table, k, items_at_once, postings, width):
    draw = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)] + ["ß", "É", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(draw.randint(-5, 400), " ".join(draw.choices(vocabulary, weights, k=draw.randint(1, 60)))) for _ in range(300)]
    docs += [(i, "w0 w1 w2 W9-w59") for i in range(500, 650)] + [(i, t) for i, t, _, _ in ODD]  # a third are copies
    items = [(j, " ".join(draw.choices(vocabulary, k=draw.randint(1, 20)))) for j in range(12)]
    items += [(7, "w1"), (None, "w2 w3"), (90, None), (91, ""), (92, "...nothing-of-this"), (93, "The QUICK brown_fox"), (94, LONG), (95, "w0 " * 50)]
    d = table([(i, t, "en", "a") for i, t in docs]).repartition(6)
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, item int")
    out = got(lexical_search.search(d, q, k, items_at_once, postings, width))
    assert out == ranked(docs, items, k)


def test_search_of_nothing(spark, table, empty):
    q = spark.createDataFrame([(1, "a word")], "item_id long, text string")
    assert got(lexical_search.search(empty, q)) == []
    assert got(lexical_search.search(table([(1, "a word", "en", "a"), (2, " .", "en", "a")]), q.limit(0))) == []
    # A term of every document has weight 0 where there are enough; one document always scores.
    assert [r[:3] for r in got(lexical_search.search(table([(1, "a word", "en", "a")]), q))] == [(1, 1, 1)]


def test_terms():
    every = "".join(map(chr, range(128))) + "é Ä 日"
    assert [t.decode() for t in lexical_search.terms(every.encode())] == TERM.findall(every.translate(LOWER))


def known_pieces():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(lattice_lm.TOKENIZER))
    used = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    byte = {int(model.id_to_piece(i)[3:5], 16): n for n, i in enumerate(used) if model.is_byte(i)}
    return {model.id_to_piece(i).encode(): n for n, i in enumerate(used) if not model.is_byte(i)}, byte


def segmentations(text, names, byte):
    """Every way to write `text` in pieces and bytes, as lists of piece numbers."""
    if not text:
        return [[]]
    out = []
    for j in range(1, len(text) + 1):
        heads = [byte[text[0]]] if j == 1 else []
        heads += [names[text[:j]]] if text[:j] in names else []
        if heads:
            out += [[h, *rest] for h in heads for rest in segmentations(text[j:], names, byte)]
    return out


def test_lattice_is_the_sum_over_all_segmentations():
    names, byte = known_pieces()
    pieces = lattice_lm.Pieces(public_tokenizers.path(lattice_lm.TOKENIZER))
    rng = np.random.default_rng(1)
    log_p = np.log(rng.dirichlet(np.full(pieces.size, 0.3)) + 1e-12)
    found = [b"the", "ñash".encode(), b"x", b"thoung", "日本".encode(), b"$$$$", "▁a".encode()]
    times = np.arange(1, len(found) + 1)
    lattice = lattice_lm.Lattice(found, pieces)
    want = np.zeros(pieces.size)
    for w, lp, n in zip(found, lattice.words(log_p), times):
        ways = segmentations(lattice_lm.MARK + w, names, byte)
        each = np.array([log_p[way].sum() for way in ways])
        assert lp == pytest.approx(np.logaddexp.reduce(each), abs=1e-9)
        for way, x in zip(ways, each):
            np.add.at(want, way, n * math.exp(x - lp))
    assert np.allclose(lattice.expected(log_p, times), want)
    long = lattice_lm.Lattice([b"ab" * 20_000, b"c"], pieces).words(log_p)
    assert np.isfinite(long).all() and long[0] < long[1]


def test_expected_counts_raise_the_likelihood(spark, table):
    docs = [(i, t, "en", "a") for i, t in enumerate(["the then them other", "another mother and brother", "", "weather or feather"] * 5)]
    total = [sum(r.score for r in lattice_lm.score_documents(table(docs), rounds=n).collect() if not r.held_out) for n in (0, 1, 2, 4)]
    assert total == sorted(total)


@pytest.mark.parametrize("often_share", [1e-5, 0.02, 2.0])
def test_documents(table, often_share):
    draw = random.Random(2)
    docs = [(i, " ".join(draw.choices(["The", "a", "é", "rare%d" % draw.randint(0, 99), "WORD"], k=draw.randint(0, 30)))) for i in range(100)]
    docs += [(i, t) for i, t, _, _ in ODD] + [(i, "one text that many share") for i in range(200, 260)]
    split = [(i, [w.translate(LOWER) for w in WORD.findall(t or "")], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in docs]
    c, ends = Counter(w for _, ws, held in split if not held for w in ws), sum(not held for _, _, held in split)
    n, v = sum(c.values()) + ends, len(c) + 1
    want = []
    for i, ws, held in split:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        want.append((i, held, len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n, round(base, 6)))
    rows = lattice_lm.score_documents(table([(i, t, "en", "a") for i, t in docs]).repartition(4), often_share=often_share).collect()
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in rows), key=repr) == sorted(want, key=repr)
    # A text's score is the sum of its words' and its end's.
    alone = {r.doc_id: r.score for r in rows}
    by_text = defaultdict(set)
    for i, t in docs[-60:]:
        by_text[t].add(round(alone[i], 9))
    assert all(len(x) == 1 for x in by_text.values()) and all(s < 0 for s in alone.values())


def test_score_by_segmentations(table):
    """The whole model once more: expected counts over every segmentation, then the sum."""
    names, byte = known_pieces()
    docs = [(1, "ab abc Ab"), (2, "cab"), (3, None), (4, "ba")]
    pieces = lattice_lm.Pieces(public_tokenizers.path(lattice_lm.TOKENIZER))
    learnt = [(i, (t or "").lower().split()) for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for _, ws in learnt for w in ws)
    ways = {w: segmentations(lattice_lm.MARK + w.encode(), names, byte) for w in {"ab", "abc", "cab", "ba"}}
    p, end = pieces.first_weights / pieces.first_weights.sum(), 1.0
    for _ in range(2):
        expected = np.full(pieces.size, lattice_lm.SMOOTHING)
        for w, n in counts.items():
            each = np.array([p[way].prod() for way in ways[w]])
            for way, x in zip(ways[w], each / each.sum()):
                np.add.at(expected, way, n * x)
        whole = expected.sum() + len(learnt) + lattice_lm.SMOOTHING
        p, end = expected / whole, (len(learnt) + lattice_lm.SMOOTHING) / whole
    got = {r.doc_id: r.score for r in lattice_lm.score_documents(table([(i, t, "en", "a") for i, t in docs]), rounds=2).collect()}
    for i, t in docs:
        want = math.log10(end) + sum(math.log10(sum(p[way].prod() for way in ways[w])) for w in (t or "").lower().split())
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_scores_of_nothing(table, empty):
    assert lattice_lm.score_documents(empty).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lattice_lm.score_documents(table([(held, "only words held out", "en", "a")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 5, 0, 0, 0.0)
    assert math.isfinite(row.score)
