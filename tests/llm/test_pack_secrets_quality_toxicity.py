import math
import random
import re
import string
import time
import zlib
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from qaweave.llm import packing, quality, secrets, toxicity
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pack_odd_rows(odd, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = [tuple(r) for r in packing.pack(odd, capacity=64, run_rows=3).collect()]
    want = Counter()
    for i, t, _, _ in ODD:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at:at + 64]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(r[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r[5]].append((r[6], r[3]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(r[3] for r in rows) // 64) + 1
    assert packing.pack(empty).count() == 0


def test_word_ids_equal_whole_texts():
    path = public_tokenizers.path(packing.TOKENIZER)
    tokenizer, words = Tokenizer.from_file(path), packing.WordIds(path, most=40)
    rng = random.Random(4)
    letters = "aAbéÉßñÇœİK ſ́  \x1c\x85'sS’.,!?-_#09½٣中文\U0001F600\n\t\r\x0b\x0c<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)] + ["<|endoftext|> a", "don't WE'LL can'T"]
    for k in range(0, len(texts), 50):
        part = texts[k:k + 50]
        assert words.texts(part) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]


def test_a_full_table_keeps_its_words():
    """Texts of rare words do not drive out common ones; words that stay away are let go,
    and long words are never held."""
    made = Counter()

    class Counting(packing.WordIds):
        def word(self, text):
            made[text] += 1
            return super().word(text)

    words = Counting(public_tokenizers.path(packing.TOKENIZER), most=20)
    common = "the and of with for"
    for k in range(6):
        words.texts([common])
        words.texts([" ".join(f"rare{k}x{i}" for i in range(10))])
    assert all(made[w] == 1 for w in common.split())
    words.texts(["new words now", "x" * 65] * 60)
    assert made["now"] < 60 and "now" in words.words
    assert len(words.words) <= 20 and "x" * 65 not in words.words


@pytest.mark.parametrize("seed", range(4))
def test_patterns_are_tight(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, 65, 500).tolist())
    found = packing.patterns(counts, 64)
    used = Counter()
    for times, bin_ in found:
        assert sum(a * k for a, k in bin_) <= 64
        for a, k in bin_:
            used[a] += times * k
    assert used == counts
    total = sum(a * n for a, n in counts.items())
    lone = sum(n for a, n in counts.items() if a > 32)
    assert sum(t for t, _ in found) <= max(-(-total // 64), lone) * 1.03 + 1


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found)


def test_known_forms(table):
    rng = random.Random(2)
    parts = ["password", "API_KEY", "apikey", "secret", "ſecret", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "é", "\U0001F600", "x", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)] + ["", None]
    got = secrets.find_secrets(table([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    for r in got:
        assert [tuple(s) for s in r.base] == base_spans(texts[r.doc_id] or ""), texts[r.doc_id]
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_randomness_battery(table):
    rng = random.Random(5)
    alphabet = string.ascii_letters + string.digits
    words = "user profile picture upload default handler service internal config version index manager session static image".split()
    rows = [(i, "the value " + "".join(rng.choice(alphabet) for _ in range(40)) + " é", "en", "a") for i in range(60)]
    rows += [(i, "see " + "_".join(rng.choice(words) for _ in range(5)) + f"_{rng.randrange(9999)}", "en", "a") for i in range(60, 400)]
    rows += [(i, "k " + "aB12" * 10, "en", "a") for i in range(400, 420)]
    got = {r.doc_id: [tuple(s) for s in r.spans if s.kind == "random"] for r in secrets.find_secrets(table(rows)).collect()}
    assert sum(got[i] == [(10, 3, "random", 50)] for i in range(60)) >= 55
    assert sum(bool(got[i]) for i in range(60, 420)) <= 3


def z_tests(codes, size):
    """The three tests as the formulas are written, number by number."""
    n = len(codes)
    counts = Counter(codes)
    mean = sum(codes) / n
    high = [c > size / 2 for c in codes]
    expected = 2 * sum(high) * (n - sum(high)) / n + 1
    turns = 1 + sum(a != b for a, b in zip(high, high[1:]))
    spread = sum((c - mean) ** 2 for c in codes)
    uniform = (sum((k - n / size) ** 2 / (n / size) for k in [counts[c] for c in range(1, size + 1)]) - (size - 1)) / math.sqrt(2 * (size - 1))
    runs = (turns - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 0.25))
    serial = (sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / spread + 1 / n) * math.sqrt(n) if len(counts) > 1 else 99.0
    return uniform, runs, serial


def spans_by_force(texts, rate=0.002, alpha=0.001):
    """Spans of kind random of each text: words, pairs, tokens, tests and limits one by one."""
    words = {w for t in texts for w in re.findall(r"(?<![a-z0-9+/_=-])[a-z]{2,19}(?![a-z0-9+/_=-])", t.lower())}
    pairs = Counter(w[k:k + 2] for w in words for k in range(len(w) - 1))
    odds_of = {name: secrets.pair_odds(pairs, symbols) for name, _, symbols in secrets.ENCODINGS}
    one, two = (NormalDist().inv_cdf(1 - alpha / k) for k in (3, 6))
    found, classes = defaultdict(list), defaultdict(dict)
    for i, t in enumerate(texts):
        base = base_spans(t)
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", t):
            if not (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])) or any(a < m.end() and m.start() < b for a, _, _, b in base):
                continue
            v = m[0].rstrip("=")
            name, symbols = next((n, s) for n, p, s in secrets.ENCODINGS if re.search(p, v))
            codes = [symbols.index(c) + 1 for c in (v.translate(str.maketrans("-_", "+/")) if name in ("base62", "base64") else v.lower())]
            odds = sum(odds_of[name][(a - 1) * len(symbols) + b - 1] for a, b in zip(codes, codes[1:]))
            u, r, s = z_tests(codes, len(symbols))
            passes = u <= one and abs(r) <= two and abs(s) <= two
            group = name, math.floor(4 * math.log2(len(v)))
            classes[group][v] = odds, passes
            found[i].append((m.start(), m.end(), group, odds, passes))
    limits = {}
    for group, tokens in classes.items():
        for x in sorted({math.floor(min(max(o, 0), 100) * 10) / 10 for o, _ in tokens.values()}):
            taken = sum(p and min(o, 100) >= x for o, p in tokens.values())
            if taken and math.exp(-x) * len(tokens) <= rate * taken:
                limits[group] = x
                break
    return {i: [(a, 3, "random", b) for a, b, g, o, p in of if p and o >= limits.get(g, math.inf)] for i, of in found.items()}


def token_texts(seed, share):
    """Texts of ordinary words, identifiers, and random tokens of several encodings."""
    rng = random.Random(seed)
    words = "user profile picture upload default handler service internal config version index manager session static image the of and to".split()
    letters = {"hex": ("0123456789ABCDEF", (40, 64)), "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (24, 32)),
               "base36": (string.ascii_lowercase + string.digits, (24, 40)), "base64": (string.ascii_letters + string.digits + "+/", (20, 24, 40))}
    texts = []
    for i in range(1500):
        parts = [rng.choice(words) for _ in range(8)]
        kind = rng.choice(["_", "-", "/", "", "Cap"])
        name = [rng.choice(words) for _ in range(5)]
        parts.append(("".join(w.title() for w in name) if kind == "Cap" else kind.join(name)) + str(rng.randrange(9999)))
        parts.append("".join(rng.choice("0123456789") for _ in range(24)) + rng.choice("ABCDEF"))
        if rng.random() < share:
            alphabet, sizes = letters[rng.choice(list(letters))]
            parts.append("".join(rng.choice(alphabet) for _ in range(rng.choice(sizes))) + rng.choice(["", "=", "=="]))
        if rng.random() < 0.2:
            parts.append("token=" + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(30)) + "😀")
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    return texts + ["", "a" * 30 + "1", "0A" * 20]


@pytest.mark.parametrize("seed, share", [(1, 0.02), (2, 0.3), (3, 0.0)])
def test_random_tokens_by_force(table, seed, share):
    texts = token_texts(seed, share)
    want = spans_by_force(texts)
    got = {r.doc_id: [tuple(s) for s in r.spans if s.kind == "random"] for r in secrets.find_secrets(table([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert {i: s for i, s in got.items() if s} == {i: s for i, s in want.items() if s}
    if not share:
        assert not any(got.values())


def test_power_at_a_small_share(table):
    """Random tokens of one encoding and length among a hundred times as many ordinary ones."""
    rng = random.Random(9)
    texts = [t for k in range(2) for t in token_texts(20 + k, 0)[:1500]]
    for size in (24, 32):
        alphabet = string.ascii_letters + string.digits
        texts += ["see " + "".join(rng.choice(alphabet) for _ in range(size - 1)) + "7 there" for _ in range(15)]
    got = {r.doc_id: [s for s in r.spans if s.kind == "random"] for r in secrets.find_secrets(table([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert sum(bool(got[i]) for i in range(3000)) <= 1
    assert sum(bool(got[i]) for i in range(3000, 3030)) >= 27


def test_many_matches_and_long_tokens(table):
    rng = random.Random(3)
    digests = "\n".join("%032x  f%d" % (rng.getrandbits(128), i) for i in range(100_000))
    blob = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(200_000))
    names = " ".join(f"some_long_identifier_{i}" for i in range(50_000))
    started = time.time()
    got = {r.doc_id: r for r in secrets.find_secrets(table([(1, digests, "en", "a"), (2, blob, "en", "a"), (3, names, "en", "a")])).collect()}
    assert time.time() - started < 120
    assert [tuple(s) for s in got[1].base] == base_spans(digests)
    assert [tuple(s) for s in got[2].spans if s.kind == "random"] == [(0, 3, "random", 200_000)]
    assert not got[3].spans


def test_secrets_of_odd_rows(odd, empty):
    assert Counter(r.doc_id for r in secrets.find_secrets(odd).collect()) == Counter(i for i, *_ in ODD)
    assert secrets.find_secrets(empty).count() == 0


def rules(t):
    t = t or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if grams[tuple(words[k:k + 5])] > 1 for j in range(k, k + 5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_quality_rules(table, odd, empty):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["é", "b#", "c", "dd", "\n", "<|>"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    got = quality.quality(table([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    got = quality.quality(odd).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _, _ in ODD)
    assert quality.quality(empty).count() == 0


def test_bands_reject_odd_tokens(table):
    rng = random.Random(7)
    words = ["house", "river", "people", "country", "little", "because", "water", "without", "another", "through", "thought", "family"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(120, 180))), ["en", None][i % 2], "a") for i in range(240)]
    junk = ["qzx#%", "中文字", "%%$$#", "xjqw", "\U0001F600\U0001F680"]
    rows += [(1000 + i, " ".join(rng.choice(junk) for _ in range(140)), "en", "a") for i in range(8)]
    got = {r.doc_id: r for r in quality.quality(table(rows)).collect()}
    assert sum(got[i].kept for i in range(240) if not got[i].base_failed) >= 0.97 * sum(not got[i].base_failed for i in range(240))
    assert not any(got[1000 + i].kept for i in range(8))


def test_copies_do_not_narrow_bands(table):
    rng = random.Random(11)
    words = sorted({a + b for a in ("hou", "ri", "peo", "coun", "lit", "wa", "thou", "fa") for b in ("se", "ver", "ple", "try", "tle", "ter", "ght", "mily")})
    texts = []
    for _ in range(300):
        own = rng.sample(words, rng.randrange(14, 60))
        texts.append(" ".join(rng.choice(own) for _ in range(rng.randrange(100, 125))))
    alone = {r.doc_id: r for r in quality.quality(table([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    copied = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(1000 + i, texts[0], "en", "a") for i in range(1000)]
    got = {r.doc_id: r for r in quality.quality(table(copied)).collect()}
    assert len(got) == 1300
    assert {i: got[i].kept for i in alone} == {i: r.kept for i, r in alone.items()}
    assert sum(r.kept for r in alone.values()) >= 0.95 * sum(not r.base_failed for r in alone.values())


def segments_by_force(scores):
    """Maximal segments: the best one, and the same left and right of it."""
    n = len(scores)
    best = max(((sum(scores[i:j]), i - j, i, j) for i in range(n) for j in range(i + 1, n + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    while scores[i] == 0:
        i += 1
    left, right = segments_by_force(scores[:i]), segments_by_force(scores[j:])
    return [*left, (i, j - 1), *((a + j, b + j) for a, b in right)]


def test_maximal_segments():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = rng.normal(-0.3, 1.0, rng.integers(0, 14))
        got = toxicity.maximal_segments(scores)
        assert [(a, b) for a, b, _ in got] == segments_by_force(scores.tolist())
        for a, b, s in got:
            assert s == pytest.approx(scores[a:b + 1].sum())


def test_toxicity_held_out(spark, table, odd, empty):
    rng = random.Random(6)
    pool = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ter") for b in ("na", "ru", "so") for c in ("l", "m", "nd", "st")]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(pool) for _ in range(rng.randrange(20, 80))]
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = "zorgu" + rng.choice(["x", "y", "zz", "qq", "ma", "na"])
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, toxic))
    marks = spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(rows), marks).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.passages for r in held if r.predicted)
    nobody = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd, nobody).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in ODD)
    assert all(0 <= r.score < 0.7 for r in got)
    assert toxicity.toxicity(empty, nobody).count() == 0
