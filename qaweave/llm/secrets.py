"""Secret scans: known forms, and a battery of randomness tests for the rest."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length. Order is the order of kinds.
FORMS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Encodings by the letters a token uses, the first that fits: name, pattern, symbols in order.
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[0-9A-Za-z+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Words whose letter pairs are learnt: short whole tokens of letters only.
ORDINARY = r"(?<![a-z0-9+/_=-])[a-z]{2,19}(?![a-z0-9+/_=-])"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: In an ordinary string the next letter is of the same class (small, capital, digit, sign) with this probability.
STAYS = 0.9
_BIN, _MOST = 10, 100
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once. An expression named inside a lambda is
    computed again for each element."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of `op` over an array of whole numbers from 0 up, 0 being neutral. It
    works on pieces of about the square root of the length, so that the arrays that grow
    stay short."""

    def last(a: Column) -> Column:
        return F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))

    def short(a: Column) -> Column:
        return F.aggregate(a, F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(op(last(acc), v))))

    def cut(x: Column, k: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), k - 1), lambda c: short(F.slice(x, c * k + 1, k)))
        return bound(pieces, lambda ps: bound(short(F.transform(ps, last)), lambda heads: F.flatten(F.transform(
            ps, lambda p, i: bound(F.coalesce(F.get(heads, i - 1), F.lit(0)), lambda head: F.transform(p, lambda v: op(head, v)))))))

    return bound(values, lambda x: F.when(F.size(x) == 0, x).otherwise(
        bound(F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int"), lambda k: cut(x, k))))


def matches(text: Column, pattern: str, group: int) -> Column:
    """Leftmost matches that don't overlap, as structs start, end (code points), value
    (the group). Matches are what a split takes away, so places are sums of lengths."""
    gaps = F.split(text, pattern, -1)
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    sizes = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), value.alias("value"))

    def placed(zs: Column) -> Column:
        return bound(running(F.transform(zs, lambda z: z["gap"] + z["size"]), lambda a, b: a + b), lambda ends: F.transform(
            zs, lambda z, i: F.struct((F.get(ends, i) - z["size"]).alias("start"), F.get(ends, i).alias("end"), z["value"].alias("value"))))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), bound(F.filter(sizes, lambda z: z["size"].isNotNull()), placed)).otherwise(none)


def known(text: Column) -> Column:
    """Spans of the known forms, by start and kind."""

    def form(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        long_enough = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
        return F.transform(long_enough, lambda m: F.struct(m["start"], F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"]))

    parts = [form(i, *f) for i, f in enumerate(FORMS)]
    return F.array_sort(F.concat(*parts)).cast(_SPAN)


def candidates(text: Column, spans: Column) -> Column:
    """Long tokens of an encoding's letters, with a digit and a letter, outside `spans`.

    Ends of tokens and starts of spans are put in order; a token is free if no span that
    starts before its end ends behind its start, which a running maximum shows."""

    def free(events: Column) -> Column:
        return bound(running(F.transform(events, lambda e: F.when(e["value"].isNull(), e["end"]).otherwise(F.lit(0))), F.greatest), lambda far: F.filter(
            events, lambda e, i: e["value"].isNotNull() & (F.get(far, i) <= e["start"])))

    found = F.filter(matches(text, CANDIDATE, 0), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    tokens = F.transform(found, lambda m: F.struct(
        m["end"].alias("at"), F.lit(0).alias("order"), m["start"], m["end"], F.rtrim(m["value"], F.lit("=")).alias("value")))
    others = F.transform(spans, lambda s: F.struct(
        s["start"].alias("at"), F.lit(1).alias("order"), s["start"], s["end"], F.lit(None).cast("string").alias("value")))
    return bound(tokens, lambda ts: F.when(F.size(ts) == 0, F.array().cast("array<struct<start:int,end:int,value:string>>")).otherwise(
        F.transform(bound(F.array_sort(F.concat(ts, others)), free), lambda e: F.struct(e["start"], e["end"], e["value"]))))


def letter_pairs(text: Column, docs: DataFrame) -> Counter:
    """How often each pair of letters is found in the distinct ordinary words of all texts."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(ORDINARY), F.lit(0)))).alias("word")).distinct()
    pairs = words.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))).alias("pair"))
    return Counter({r.pair: r["count"] for r in pairs.groupBy("pair").count().collect()})


def kind_of(c: str) -> str:
    return "digit" if c.isdigit() else "small" if c.islower() else "capital" if c.isupper() else "sign"


def pair_odds(pairs: Counter, symbols: str) -> list[float]:
    """For each pair of symbols, the first one by one, how much likelier the second is after
    the first in a random string than in an ordinary one, as a natural logarithm.

    The ordinary string stays in its class with probability STAYS; a letter after a letter
    follows the learnt pairs (smoothed by the letters' shares), digits and signs are even."""
    total, ahead, behind = sum(pairs.values()), Counter(), Counter()
    for pair, n in pairs.items():
        ahead[pair[0]] += n
        behind[pair[1]] += n
    kinds = Counter(map(kind_of, symbols))
    letters = sorted({c.lower() for c in symbols if c.isalpha()})
    share = {c: (behind[c] + 1) / (total + len(LETTERS)) for c in letters}
    after = {a: {b: (pairs[a + b] + 5 * share[b]) / (ahead[a] + 5) for b in letters} for a in letters}
    sums = {a: sum(row.values()) for a, row in after.items()}
    anywhere = sum(share.values())

    def ordinary(x: str, y: str) -> float:
        own, other = kind_of(x), kind_of(y)
        moves = STAYS if own == other else (1 - STAYS) / (len(kinds) - 1)
        if not y.isalpha():
            return moves / kinds[other]
        a, b = x.lower(), y.lower()
        return moves * (after[a][b] / sums[a] if a in after else share[b] / anywhere)

    return [-math.log(len(symbols) * ordinary(x, y)) for x in symbols for y in symbols]


def tested(found: Column, pairs: Counter) -> Column:
    """Adds the tests' results to candidates: encoding, length class, odds (log-odds of a
    random against an ordinary string, over all letter pairs), and uniform, runs and serial
    (z against random strings)."""
    odds = [x for _, _, symbols in ENCODINGS for x in pair_odds(pairs, symbols)]
    offsets = [sum(len(e[2]) ** 2 for e in ENCODINGS[:i]) for i in range(len(ENCODINGS))]
    table = F.split(F.lit(",".join(map(repr, odds))), ",").cast("array<double>")

    def one(m: Column) -> Column:
        fits = [m["value"].rlike(p) for _, p, _ in ENCODINGS]

        def pick(values):
            return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), list(zip(fits, map(F.lit, values)))[-2::-1], F.lit(values[-1]))

        name = pick([e[0] for e in ENCODINGS])
        text = F.when(name.isin("base62", "base64"), F.translate(m["value"], "-_", "+/")).otherwise(F.lower(m["value"]))
        return bound(pick([e[2] for e in ENCODINGS]), lambda letters: F.struct(
            m["start"], m["end"], m["value"], name.alias("encoding"), pick([len(e[2]) for e in ENCODINGS]).alias("size"),
            pick(offsets).alias("offset"), F.transform(F.split(text, ""), lambda c: F.position(c, letters)).alias("codes")))

    def measured(m: Column, even: Column) -> Column:
        codes = m["codes"]
        lag = F.arrays_zip(F.slice(codes, F.lit(1), F.size(codes) - 1).alias("x"), F.slice(codes, F.lit(2), F.size(codes) - 1).alias("y"))

        def total(values: Column, term: Callable[[Column], Column]) -> Column:
            return F.aggregate(values, F.lit(0.0), lambda s, v: s + term(v))

        return F.struct(
            m["start"], m["end"], m["value"], m["encoding"], m["size"].cast("double").alias("size"), F.size(codes).cast("double").alias("n"),
            total(F.array_distinct(codes), lambda d: F.pow(F.size(F.filter(codes, lambda c: c == d)).cast("double"), F.lit(2.0))).alias("squares"),
            total(codes, lambda c: c).alias("sum"), total(codes, lambda c: (c * c).cast("double")).alias("sum2"),
            total(lag, lambda p: (p["x"] * p["y"]).cast("double")).alias("sum_lag"),
            (codes[0] + F.element_at(codes, -1)).alias("rim"),
            total(codes, lambda c: (2 * c > m["size"]).cast("int")).alias("highs"),
            (total(lag, lambda p: ((2 * p["x"] > m["size"]) != (2 * p["y"] > m["size"])).cast("int")) + 1).alias("turns"),
            total(lag, lambda p: F.get(even, m["offset"] + (p["x"] - 1) * m["size"] + p["y"] - 1)).alias("odds"))

    def scored(m: Column) -> Column:
        n, free, mean = m["n"], m["size"] - 1, m["sum"] / m["n"]
        expected = 2 * m["highs"] * (n - m["highs"]) / n + 1
        variance = F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.25))
        spread = m["sum2"] - n * mean * mean
        together = m["sum_lag"] - mean * (2 * m["sum"] - m["rim"]) + (n - 1) * mean * mean
        return F.struct(
            m["start"], m["end"], m["value"], m["encoding"], F.floor(4 * F.log2(n)).cast("int").alias("length_class"), m["odds"],
            ((m["squares"] * m["size"] / n - n - free) / F.sqrt(2 * free)).alias("uniform"),
            ((m["turns"] - expected) / F.sqrt(variance)).alias("runs"),
            F.when(spread > 0.5 / n, (together / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0)).alias("serial"))

    return bound(table, lambda even: F.transform(F.transform(F.transform(found, one), lambda m: measured(m, even)), scored))


def looks_random(m: Column, alpha: float) -> Column:
    """No test of the battery (fields of `m`) rejects randomness, at `alpha` for all three together."""
    one, two = NormalDist().inv_cdf(1 - alpha / 3), NormalDist().inv_cdf(1 - alpha / 6)
    return (m["uniform"] <= one) & (F.abs(m["runs"]) <= two) & (F.abs(m["serial"]) <= two)


def discovery_limits(counts: dict[tuple[str, int], dict[int, tuple[int, int]]], rate: float) -> dict[tuple[str, int], float]:
    """For each encoding and length class the least log-odds at which tokens are taken, so
    that of the tokens taken at most the share `rate` is expected to be ordinary: the step-up
    rule over all tokens, of which those that pass the tests can be taken (counts by bin). An
    ordinary string has log-odds of x or more with probability exp(-x) at most, as the odds
    are 1 on average over ordinary strings."""
    out = {}
    for group, bins in counts.items():
        total, taken, limit = sum(n for n, _ in bins.values()), 0, None
        for b in sorted(bins, reverse=True):
            taken += bins[b][1]
            if taken and math.exp(-b / _BIN) <= rate * taken / total:
                limit = b / _BIN
        if limit is not None:
            out[group] = limit
    return out


def find_secrets(docs: DataFrame, rate: float = 0.002, alpha: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans of every row of `docs`: arrays of start, rank, kind, end, by
    start and rank. base holds the known forms; spans holds these and kind "random".

    Tokens of 20 or more letters of an encoding, with a digit and a letter, are tested
    outside known forms. The encoding is the smallest alphabet that fits. A token is taken
    if the chi-squared, runs and serial-correlation tests leave randomness standing, and its
    letters, their order and the changes of class together are too unlikely for an ordinary
    string: the false discovery rate is held within each encoding and length class, over the
    distinct tokens of all documents, so short tokens, which have less evidence, are
    taken only where many are found. Letter pairs of ordinary strings come from the distinct
    short words of all documents.

    Three passes over the texts, no text moves: the first counts letter pairs of distinct
    words (676 at most), the second distinct tokens by class and tenth of log-odds (a table of
    bounded size), the third applies the limits found. All steps are Column expressions. Texts
    are scanned whole, however long, in work that grows with length times the square root
    of matches; matches of a form do not overlap, spans of two forms may, and spans of equal start are in the order of the
    forms. A missing text is empty, an empty text has no span; a missing id stays missing; repeated rows each get a row. An empty table
    gives an empty result. Other columns are not read.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    pairs = letter_pairs(text, docs)
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"))
    both = rows.select("doc_id", bound(known(F.col("text")), lambda base: F.struct(
        base.alias("base"), tested(candidates(F.col("text"), base), pairs).alias("found"))).alias("x"))
    each = both.select(F.explode("x.found").alias("m")).select("m.*")
    tokens = each.select("encoding", "length_class", F.md5("value").alias("token"), looks_random(F.struct("uniform", "runs", "serial"), alpha).alias("passes"), F.floor(
        F.greatest(F.least("odds", F.lit(float(_MOST))), F.lit(0.0)) * _BIN).cast("int").alias("bin")).distinct()
    counts: dict[tuple[str, int], dict[int, tuple[int, int]]] = {}
    for r in tokens.groupBy("encoding", "length_class", "bin").agg(F.count("token").alias("all"), F.count_if("passes").alias("passing")).collect():
        counts.setdefault((r.encoding, r.length_class), {})[r.bin] = r["all"], r.passing
    limits = discovery_limits(counts, rate)
    table = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(c).alias("c"), F.lit(z).alias("z")) for (e, c), z in sorted(limits.items())])

    def taken(m: Column) -> Column:
        return looks_random(m, alpha) & F.exists(table, lambda t: (t["e"] == m["encoding"]) & (t["c"] == m["length_class"]) & (m["odds"] >= t["z"]))

    def with_random(x: Column) -> Column:
        random = F.transform(F.filter(x["found"], taken), lambda m: F.struct(
            m["start"], F.lit(len(FORMS)).alias("rank"), F.lit("random").alias("kind"), m["end"])) if limits else F.array()
        return F.struct(x["base"], F.array_sort(F.concat(x["base"], random.cast(_SPAN))).alias("spans"))

    return both.select("doc_id", bound(F.col("x"), with_random).alias("x")).select("doc_id", "x.base", "x.spans")


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
