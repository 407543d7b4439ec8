"""Golden rows of the text rules."""

import pytest
from pyspark.sql import functions as F

from qaweave.functions import text as X
from qaweave.operators import clean, quads

GRAPH = "<https://A.example/faq>   ."


def apply(spark, rule, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", rule(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


@pytest.mark.parametrize("line, expected", [
    (f'_:q1 <http://schema.org/name> "How long does it take?"@en {GRAPH}', ("_:q1", "How long does it take?")),
    (f"_:q1 <http://schema.org/acceptedAnswer> _:a1 {GRAPH}", ("_:q1", "_:a1")),
    (f'_:a1 <http://schema.org/text> "<p>Two&amp;nbsp;days.</p>" {GRAPH}', ("_:a1", "Two\xa0days.")),
    (f"_:x <http://schema.org/url> <https://b.example/> {GRAPH}", None),
    (f'_:x <http://schema.org/urlTemplate> "t" {GRAPH}', None),
    ('_:x <http://schema.org/name> "t" <https://A.example/faq> .', None),
    (f'_:x <http://schema.org/name> "a > b >" {GRAPH}', ("_:x", "a > b ")),
    (f'_:x <http://schema.org/name> "say \\"hi\\" to "x""^^<http://t> {GRAPH}', ("_:x", 'say "hi" to "x"')),
    (f'_:x <http://schema.org/name> "a"@en class= {GRAPH}', ("_:x", "a")),
    (f'_:x <http://schema.org/name> "" {GRAPH}', ("_:x", "")),
    (f'  <http://s> <http://schema.org/text> "one\\r\\n \\n two\\tthree"   {GRAPH}  ', None),
    (f'  <http://s> <http://schema.org/text> "one\\r\\n \\n two\\tthree" {GRAPH}  ', ("http://s", "one\ntwo three")),
    (f'<http://s> <http://schema.org/text> "x <script>var a=1;</script><b>y</b><br>z" {GRAPH}', ("http://s", "x y z")),
    (f'<http://s> <http://schema.org/text> "caf\\u00e9" {GRAPH}', ("http://s", "caf\\u00e9")),
])
def test_quad_lines(spark, line, expected):
    df = spark.createDataFrame([("f", 0, line)], "file string, pos long, value string")
    found = [(r.subject, r.object) for r in quads.parse_quads(df).collect()]
    assert found == ([] if expected is None else [expected])


def test_newlines(spark):
    values = ["a\\nb", " a \\r\\n \\n b ", "a\n\n\nb", "\\n", "no break", "\x1fa "]
    assert apply(spark, X.normalize_newlines, values) == ["a\nb", "a\nb", "a\nb", "", "no break", "a"]


def test_qa_filters(spark):
    q, a = "q" * 10, "a" * 30
    cases = [
        (q, a, True), (q, a + "?", False), (q, a + "？", True), ("q" * 9, a, False),
        (q, "a" * 29, False), (q, a + "\nx" * 9, True), (q, a + "\nx" * 10, False),
        ("é" * 10, "é" * 30, True), ("", a, False), (q, "", False),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)],
                               "i int, question string, answer string")
    kept = {r.i for r in clean.qa_filters(df).collect()}
    assert kept == {i for i, c in enumerate(cases) if c[2]}


def test_prefixes(spark):
    values = ["Q:  What now", "q: x", "1. Where", "1.2 Where", "1 Where", "Question: Q: x",
              "Q: Question: 3. x", "٣. Where", "Quiet", "12.3 x"]
    expected = ["What now", "q: x", "Where", "Where", "1 Where", "Q: x", "x", "Where", "Quiet", "x"]
    assert apply(spark, X.strip_question_prefixes, values) == expected
    assert apply(spark, X.strip_answer_prefixes, ["A: 2. b", "Answer: b", "Q: b"]) == ["b", "b", "Q: b"]


def test_quotes(spark):
    values = ['"quoted"', "“a”", "„a“", "„a”", "‟a”", "‘a’", '"', "“", '"a"b"', '"“a”"', 'a"', '"a\nb"', ""]
    expected = ["quoted", "a", "a", "a", "a", "a", "", "“", 'a"b', "a", 'a"', "a\nb", ""]
    assert apply(spark, X.strip_quotes, values) == expected


def test_emoji(spark):
    family = "👨‍👩‍👧‍👦"
    values = ["x😀 y", f"a{family}b", "1️⃣ 12 #", "❤️ ok 👍🏽", "end🇩🇪", "™ ©", "日本語…“ok”", "plain", "🏴󠁧󠁢󠁥󠁮󠁧󠁿 x"]
    expected = ["x y", "ab", "12 #", "ok", "end", "", "日本語…“ok”", "plain", "x"]
    assert apply(spark, X.strip_emoji, values) == expected


def test_scheme_host(spark):
    cases = {
        "http://a.example:8080/x": "http://a.example", "HTTPS://A.Example/x": "HTTPS://a.example",
        "http://u@a.example/": None, "a.example/x": None, "http://ex.example/a|b": "http://ex.example",
        "http://[::1]/x": None, "http://a.example?q=1": "http://a.example", "http:///x": None,
    }
    assert apply(spark, X.scheme_host, list(cases)) == list(cases.values())


def test_iso_codes(spark):
    assert apply(spark, X.map_iso_code, ["en", "deu", "zz", "zh", "ceb", "simple"]) == [
        "eng", "deu", None, "zho", "ceb", None]


def test_scores(spark):
    cases = {
        "85": 85, "Score: 90": 90, "Score: **70**": 70, "I would score this 60": 60, "a solid 75/100": 75,
        "\n\n 88 \n": 88, "no idea": -1, "1000": -1, "Score: 1000": 100, "nothing\nScore: 5\n7": 5,
        "It is **40** out of 100": 40, "It is **41 out of 100**": 41, "I would give it **30**": 30,
    }
    assert apply(spark, X.parse_score, list(cases)) == list(cases.values())


def test_labels(spark):
    topics = {"3": 3, "Label: 3": 3, "label: 3": 3, "3)": 3, "3) Health": 3, "9": None, "0": None, "LABEL: 3": None}
    kinds = {"10": 10, "Label: 10": 10, "10)": 10, "10) x": 10, "11": None, "1": 1, "0)": None, "|)": None}
    assert apply(spark, lambda c: X.parse_label(c, 8), list(topics)) == list(topics.values())
    assert apply(spark, lambda c: X.parse_label(c, 10), list(kinds)) == list(kinds.values())


def test_id_is_md5_of_utf8(spark):
    import hashlib

    df = spark.createDataFrame([("Größe?\nja", "日本\n語")], "question string, answer string")
    text = "Größe? ja 日本 語"
    assert clean.add_id(df).first().id == hashlib.md5(text.encode()).hexdigest()


def test_language_detector(spark):
    known = [("en", "the quick brown fox and the other dog"), ("de", "der schnelle braune Fuchs und die Katze")]
    df = spark.createDataFrame(known * 3, "lang string, text string")
    detector = clean.model_detector(clean.train_language_model(df, "text", "lang"))
    rows = spark.createDataFrame([("the other fox", "and the dog"), ("der andere Fuchs", "und die Katze")],
                                 "question string, answer string")
    found = clean.detect_language(rows, detector)
    assert {(r.question, r.language) for r in found.collect()} == {
        ("the other fox", "eng"), ("der andere Fuchs", "deu")}
    assert clean.detect_language(rows, detector, 1.1).count() == 0


def test_grams_of_many_texts_at_once():
    import numpy as np

    from qaweave.functions import grams

    def one(text):
        codes = [ord(c) for c in f" {text} "]
        return [((a * 1000003 + b * 8191 + c) * 0x9E3779B97F4A7C15 % 2**64) >> 20 for a, b, c in zip(codes, codes[1:], codes[2:])]

    texts = ["", "a", "ab", "Über \U0001F600 daß", "", "x" * 200_000, "the end"]
    of, found = grams.hashed(texts)
    assert [found[of == i].tolist() for i in range(len(texts))] == [one(t) for t in texts]
    weights = np.random.default_rng(1).random((64, 3))
    want = [sum((weights[g % 64] for g in one(t)), np.zeros(3)) for t in texts]
    assert np.allclose(grams.sums(texts, weights), want)
    signed = grams.signed_counts(texts, 16)
    for t, row in zip(texts, signed):
        own = np.zeros(16)
        for g in one(t):
            own[(g >> 1) % 16] += 1 if g & 1 else -1
        assert (row == own).all()
    assert grams.signed_counts([], 4).shape == (0, 4) and grams.sums([], weights).shape == (0, 3)


def test_html_without_formatting():
    from qaweave.functions.text import html_to_text

    golden = {
        "<ul><li>one</li><li>two</li></ul>": "one two", "<p>a</p>\n\n<p>b<br/>c</p>": "a b c", "a <b>b</b>c": "a bc",
        "<div>x<script>if (a < b) {}</script>y</div>": "xy", "1 < 2 &amp; 3": "1 < 2 & 3", "<!-- no --><td>t\tu</td>": "t u",
        "": "", "<p></p>": "", "<a href='/x>y'>link</a> after": "link after", "<H1>Big</H1>small": "Big small"}
    assert {k: html_to_text(k) for k in golden} == golden


def test_only_written_breaks_count_as_lines(spark):
    """An answer of many block tags has no line breaks; written-out ones stay."""
    from qaweave.functions import text as X

    df = spark.createDataFrame([('"' + "<p>x</p>" * 20 + '"@en',), ('"a\\nb<br>c"',)], "v string")
    got = [r.v for r in X.decode_literals(df, "v").collect()]
    assert got == [" ".join("x" * 20), "a\nb c"]
