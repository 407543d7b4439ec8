import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, id long, rank int, keep_id string, h string, "
          "row int, th string, removed int, times int, __gone int, __n int, __id int, __lines int, __times int, node int")


@pytest.fixture
def table(spark):
    """Documents with columns whose names the operators use inside."""

    def make(rows):
        full = [(i, t, lang, source, len(t or ""), 7, 8, 9, "x", "y", 1, "z", *range(8)) for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(6000))
PASSAGE = " ".join(f"p{i}" for i in range(60))

#: Nulls in every column, empty and blank texts, a very long text, ties, repeated rows.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again", "en", "a"), (2, "the quick brown fox jumps over the lazy dog again", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog again", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \t\n \r ", "de", "b"),
    (None, "one two three four five six", "en", "a"), (None, "one two three four five six", None, None), (6, LONG, "fr", "a"), (7, LONG + " tail", "fr", None),
    (8, "alpha " + PASSAGE + " omega", "en", "c"), (9, "beta " + PASSAGE + " psi", "en", "c"), (9, "gamma " + PASSAGE + " chi", "en", "c"),
    (10, "x", "en", "a"), (11, "ß É ́ \U0001F600 <|endoftext|> it's 42", "de", "\U0001F600"), (12, "one two three four five six\n\none two three four 5 six", "en", "a"),
]


@pytest.fixture
def odd(table):
    return table(ODD)


@pytest.fixture
def empty(table):
    return table([])
