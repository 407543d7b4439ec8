"""Quality rules by tokeniser fertility, with rejection bands per language."""

from __future__ import annotations

from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaweave.llm.texts import Words, encoded, kept_in_worker, mixed, row_key, sliced
from qaweave.session import stored

TOKENIZER = "piece_bpe_32k.model"
SYMBOLS = b"#*$%&|<>"
#: Least number of words, and the largest share of words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: A band's scale is at least this, so that a group without spread rejects nothing near it.
LEAST_SCALE = {"chars_per_token": 0.02, "entropy": 0.05, "byte_share": 0.05}

ALL_SIZES = -1

_RULES = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
                    ("n_repeat_words", pa.int64()), ("tokens", pa.int64()), ("byte_tokens", pa.int64()), ("entropy", pa.float64())])


class PieceIds:
    """Token ids of words of a SentencePiece vocabulary, each distinct word encoded once;
    at most `most` words are kept."""

    def __init__(self, path: str, most: int = 250_000):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.most, self.known = most, {}

    def documents(self, docs: list[list[bytes]]) -> list[bytes]:
        """Ids of each document as 32-bit integers."""
        known = self.known
        missing = list(set().union(*docs).difference(known))
        if len(known) + len(missing) > self.most:
            known = {w: known[w] for w in set().union(*docs).intersection(known)}
        ids = self.model.encode([w.decode() for w in missing], num_threads=1) if missing else []
        known.update((w, array("i", x).tobytes()) for w, x in zip(missing, ids))
        get = known.__getitem__
        return [b"".join(map(get, d)) for d in docs]


def repeated_words(words: Words, size: int) -> np.ndarray:
    """For each document, the words in windows of `size` words found twice or more in it."""
    starts = words.window_starts(size)
    depth = np.zeros(words.total + 1, np.int64)
    if len(starts):
        of = np.searchsorted(words.first, starts, side="right") - 1
        key = words.hashes(starts, starts + size - 1) ^ mixed(of.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = starts[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        np.add.at(depth, twice, 1)
        np.add.at(depth, twice + size, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(depth[:-1]) > 0)))
    return covered[words.first[1:]] - covered[words.first[:-1]]


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measures(docs: DataFrame, tokenizer: str | None = None, window: int = 5, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """id, th, doc_id, lang, counts of each text and what its tokens are like."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def run(batches):
        pieces = kept_in_worker(f"pieces {path}", lambda: PieceIds(path))
        for batch in sliced(batches):
            texts = encoded(batch)
            docs_ = [t.split() for t in texts]
            words = Words(docs_)
            data = np.frombuffer(words.joined, np.uint8)
            chars, symbols = (np.concatenate(([0], np.cumsum(x))) for x in (((data & 0xC0) != 0x80) & (data != 32), symbol[data]))
            some = words.counts > 0
            a, b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            a[some], b[some] = words.starts[words.first[:-1][some]], words.ends[words.first[1:][some] - 1]
            tokens, byte_tokens, entropy = [], [], []
            for ids in pieces.documents(docs_):
                ids = np.frombuffer(ids, np.int32)
                counts = np.bincount(ids)
                n = len(ids)
                tokens.append(n)
                byte_tokens.append(int(counts[pieces.is_byte[:len(counts)]].sum()))
                share = counts[counts > 0] / max(n, 1)
                entropy.append(float(-(share * np.log2(share)).sum()) if n else 0.0)
            columns = [words.counts, chars[b] - chars[a], symbols[b] - symbols[a], [duplicate_lines(t) for t in texts],
                       repeated_words(words, window), tokens, byte_tokens, entropy]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "th", "doc_id", "lang")), *(pa.array(c, f.type) for c, f in zip(columns, _RULES))],
                ["id", "th", "doc_id", "lang", *_RULES.names])

    base = docs.select(*row_key(docs, id_col, text_col), docs[id_col].cast("long").alias("doc_id"),
                       docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"))
    return base.mapInArrow(run, "id long, th long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, "
                                "n_dup_lines long, n_repeat_words long, tokens long, byte_tokens long, entropy double")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(rows: DataFrame, width: float, least_docs: int) -> DataFrame:
    """lang, size_class and the bounds of each measure: median and `width` times the median
    deviation (as a standard deviation) over all distinct texts of a language and size that
    pass the base rules, and over those of all its sizes (size_class ALL_SIZES): copies count
    once, or a text copied often would narrow the band to itself. Groups of fewer texts than
    `least_docs` have no band."""
    names = list(LEAST_SCALE)
    keys = ["lang", "size_class"]
    once = stored(rows.filter("not base_failed").groupBy("lang", "th").agg(
        *[F.first(c).alias(c) for c in ["size_class", *names]]), "distinct-measures")
    fit = once.withColumn("size_class", F.explode(F.array("size_class", F.lit(ALL_SIZES))))
    middle = stored(fit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("docs"), *[F.percentile_approx(m, 0.5, 1000).alias(f"{m}_mid") for m in names]
    ).filter(F.col("docs") >= least_docs).select(*[F.col(k).alias(f"m_{k}") for k in keys], *[f"{m}_mid" for m in names]), "band-middles")
    off = fit.join(middle, F.col("lang").eqNullSafe(F.col("m_lang")) & (F.col("size_class") == F.col("m_size_class")))
    spread = off.groupBy(*keys).agg(
        *[F.first(f"{m}_mid").alias(f"{m}_mid") for m in names],
        *[F.percentile_approx(F.abs(F.col(m) - F.col(f"{m}_mid")), 0.5, 1000).alias(f"{m}_off") for m in names])
    reach = {m: width * F.greatest(1.4826 * F.col(f"{m}_off"), F.lit(least)) for m, least in LEAST_SCALE.items()}
    return spread.select(
        *[F.col(k).alias(f"b_{k}") for k in keys],
        *[(F.col(f"{m}_mid") - reach[m]).alias(f"{m}_low") for m in names], *[(F.col(f"{m}_mid") + reach[m]).alias(f"{m}_high") for m in names])


def quality(docs: DataFrame, width: float = 4.0, least_docs: int = 50, tokenizer: str | None = None, id_col: str = "doc_id",
            text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, fertility and verdict of every row of `docs`: the columns of `measures`, then
    base_failed, chars_per_token, byte_share, size_class and kept.

    A public SentencePiece vocabulary cuts every word of a text. Characters per token, share
    of byte-fallback tokens and entropy of the tokens are held against the band of the
    text's language and size class (the power of two below its number of tokens, as short
    texts have less entropy); one measure outside rejects, as does a base rule. Bands come
    from the distinct texts of all documents, by mergeable quantile sketches.

    Texts are measured whole, however long; texts of equal measures, language and size get
    the same verdict. A missing text is empty and fails the base rules; a missing language is a group of its
    own; sizes too rare for a band take the language's for all sizes (entropy aside), and
    languages too rare for one reject by the base rules only. Repeated rows each get
    a row, and texts count once in a language's bands. An empty table gives an empty result. Other columns are not read.
    """
    rows = stored(measures(docs, tokenizer, 5, id_col, text_col, lang_col), "measures").withColumns({
        "base_failed": base_failed(),
        "chars_per_token": F.col("word_chars") / F.greatest("tokens", F.lit(1)),
        "byte_share": F.col("byte_tokens") / F.greatest("tokens", F.lit(1)),
        "size_class": F.floor(F.log2(F.greatest("tokens", F.lit(16)))).cast("int"),
    })
    limits = stored(bands(rows, width, least_docs), "bands")
    # A size without a band takes its language's, but for the entropy, which goes with size.
    wide = limits.filter(F.col("b_size_class") == ALL_SIZES).drop("b_size_class").withColumnsRenamed(
        {c: f"all_{c}" for c in limits.columns if c != "b_size_class"})
    joined = (
        rows.join(limits, F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("size_class") == F.col("b_size_class")), "left")
        .join(wide, F.col("lang").eqNullSafe(F.col("all_b_lang")) & F.col("b_size_class").isNull(), "left")
    )

    def inside(m: str) -> Column:
        own = F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
        low, high = F.col(f"all_{m}_low"), F.col(f"all_{m}_high")
        # A mean over few tokens strays more.
        stray = F.greatest(F.lit(1.0), F.sqrt(F.lit(256) / F.greatest("tokens", F.lit(1))))
        other = F.abs(F.col(m) - (low + high) / 2) <= (high - low) / 2 * stray
        return F.coalesce(own, F.lit(True) if m == "entropy" else other, F.lit(True))

    verdict = inside("chars_per_token") & inside("byte_share") & inside("entropy")
    return joined.select(*rows.columns, (~F.col("base_failed") & verdict).alias("kept"))
