"""Best-fit packing by minimum bin slack over the table of piece lengths."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from qaweave.llm.ranks import ranked
from qaweave.llm.texts import kept_in_worker, sliced
from qaweave.session import stored

TOKENIZER = "word_bpe_49k.json"
#: Characters of a word that is kept at most; new words since a table was full, in its sizes.
LONGEST, RENEWED = 64, 4


class Kept(dict):
    """Values of `make` by key, at most `most` of them, made as they are asked for. Once it
    is full new keys are made each time; after several times `most` of these it starts anew,
    as the texts may have turned to other words."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.missed = make, most, 0

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < self.most:
            if len(key) <= LONGEST:
                self[key] = value
        else:
            self.missed += 1
            if self.missed >= RENEWED * self.most:
                self.clear()
                self.missed = 0
        return value


class WordIds:
    """Token ids of texts, each distinct word tokenised once while it is kept.

    The tokenizer drops white space and never joins over it, so the ids of a text are
    those of its words. Words of Latin letters with plain marks behind them go to the
    model as a lower-case stem and its marks; all others, and texts with a special token
    in them, pass the whole tokenizer. At most `most` words and stems are kept.
    """

    _plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

    def __init__(self, path: str, most: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.stems = Kept(self.word, most), Kept(self.stem, most)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_names = {b: chr(256 + i) for i, b in enumerate(hidden)}

    def stem(self, text: str) -> bytes:
        # Letters and marks of ASCII are their own names.
        names = text if text.isascii() else text.encode().decode("latin-1").translate(self.byte_names)
        return array("I", [t.id for t in self.model.tokenize(names)]).tobytes()

    def word(self, text: str) -> bytes:
        if m := self._plain(text):
            letters, marks = m.groups()
            ids = self.stems[letters.lower()]
            return ids + self.stems[marks] if marks else ids
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        get, out = self.words.__getitem__, []
        for t in texts:
            if any(s in t for s in self.special):
                out.append(array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes())
            else:
                words = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                out.append(b"".join(map(get, words)))
        return out


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and a closing 0,
    cut into pieces of `capacity` only if there are more. A missing text is empty and
    gives one piece of one id."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        ids_of = kept_in_worker(f"ids {path}", lambda: WordIds(path))
        for batch in sliced(batches):
            doc_ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for doc_id, ids in zip(doc_ids, ids_of.texts(texts)):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return base.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: Counter, capacity: int) -> list[tuple[int, int]]:
    """The fullest bin that holds the longest piece left: (length, how many) pairs.

    Bits of an integer are the sums that the lengths so far can reach, longest first,
    each as often as there are pieces; the search ends once the bin can be filled.
    """
    lengths = sorted(counts, reverse=True)
    room = capacity - lengths[0]
    full, sums, items = (1 << (room + 1)) - 1, [1], []
    for a in lengths:
        if a > room:
            continue
        left, k = min(counts[a] - (a == lengths[0]), room // a), 1
        while left > 0:
            k = min(k, left)
            items.append((a, k))
            sums.append((sums[-1] | sums[-1] << a * k) & full)
            left, k = left - k, 2 * k
        if sums[-1] >> room & 1:
            break
    at, bin_ = sums[-1].bit_length() - 1, Counter({lengths[0]: 1})
    for (a, k), before in zip(reversed(items), reversed(sums[:-1])):
        if not before >> at & 1:
            bin_[a] += k
            at -= a * k
    return sorted(bin_.items(), reverse=True)


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins of minimum slack until no piece is left: (how often, the bin). A bin is taken
    as often as the pieces allow, so each step uses up a length, and the number of steps
    depends on the number of lengths, not of pieces."""
    left, out = Counter({a: n for a, n in counts.items() if n}), []
    while left:
        bin_ = fullest(left, capacity)
        times = min(left[a] // k for a, k in bin_)
        out.append((times, bin_))
        for a, k in bin_:
            left[a] -= times * k
            if not left[a]:
                del left[a]
    return out


def places(found: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, pieces of this length in a bin, first bin, offset), by
    length and rank: where the pieces of a length go, in order of their rank."""
    rows, used, sequence = [], Counter(), 0
    for times, bin_ in found:
        offset = 0
        for a, k in bin_:
            rows.append((a, used[a], k, sequence, offset))
            used[a] += times * k
            offset += a * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id",
         text_col: str = "text", run_rows: int = 20_000) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset, one row per piece.

    Pieces of one length are alike for packing, so the bins are found on the table of
    lengths, which has at most `capacity` rows whatever the corpus; the driver holds only
    it and the bins' patterns (a few for each length). Tasks then number the pieces of each
    length (long groups in runs) and look their bin up. Texts are read once and never
    move; lost tasks are repeated from stored pieces.

    A missing text is empty; a missing id stays missing; repeated rows are packed as often
    as they come. An empty table gives an empty result. Other columns are not read.
    """
    cut = stored(pieces(docs, capacity, tokenizer, id_col, text_col), "pieces")
    lengths = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    table = places(patterns({r.length: r.n for r in lengths.collect()}, capacity))
    keys = table[:, 0] << 44 | table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        a, r = length.to_numpy(), rank.to_numpy()
        row = table[np.searchsorted(keys, a << 44 | r, side="right") - 1]
        k = r - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + k // row[:, 2], "offset": row[:, 4] + k % row[:, 2] * a})

    # One row for each length, at most `capacity`.
    counted = cut.join(F.broadcast(lengths), "length").withColumn("draw", F.xxhash64("doc_id", "piece", "ids_crc32"))
    return (
        ranked(counted, ["length"], "n", "draw", run_rows).withColumn("at", place("length", "rank"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
    )
