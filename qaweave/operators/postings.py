"""Held queries against the inverted index of a chunk of documents.

Terms are 64-bit hashes. A chunk of the documents that stream past a task is turned
around once: for each term of the held queries its documents and their shares. Scores
of a query are added term by term; terms that many documents hold are rows of a matrix
and their scores a product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Documents and postings of a chunk (each, 16 bytes a posting); terms that are rows of its matrix.
CHUNK_DOCS, CHUNK_POSTINGS, MOST_COMMON = 16384, 6_000_000, 128
#: Queries scored together; share of a chunk that makes a term common; postings of a rare term.
TOGETHER, COMMON_SHARE, RARE = 128, 1 / 8, 64
#: Scores that differ by less can be equal once rounded.
NEAR = 2e-9
#: A piece of an index, one row: its documents and their sizes, its terms and how many documents hold
#: each, and for each term those documents and how often they hold it (compressed numbers).
PIECE = ("language string, part bigint, names array<string>, n_names int, doc_len array<int>, codes array<bigint>, "
         "sizes array<int>, docs binary, counts binary, bytes array<int>")


class Queries:
    """The terms of held queries: lists `codes` and `weights`."""

    def __init__(self, held: pa.Table):
        codes = held.column("codes").combine_chunks()
        self.n = len(held)
        self.first = codes.offsets.to_numpy() - codes.offsets[0].as_py()
        self.known, term = np.unique(codes.flatten().to_numpy(), return_inverse=True)
        self.term = term.astype(np.int32)
        self.weight = held.column("weights").combine_chunks().flatten().to_numpy()


class Chunk:
    """Postings (document, share) of `n` documents, in order of their terms; those of term t
    begin at first[t]."""

    def __init__(self, n: int, first: np.ndarray, doc: np.ndarray, share: np.ndarray):
        self.n, self.first, self.doc, self.share = n, first, doc, share
        many = np.diff(first)
        common = np.flatnonzero(many > n * COMMON_SHARE)
        common = common[np.argsort(-many[common], kind="stable")[:MOST_COMMON]]
        self.column = np.full(len(many), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), n))
        for row, t in zip(self.matrix, common):
            a, b = self.first[t], self.first[t + 1]
            row[self.doc[a:b]] = self.share[a:b]

    @classmethod
    def of_rows(cls, n: int, n_terms: int, term: np.ndarray, doc: np.ndarray, share: np.ndarray) -> Chunk:
        """From postings (term, document, share) in any order of terms."""
        order = np.argsort(term, kind="stable")
        first = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=n_terms))))
        return cls(n, first, doc[order].astype(np.int64), share[order])

    @classmethod
    def of_piece(cls, queries: Queries, piece: dict, length) -> Chunk:
        """From a piece of an index (PIECE), as far as the queries have its terms; `length` of
        document sizes is the part of the length in a share."""
        codes, sizes = piece["codes"], piece["sizes"]
        at = np.minimum(np.searchsorted(codes, queries.known), max(0, len(codes) - 1))
        there = codes[at] == queries.known if len(codes) else np.zeros(len(at), bool)
        asked = np.zeros(len(codes), bool)
        asked[at[there]] = True
        many = np.zeros(len(queries.known), np.int64)
        many[there] = sizes[at[there]]
        kept = np.repeat(asked, sizes)
        doc, tf = (_unpacked(piece[c], width, len(kept))[kept] for c, width in zip(("docs", "counts"), piece["bytes"]))
        doc = doc.astype(np.int64)
        return cls(piece["n_names"], np.concatenate(([0], np.cumsum(many))), doc, tf / (tf + length(piece["doc_len"])[doc]))

    def add_terms(self, out: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Adds the scores by terms that are not common to `out`, one place a document."""
        a, b = self.first[term], self.first[term + 1]
        size = b - a
        rare = size <= RARE
        n = size[rare]
        total = int(n.sum())
        if total:
            i = np.arange(total) + np.repeat(a[rare] - np.cumsum(n) + n, n)
            np.add.at(out, self.doc[i], np.repeat(weight[rare], n) * self.share[i])
        # The documents of one term differ, so plain indexing adds them all.
        for s, e, w in zip(a[~rare].tolist(), b[~rare].tolist(), weight[~rare].tolist()):
            out[self.doc[s:e]] += self.share[s:e] * w

    def above(self, queries: Queries, rows: np.ndarray, floor: np.ndarray, k: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of the held `rows`, (row, documents, scores): every document with a score above
        0 that reaches the `floor` of the row, but for rounding; with `k`, only those that
        fewer than k others surpass by more."""
        sums = np.empty((min(TOGETHER, len(rows)), self.n))
        for start in range(0, len(rows), TOGETHER):
            part = rows[start:start + TOGETHER].tolist()
            common, rest = np.zeros((len(part), len(self.matrix))), []
            for i, q in enumerate(part):
                a, b = queries.first[q], queries.first[q + 1]
                term, weight = queries.term[a:b], queries.weight[a:b]
                column = self.column[term]
                often = column >= 0
                common[i, column[often]] = weight[often]
                rest.append((term[~often], weight[~often]))
            every = np.matmul(common, self.matrix, out=sums[:len(part)])
            for q, row, (term, weight) in zip(part, every, rest):
                self.add_terms(row, term, weight)
                least = floor[q] - NEAR
                docs = np.flatnonzero(row >= least) if least > 0 else np.flatnonzero(row > 0)
                score = row[docs]
                if k and len(docs) > 2 * k:
                    there = score >= np.partition(score, -k)[-k] - NEAR
                    docs, score = docs[there], score[there]
                yield q, docs, score


def _packed(numbers: np.ndarray) -> tuple[bytes, int]:
    """Compressed whole numbers from 0, and the bytes of each."""
    kind = np.min_scalar_type(numbers.max(initial=0))
    return pa.compress(numbers.astype(kind).tobytes(), codec="zstd", asbytes=True), kind.itemsize


def _unpacked(packed: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, width * n, codec="zstd"), f"u{width}") if n else np.zeros(0, np.uint8)


def indexed(batches: Iterator[pa.RecordBatch], most: int, task: int) -> Iterator[pa.RecordBatch]:
    """Pieces (PIECE) of at most `most` documents and about CHUNK_POSTINGS words, from documents
    (language, doc_id, size, codes) in order of language and id. Rows of one id are one
    document with the words of all and the size of the first."""
    schema = pa.schema([("language", pa.string()), ("part", pa.int64()), ("names", pa.list_(pa.string())), ("n_names", pa.int32()),
                        ("doc_len", pa.list_(pa.int32())), ("codes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
                        ("docs", pa.binary()), ("counts", pa.binary()), ("bytes", pa.list_(pa.int32()))])
    language, names, sizes, parts, words, number = None, [], [], [], 0, 0

    def piece():
        code = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
        doc = np.repeat(np.array([d for d, _ in parts], np.int64), [len(c) for _, c in parts])
        order = np.argsort(code, kind="stable")
        code, doc = code[order], doc[order]
        term = np.ones(len(code), bool)
        term[1:] = code[1:] != code[:-1]
        new = term.copy()
        new[1:] |= doc[1:] != doc[:-1]
        at = np.flatnonzero(new)
        docs, docs_width = _packed(doc[at])
        counts, counts_width = _packed(np.diff(np.append(at, len(code))))
        held = np.diff(np.append(np.flatnonzero(term[at]), len(at)))
        return pa.RecordBatch.from_pylist([{
            "language": language, "part": (task << 32) + number, "names": names, "n_names": len(names), "doc_len": sizes, "codes": code[term],
            "sizes": held, "docs": docs, "counts": counts, "bytes": [docs_width, counts_width]}], schema)

    for batch in batches:
        lists = batch.column("codes")
        first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        for i, (own, name, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("language", "doc_id", "size")))):
            same = bool(names) and own == language and name == names[-1]
            if names and not same and (own != language or len(names) >= most or words >= 2 * CHUNK_POSTINGS):
                yield piece()
                names, sizes, parts, words, number = [], [], [], 0, number + 1
            language = own
            if not same:
                names.append(name)
                sizes.append(size)
            code = codes[first[i]:first[i + 1]]
            if len(code):
                parts.append((len(names) - 1, code.copy()))
                words += len(code)
    if names:
        yield piece()


def chunks(queries: Queries, passing: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Chunk]]:
    """Passing documents (row_id, sorted `codes` with repeats, `length`) as chunks, each
    with the ids of its documents."""
    names, parts, n, size = [], [], 0, 0

    def chunk():
        term, doc, share = (np.concatenate(x) for x in zip(*parts))
        return np.concatenate(names), Chunk.of_rows(n, len(queries.known), term, doc, share)

    for batch in passing:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            lists = part.column("codes")
            code, first = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            new = np.ones(len(code), bool)
            new[1:] = code[1:] != code[:-1]
            new[first[:-1][np.diff(first) > 0]] = True
            at = np.flatnonzero(new)
            tf = np.diff(np.append(at, len(code)))
            doc = np.repeat(np.arange(part.num_rows, dtype=np.int32), np.diff(first))[at]
            term = np.minimum(np.searchsorted(queries.known, code[at]), max(0, len(queries.known) - 1))
            there = queries.known[term] == code[at] if len(queries.known) else np.zeros(len(at), bool)
            tf, doc, term = tf[there], doc[there], term[there].astype(np.int32)
            if parts and (n + part.num_rows > CHUNK_DOCS or size + len(doc) > CHUNK_POSTINGS):
                yield chunk()
                names, parts, n, size = [], [], 0, 0
            length = part.column("length").to_numpy(zero_copy_only=False)[doc]
            parts.append((term, doc + np.int32(n), tf / (tf + length)))
            names.append(part.column("row_id").to_numpy(zero_copy_only=False))
            n, size = n + part.num_rows, size + len(doc)
    if parts:
        yield chunk()
