"""Near-dedup by verified Jaccard similarity: fingerprints only find the candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaweave.llm.components import components
from qaweave.llm.simhash import distance_of, links, majority_bits, names, shingles
from qaweave.llm.texts import encoded, mixed, row_key, sliced
from qaweave.session import stored

#: Candidates meet by the least hashes of their shingles: bands, and hashes of a band.
BANDS, BAND_HASHES = 16, 4


def shingle_sets(texts: list[bytes], size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles, text after text, and their numbers."""
    digest = xxhash.xxh64_digest
    sets = [np.unique(np.frombuffer(b"".join([digest(s, seed) for s in shingles(t.lower().split(), size)]), ">u8").astype(np.uint64)) for t in texts]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)


def band_keys(hashes: np.ndarray, n: np.ndarray, bands: int = BANDS, rows: int = BAND_HASHES) -> np.ndarray:
    """For each set its `bands` keys, each of `rows` least hashes. Two sets of similarity s
    share a key with probability 1 - (1 - s ** rows) ** bands, 0.9998 at 0.8."""
    out = np.zeros((len(n), bands), np.uint64)
    has = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[has]
    if len(has):
        for k, by in enumerate(np.random.default_rng(3).integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)):
            out[has, k // rows] = mixed(out[has, k // rows] ^ np.minimum.reduceat(mixed(hashes * by), starts) + np.uint64(k + 1))
    return out


def similar_links(hashes: np.ndarray, n: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between sets (rows of `n`) of at least this Jaccard similarity that connect just
    those that all such pairs connect.

    The first set left and all sets similar to it are a ball. Jaccard distance is a metric,
    so a set outside that is similar to one of the ball lies within twice the distance of its
    centre; only those are held against the ball."""
    token = np.unique(hashes, return_inverse=True)[1].reshape(-1)
    mark = np.zeros(len(token) + 1, bool)

    def alike(one: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        mark[one] = True
        sums = np.concatenate(([0], np.cumsum(mark[tokens])))
        mark[one] = False
        ends = np.cumsum(counts)
        common = sums[ends] - sums[ends - counts]
        return common / np.maximum(len(one) + counts - common, 1)

    rest, tokens, counts = np.arange(len(n)), token, n
    while len(rest) > 1:
        own = alike(tokens[:counts[0]], tokens, counts)
        inside = own >= similarity
        inside[0] = True
        of = np.repeat(inside, counts)
        ball, ball_tokens, ball_counts = rest[inside], tokens[of], counts[inside]
        near = (own >= 2 * similarity - 1 - 1e-9)[~inside]
        rest, tokens, counts = rest[~inside], tokens[~of], counts[~inside]
        if len(ball) == 1:
            continue
        yield np.full(len(ball) - 1, ball[0]), ball[1:]
        ends = np.cumsum(counts)
        for r in np.flatnonzero(near):
            hit = ball[alike(tokens[ends[r] - counts[r]:ends[r]], ball_tokens, ball_counts) >= similarity]
            if len(hit):
                yield np.full(1, rest[r]), hit[:1]


def signatures(docs: DataFrame, size: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, th, doc_id, node (a hash of the set of shingles), the fingerprint of that set and
    its band keys for every row."""
    columns = names(words)

    def run(batches):
        for batch in sliced(batches):
            hashes, n = shingle_sets(encoded(batch), size)
            ends = np.cumsum(n)
            node = np.array([xxhash.xxh64_intdigest(hashes[e - k:e].tobytes()) for e, k in zip(ends, n)], np.uint64)
            fps = [majority_bits(mixed(hashes + np.uint64(k)) if k else hashes, n) for k in range(words)]
            keys = band_keys(hashes, n).view(np.int64)
            bands = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * BANDS, keys.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), *(pa.array(c.view(np.int64)) for c in (node, *fps)), bands],
                ["id", "th", "doc_id", "node", *columns, "bands"])

    base = docs.select(*row_key(docs, id_col, text_col), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return base.mapInArrow(run, ", ".join(f"{c} long" for c in ["id", "th", "doc_id", "node", *columns]) + ", bands array<long>")


def verified_links(members: DataFrame, similarity: float, size: int) -> DataFrame:
    """a, b: links between nodes of one candidate group (columns grp, node, text; one row a
    node) that connect just those that pairs of at least `similarity` connect. Groups pass
    the task as a sorted stream; one group at most is held at a time."""

    def sets(batches):
        for batch in sliced(batches):
            hashes, n = shingle_sets(encoded(batch), size)
            blobs = [hashes[e - k:e].tobytes() for e, k in zip(np.cumsum(n), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["grp", "node", "hashes"])

    def run(batches):
        group, nodes, blobs = None, [], []

        def flush():
            hashes, n = np.frombuffer(b"".join(blobs), np.uint64), np.array([len(b) // 8 for b in blobs], np.int64)
            ids = np.array(nodes, np.int64)
            pairs = list(similar_links(hashes, n, similarity))
            a, b = (ids[np.concatenate([p[i] for p in pairs])] if pairs else ids[:0] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for g, node, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if g != group and nodes:
                    yield flush()
                    nodes, blobs = [], []
                group = g
                nodes.append(node)
                blobs.append(blob)
        if nodes:
            yield flush()

    found = members.select("grp", "node", "text").mapInArrow(sets, "grp long, node long, hashes binary")
    return found.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long")


def similar_dedup(docs: DataFrame, similarity: float = 0.8, size: int = 5, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, doc_id and node of every row of `docs`. Rows share a node if chains of texts
    connect them, each of at least `similarity` to the next: the Jaccard similarity of the
    sets of `size` words (of shorter texts, all words).

    Texts of one set are folded. Sets meet in the buckets of `band_keys` and are candidates
    if their SimHash fingerprints are within the distance of `similarity` and five standard
    deviations, a bucket giving a forest. The chains of candidates are groups; within each,
    similarities are computed from the sets themselves, so a link is never a guess. A pair at
    the bound is missed if no bucket holds both (2 in 10,000).

    A missing text is empty; texts without words are alike, and like no other. Repeated rows
    each get a row. An empty table gives an empty result. Other columns are not read.
    """
    columns = names(words)
    mean = distance_of(similarity, words)
    far = math.ceil(mean + 5 * math.sqrt(mean * (1 - mean / (64 * words))))
    rows = stored(signatures(docs, size, words, id_col, text_col), "signatures")
    nodes = rows.groupBy("node").agg(F.min(F.struct("id", "th")).alias("k"), *[F.first(c).alias(c) for c in [*columns, "bands"]])
    buckets = F.transform("bands", lambda b, i: F.xxhash64(i, b))
    groups = components(stored(links(nodes, columns, buckets, far, 2), "candidates")).withColumnRenamed("node", "n")
    keys = nodes.join(groups, F.col("node") == F.col("n")).select(F.col("root").alias("grp"), "node", F.col("k.id").alias("i"), F.col("k.th").alias("t"))
    texts = docs.select(*row_key(docs, id_col, text_col), docs[text_col].alias("text"))
    members = texts.join(keys, (F.col("id") == F.col("i")) & (F.col("th") == F.col("t"))).select("grp", "node", "text").dropDuplicates(["node"])
    roots = components(stored(verified_links(members, similarity, size), "similar")).withColumnRenamed("node", "n")
    return rows.join(roots, F.col("node") == F.col("n"), "left").select("id", "th", "doc_id", F.coalesce("root", "node").alias("node"))
