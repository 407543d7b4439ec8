"""SimHash near-dedup: fingerprints, and pairs found with tables of pivot distances."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaweave.llm.components import components
from qaweave.llm.texts import encoded, mixed, row_key, sliced
from qaweave.session import stored

_LANES = np.uint64(0x0101010101010101)


def shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    """All runs of `size` words, joined by blanks; of fewer words, the whole sequence."""
    if not words:
        return
    text = b" ".join(words)
    if len(words) <= size:
        yield text
        return
    at, starts = 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*(a - 1 for a in starts[size:]), len(text)]
    for a, b in zip(starts, ends):
        yield text[a:b]


def majority_bits(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For texts with n hashes each, in order: bit i is set if it is set in over half."""
    out = np.zeros(len(n), np.uint64)
    if not n.sum():
        return out
    # Blocks of at most 255 hashes of one text: a byte lane holds the count of one bit.
    blocks = -(-n // 255)
    of = np.repeat(np.arange(len(n)), blocks)
    within = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    block_starts = (np.cumsum(n) - n)[of] + within * 255
    has = np.flatnonzero(blocks)
    text_starts = (np.cumsum(blocks) - blocks)[has]
    for plane in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(plane) & _LANES, block_starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), text_starts, axis=0)
        set_ = 2 * sums > n[has][:, None]
        for lane in range(8):
            out[has] |= set_[:, lane].astype(np.uint64) << np.uint64(8 * lane + plane)
    return out


def fingerprints(texts: list[bytes], size: int, seed: int, words: int = 1) -> np.ndarray:
    """`words` columns of 64 bits for each text. Bit i of the first is set if bit i is set in
    over half of the shingles' hashes; further columns take the hashes mixed anew. A text
    without words has fingerprint zero."""
    digest = xxhash.xxh64_digest
    parts, counts = [], []
    for t in texts:
        hashes = [digest(s, seed) for s in shingles(t.lower().split(), size)]
        counts.append(len(hashes))
        parts.append(b"".join(hashes))
    n = np.array(counts, np.int64)
    hashes = np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)
    columns = [majority_bits(mixed(hashes + np.uint64(k)) if k else hashes, n) for k in range(words)]
    return np.stack(columns, axis=1)


def names(words: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, words))]


def fingerprint(docs: DataFrame, size: int = 3, seed: int = 42, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (see row_key), doc_id and the fingerprint's columns fp, fp1, ... of every row."""
    columns = names(words)

    def run(batches):
        for batch in sliced(batches):
            fps = fingerprints(encoded(batch), size, seed, words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), *(pa.array(np.ascontiguousarray(c)) for c in fps.T)], ["id", "th", "doc_id", *columns])

    base = docs.select(*row_key(docs, id_col, text_col), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return base.mapInArrow(run, ", ".join(f"{c} long" for c in ["id", "th", "doc_id", *columns]))


def pivots(count: int, words: int, seed: int = 1) -> np.ndarray:
    """Reference fingerprints: random bits."""
    return np.random.default_rng(seed).integers(0, 1 << 64, (count, words), np.uint64)


def block_masks(blocks: int, distance: int) -> list[tuple[int, ...]]:
    """Masks of all choices of `blocks` - `distance` blocks of 64 bits. Two words that differ
    in at most `distance` bits agree on at least one of them."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << bounds[i + 1]) - 1) ^ ((1 << bounds[i]) - 1) for i in range(blocks)]
    return [(sum(c),) for c in combinations(parts, blocks - distance)]


def sampled_masks(words: int, distance: int, key_bits: int, recall: float, seed: int = 2) -> list[tuple[int, ...]]:
    """Masks of `key_bits` random bits, so many that a pair at `distance` agrees on one of
    them with probability `recall`, and nearer pairs more often."""
    agree = (1 - distance / (64 * words)) ** key_bits
    rng, out = np.random.default_rng(seed), []
    for _ in range(math.ceil(math.log(1 - recall) / math.log(1 - agree))):
        bits = rng.choice(64 * words, key_bits, replace=False)
        out.append(tuple(sum(1 << int(b % 64) for b in bits if b // 64 == k) for k in range(words)))
    return out


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def near_pairs(run: np.ndarray, fps: np.ndarray, refs: np.ndarray, distance: int, slab: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within a run whose fingerprints differ in at most `distance` bits.

    The table holds the distance of each fingerprint to each pivot. By the triangle
    inequality a near pair differs by at most `distance` in every column. Rows are sorted
    by run and first column, so that a row meets only the rows of its band; the other
    columns discard pairs one after another, and the survivors are verified.
    """
    table = np.stack([bits_apart(fps, r) for r in refs])
    key = run * 4096 + table[0]
    order = np.argsort(key, kind="stable")
    key, sorted_run = key[order], run[order]
    ends = np.minimum(np.searchsorted(key, key + distance, side="right"),
                      np.searchsorted(sorted_run, sorted_run, side="right"))
    partners = ends - np.arange(len(key)) - 1
    after = np.cumsum(partners)
    at = 0
    while at < len(key):
        base = after[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(after, base + slab, side="right")))
        n = partners[at:to]
        left = np.repeat(np.arange(at, to), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        left, right = order[left], order[right]
        for column in table[1:]:
            if not len(left):
                break
            ok = np.abs(column[left] - column[right]) <= distance
            left, right = left[ok], right[ok]
        ok = bits_apart(fps[left], fps[right]) <= distance
        if ok.any():
            yield left[ok], right[ok]
        at = to


def crowd_links(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs that connect a crowded run as all its near pairs do. A ball around the first
    row left is connected by its centre; only rows outside are held against its rows, so a
    run of near copies takes a few passes, not one for each row."""
    rest = np.arange(len(fps))
    while len(rest) > 1:
        inside = bits_apart(fps[rest], fps[rest[0]]) <= distance
        ball, rest_ = rest[inside], rest[~inside]
        yield np.full(len(ball), ball[0]), ball
        # A near row of the ball lies within twice the distance of the centre.
        near_ball = rest_[bits_apart(fps[rest_], fps[ball[0]]) <= 2 * distance]
        for r in near_ball:
            hit = ball[bits_apart(fps[ball], fps[r]) <= distance]
            if len(hit):
                yield np.full(1, r), hit[:1]
        rest = rest_


def run_pairs(run: np.ndarray, fps: np.ndarray, refs: np.ndarray, distance: int, above: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs that connect each run as all its near pairs do. Runs of up to `above` rows
    are compared whole. In longer ones, fingerprints of one word meet once for each of
    `distance` + 1 parts, by their value in that part, as a near pair agrees in one of the
    parts at least; wider ones are peeled ball by ball."""
    small = np.bincount(run)[run] <= above
    rows = np.flatnonzero(small)
    if len(rows):
        yield from ((rows[a], rows[b]) for a, b in near_pairs(run[rows], fps[rows], refs, distance))
    rows = np.flatnonzero(~small)
    if len(rows) and fps.shape[1] == 1:
        for (mask,) in block_masks(distance + 1, distance):
            part = (fps[rows, 0] & np.uint64(mask)).view(np.int64)
            sub = np.unique(np.stack([run[rows], part]), axis=1, return_inverse=True)[1].reshape(-1)
            yield from ((rows[a], rows[b]) for a, b in near_pairs(sub, fps[rows], refs, distance))
    elif len(rows):
        for r in np.unique(run[rows]):
            own = rows[run[rows] == r]
            yield from ((own[a], own[b]) for a, b in crowd_links(fps[own], distance))


def forest(run: np.ndarray, fps: np.ndarray, refs: np.ndarray, distance: int, above: int = 2048) -> np.ndarray:
    """For each row the least row of its run that near links lead to."""
    label = np.arange(len(fps))
    for left, right in run_pairs(run, fps, refs, distance, above):
        while True:
            a, b = label[left], label[right]
            open_ = a != b
            if not open_.any():
                break
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def mask_buckets(columns: list[str], masks: list[tuple[int, ...]]) -> Column:
    """For each mask the bucket of a fingerprint: a hash of its bits under the mask."""

    def signed(m: int) -> int:
        return m - (1 << 64) if m >= 1 << 63 else m

    return F.array(*[
        F.xxhash64(F.lit(i), *[F.col(c).bitwiseAND(F.lit(signed(m)).cast("long")) for c, m in zip(columns, mask)])
        for i, mask in enumerate(masks)])


def links(nodes: DataFrame, columns: list[str], buckets: Column, distance: int, pivot_count: int) -> DataFrame:
    """a, b: links between nodes (column node, and the fingerprint's columns) that connect just
    those that chains of at most `distance` differing bits connect, each link within one of
    the `buckets` (an array) of both; per bucket a forest, never all pairs.

    A pivot column alone cannot place rows for an exchange without sending each to most
    places: distances to a pivot spread by a few bits only, cells would be as wide. So
    fingerprints meet in buckets, as of equal bits under one of some masks, and the pivot table
    discards pairs inside the buckets. Buckets pass the task as a sorted stream; one bucket
    at most is held at a time.
    """
    refs = pivots(pivot_count, len(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))
            bucket = np.cumsum(new) - 1
            rows = rows[np.bincount(bucket)[bucket] > 1]
            bucket = np.unique(rows[:, 0], return_inverse=True)[1].reshape(-1)
            label = forest(bucket, rows[:, 2:].copy().view(np.uint64), refs, distance) if len(rows) else np.zeros(0, np.int64)
            tied = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(rows[tied, 1]), pa.array(rows[label[tied], 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)], axis=1))
            size += batch.num_rows
            if size < 200_000:
                continue
            rows = np.concatenate(held)
            cut = int(np.argmax(rows[:, 0] == rows[-1, 0]))
            if cut:
                yield flush(rows[:cut])
            held, size = [rows[cut:]], len(rows) - cut
        if held:
            yield flush(np.concatenate(held))

    rows = nodes.select(F.explode(buckets).alias("bucket"), "node", *columns)
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, distance: int = 3, size: int = 3, seed: int = 42, words: int = 1, key_bits: int = 16,
               recall: float = 0.995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, doc_id, fp (and fp1, ...), node and component_id (least doc_id that chains of
    links reach) of every row of `docs`. node numbers the component.

    Fingerprints of one word of 64 bits find every link: buckets are choices of three of six
    blocks, of which a pair within `distance` = 3 bits shares one. Wider fingerprints serve
    larger distances: buckets are random samples of `key_bits` bits, in such number that a
    pair at the full distance is found with probability `recall`; more documents want more
    key bits. Inside a bucket all pairs are looked at either way, and no bucket is cut.

    Rows of one fingerprint are one node, folded before any pair is looked for, so exact
    copies cost nothing. A missing text is empty; texts without words share fingerprint
    zero and are linked like any other. Rows without an id take part, and component_id is
    missing where no row of the component has one. Repeated rows each get a row. An empty
    table gives an empty result. Other columns are not read.
    """
    columns = names(words)
    node = F.col("fp") if words == 1 else F.xxhash64(*columns)
    rows = stored(fingerprint(docs, size, seed, words, id_col, text_col).withColumn("node", node), "fingerprints")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in columns])
    masks = block_masks(6, distance) if words == 1 else sampled_masks(words, distance, key_bits, recall)
    found = links(nodes.select("node", *columns), columns, mask_buckets(columns, masks), distance, 16 if words == 1 else 2)
    roots = components(stored(found, "links")).withColumnRenamed("node", "n")
    rooted = nodes.join(roots, F.col("node") == F.col("n"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = rooted.join(smallest, "root").select("node", F.col("root"), "component_id")
    return rows.join(by_node, "node").select("id", "th", "doc_id", *columns, F.col("root").alias("node"), "component_id")


def distance_of(similarity: float, words: int) -> int:
    """Bits in which texts of this Jaccard similarity of shingles differ on average: the
    angle of their shingle sets, as a share of a half turn."""
    cosine = 2 * similarity / (1 + similarity)
    return round(64 * words * math.acos(cosine) / math.pi)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
