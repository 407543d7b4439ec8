"""Hashed character three-grams of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Grams whose weights, and characters whose grams are in memory at a time (or one text's).
GRAMS_AT_ONCE, CHARS_AT_ONCE = 1 << 16, 1 << 19


def groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts a bounded number of characters at a time, with the number of those before."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHARS_AT_ONCE:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The text and a 64-bit hash of every three-gram of the texts, each between two blanks."""
    joined = "".join([f" {t} " for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    of = np.repeat(np.arange(len(texts)), size)
    # The last two places of a text begin no gram of it.
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(size)
    inside[ends - 1] = inside[ends - 2] = False
    codes = np.concatenate((codes, np.zeros(2, np.uint64)))
    grams = codes[:-2] * np.uint64(1000003) + codes[1:-1] * np.uint64(8191) + codes[2:]
    return of[inside], ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20))[inside]


def slots(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    of, grams = hashed(texts)
    return of, (grams % np.uint64(buckets)).astype(np.int64)


def sums(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """For each text the sum of the rows of `weights` of its grams. Only rows that occur
    are read, a bounded number at a time."""
    out = np.zeros((len(texts), weights.shape[1]))
    for start, group in groups(texts):
        of, slot = slots(group, len(weights))
        for at in range(0, len(of), GRAMS_AT_ONCE):
            part = of[at:at + GRAMS_AT_ONCE]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            out[start + part[first]] += np.add.reduceat(weights[slot[at:at + GRAMS_AT_ONCE]], first, axis=0)
    return out


def signed_counts(texts: list[str], dims: int) -> np.ndarray:
    """A row of signed counts for each text."""
    out = np.zeros((len(texts), dims))
    for start, group in groups(texts):
        of, grams = hashed(group)
        sign = np.where(grams & np.uint64(1), 1.0, -1.0)
        slot = ((grams >> np.uint64(1)) % np.uint64(dims)).astype(np.int64)
        out[start:start + len(group)] = np.bincount(of * dims + slot, weights=sign, minlength=dims * len(group)).reshape(-1, dims)
    return out
