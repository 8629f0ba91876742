"""Sets of word shingles of whole texts, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from newsfunnel.llm.textkit import NOT_SPACE, Chunk, chunks, gram_hashes, mix, range_hashes, rows_of, words

WORDS = 5
PERCENT = 80
_ALL = (1 << 64) - 1


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """A set of n must share one of its first so many members with every similar set."""
    return n - -(-percent * n // 100) + 1


def sample_share(n: int, percent: int = PERCENT) -> float:
    """Share of the hash range in which a set of n nearly always has its whole prefix; falls with n."""
    if n < 40:
        return 1.0
    p = 1 - percent / 100 + 1 / n
    return min(1.0, p + 3 * math.sqrt(p * (1 - p) / n))


def below(values: np.ndarray, share: float) -> int:
    """How many of the sorted `values` lie in the first `share` of the hash range."""
    if share >= 1:
        return len(values)
    return int(np.searchsorted(values, np.uint64(int(share * _ALL)), side="right"))


def shingle_sets(column: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """Per row its distinct k-word shingles, sorted; fewer words are one shingle, none give none."""
    for chunk in chunks(column):
        yield from _chunk_sets(chunk, k)


def _chunk_sets(chunk: Chunk, k: int) -> Iterator[np.ndarray]:
    low = chunk.lower()
    starts, ends, splits = words(low, chunk.offsets, NOT_SPACE)
    h = range_hashes(low, starts, ends)
    grams = gram_hashes(h, k)
    for r in range(chunk.rows):
        a, b = int(splits[r]), int(splits[r + 1])
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1])
        elif b > a:
            yield gram_hashes(h[a:b], b - a)
        else:
            yield np.zeros(0, dtype=np.uint64)


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    if len(values) == 0:
        return 0, 0
    m = mix(values + np.uint64(0x9E3779B97F4A7C15))
    pair = np.array([m.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(m))], dtype=np.uint64)
    return tuple(pair.view(np.int64).tolist())


__all__ = ["WORDS", "PERCENT", "prefix_length", "sample_share", "below", "shingle_sets", "digest", "rows_of"]
