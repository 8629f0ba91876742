"""Shared helpers: Arrow batches to byte arrays, vectorised words and hashes, stage tables.

All hashing is 64 bit. Words are found on bytes: every character above ASCII consists of bytes
above 0x7F only, so an ASCII word class works byte by byte on UTF-8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsfunnel.session import cut_lineage, give_back, ship_package, small_batches

CHUNK_BYTES = 1_000_000  # text handled at once by the vectorised kernels

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)  # ASCII letters and digits (A-Z are lower-cased before), all above ASCII
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """`mapInArrow` with this package available to the workers, over batches of bounded bytes."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)

    def task(batches):
        yield from fn(batches)
        give_back()

    return df.mapInArrow(task, schema)


def stage(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder: survives lost executors and is computed once."""
    return cut_lineage(df, label)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if it has no more than `rows` rows; else it is
    joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def hash_sample(df: DataFrame, salt: str, rows: int, total: int, key: str = "key") -> DataFrame:
    """At most `rows` rows of `df` (of `total`), one of each `key`, chosen by its hash. A hash
    threshold leaves about twice as many keys before they are sorted, so no task gathers more."""
    h = F.xxhash64(F.lit(salt), key)
    share = 2 * rows / max(1, total)
    if share < 1:
        df = df.filter(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return df.dropDuplicates([key]).orderBy(h, key).limit(rows)


def row_key(id_col: Column, text: Column) -> Column:
    """One number for all rows of one id and text, so that repeated rows can be told from others."""
    return F.xxhash64(id_col, text)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class Chunk:
    """Rows first..first+rows-1 of a batch: their bytes, and where each row begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1

    def lower(self) -> np.ndarray:
        return _LOWER[self.data]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole rows, about `size` bytes at a time; a longer row is a chunk of its own."""
    if len(column) == 0:
        return
    raw, offsets = bytes_of(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield Chunk(i, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j


def slices(column: pa.Array, is_break: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, Chunk]]:
    """`chunks`, with rows of more than twice `size` cut after bytes of the class `is_break`, so that
    a very long text takes no more memory than others: (row of the column per part, parts)."""
    for chunk in chunks(column, size):
        if chunk.rows > 1 or len(chunk.data) <= 2 * size:
            yield chunk.first + np.arange(chunk.rows), chunk
            continue
        at, end, row = 0, len(chunk.data), np.array([chunk.first])
        while at < end:
            stop = min(at + size, end)
            while stop < end:
                ahead = np.flatnonzero(is_break[chunk.data[stop:stop + 65536]])
                stop = min(end, stop + (int(ahead[0]) + 1 if len(ahead) else 65536))
                if len(ahead):
                    break
            part = chunk.data[at:stop]
            yield row, Chunk(chunk.first, part, np.array([0, len(part)], dtype=np.int64))
            at = stop


def words(low: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, splits): byte ranges of all words; row r has words splits[r]..splits[r+1]-1."""
    if len(low) == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    inside = is_word[low]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(low)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def range_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte range, independent of where it stands."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _tables(len(low) + 1)
    prefix = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:len(low)], out=prefix[1:])
    value = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (positions 0..len-k), row borders not looked at."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xA24BAED4963EE407) + h[i:i + n])
    return out


def rows_of(splits: np.ndarray) -> np.ndarray:
    """Row number of every element that `splits` deals out."""
    return np.repeat(np.arange(len(splits) - 1), np.diff(splits))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def list_array(values: np.ndarray, splits: np.ndarray, kind=pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(splits.astype(np.int32), pa.int32()), pa.array(values, kind))
