"""Best-fit packing of token sequences: bounded-space online best-fit.

Each task packs its documents as they come. It keeps a fixed number of open bins in a bitset
keyed by free space: the lowest set bit at or above a piece's length is the best fit. If no bin
fits and all are open, the fullest is closed. Bins still open at the end of a task are packed
once more by the same rule over all tasks, as items of the size they have reached, so tasks cost
no half-empty sequences.

Defined results: null text is the empty document (one piece: the end id alone); null ids stay
null; repeated rows are separate documents; an empty table gives no rows; further columns of the
input are ignored. A text beyond the sequence length is cut so that all pieces but the first are
full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsfunnel.llm.tokens import byte_bpe
from newsfunnel.llm.textkit import map_arrow, stage, table

SEQUENCE = 2048
OPEN_BINS = 2048
END_ID = b"\x00\x00\x00\x00"
MERGE_BINS = 20_000  # left-over bins that one task of the second pass packs
_TASK = 1 << 32

_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("place", pa.int64()), ("used", pa.int64()),
])
_DDL = ("doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, "
        "used long")


class OpenBins:
    """At most `limit` open bins; `place` gives (bin, offset) for an item of `size`."""

    def __init__(self, capacity: int, limit: int, first: int):
        self.capacity, self.limit, self.next = capacity, limit, first
        self.bits = 0  # bit f: there is an open bin with f tokens free
        self.by_free: dict[int, list[int]] = {}
        self.count = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return out

    def place(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.count >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            number, free = self.next, self.capacity
            self.next += 1
        left = free - size
        if left:  # a full bin closes by itself
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - free

    def open(self) -> Iterator[tuple[int, int]]:
        for free, bins in self.by_free.items():
            for number in bins:
                yield number, self.capacity - free


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) in tokens; only the first piece may be shorter than `capacity`."""
    n = len(ids) // 4
    at, size = 0, n % capacity or min(n, capacity)
    while at < n:
        yield at, size
        at, size = at + size, capacity


def _pack_task(batches, capacity: int, limit: int, path: str | None):
    bpe = byte_bpe(path)
    bins = OpenBins(capacity, limit, TaskContext.get().partitionId() * _TASK)
    for batch in batches:
        rows: list[list] = [[] for _ in _SCHEMA]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = bpe.packed(text.as_py() or "") + END_ID
            for number, (start, size) in enumerate(pieces_of(ids, capacity)):
                where, offset = bins.place(size)
                crc = zlib.crc32(memoryview(ids)[4 * start:4 * (start + size)])
                for column, value in zip(rows, (doc, number, start, size, crc, where, offset, None)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _SCHEMA)], schema=_SCHEMA)
    left = list(bins.open())
    none = [None] * len(left)
    yield pa.RecordBatch.from_arrays([
        pa.array(c, f.type) for c, f in zip(
            [none, none, none, none, none, [b for b, _ in left], none, [u for _, u in left]], _SCHEMA)
    ], schema=_SCHEMA)


def _merge_task(batches, capacity: int, limit: int):
    """Left-over bins as items: which bin each one continues, and at which offset."""
    bins = OpenBins(capacity, limit, 0)
    host: dict[int, int] = {}  # local number -> the first left-over bin placed there
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for number, used in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            local, offset = bins.place(used)
            out.append((number, host.setdefault(local, number), offset))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["bin", "into", "shift"])


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE,
    open_bins: int = OPEN_BINS, vocabulary: str | None = None,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = stage(
        map_arrow(narrow, lambda it: _pack_task(it, capacity, open_bins, vocabulary), _DDL), "packed")
    left = placed.filter("used is not null").select("bin", "used")
    # One number to the driver: how many left-over bins there are decides the second pass's tasks.
    tasks = max(1, left.count() // MERGE_BINS)
    items = left.repartition(tasks, "bin").sortWithinPartitions(F.desc("used"), "bin")
    merged = stage(
        map_arrow(items, lambda it: _merge_task(it, capacity, MERGE_BINS), "bin long, into long, shift long"),
        "merged").filter("bin != into")
    pieces = placed.filter("used is null")
    return pieces.join(merged, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
