"""Sharding by histogram sort.

Rows are ordered by the digest of their text, then by id, so equal texts stand together, and cut
where each shard has its share of the bytes. Nothing is sorted to find the cuts:

1. One scan writes the narrow table of sort keys and sizes.
2. Probes, keys drawn from the open ranges, go to all partitions; each counts the exact rows and
   bytes below every probe, and the sums narrow the ranges. This is repeated until every cut is
   known: a range is drawn from at a rate, so few probes are needed at any size, and a range with
   few rows left is probed at all of them. Probes are drawn, counts never are.
3. A cut goes to the nearer border of the group of equal texts it falls into, if that is within
   `tolerance` of a shard's bytes; else, as for a group too large for that, between two rows at the
   nearest place. Shards are cut further into parts of about `part_bytes` for the tasks.
4. One exchange sends the rows to their parts, which are sorted and written, a folder per shard.
   Row counts of the parts then give every row its place in the shard.

The cuts depend on the rows alone, not on partitions, probes or cluster.

Defined results: a null text counts as empty (size 1); null ids come before others of the same
text; rows that repeat id and text are told apart by where they are read, so that any number of
them can be cut; shards beyond the number of rows stay empty; an empty table gives no rows; further
columns, whatever their names, are carried along. `docs` has to give the same rows in the same
order whenever it is read (a stored table), or cuts within repeated rows are only about right.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsfunnel.llm.textkit import map_arrow, mix, stage, table
from newsfunnel.session import run_dir, ship_package

SHARDS = 8
TOLERANCE = 0.005  # of a shard's bytes, to keep a group of equal texts whole
PART_BYTES = 64 << 20  # of text in one task and file
PROBES = 8192  # probes of a round, and at least 16 per part

_DIGEST, _KEY = 16, 33  # bytes: digest | is there an id | id | place of reading
_LOCAL = (1 << 33) - 1  # rows within a partition, in monotonically_increasing_id


def _eight(value: Column) -> Column:
    """A long as eight bytes that sort as the number does."""
    return F.unhex(F.lpad(F.hex(value.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def sort_key(text: Column, id_col: Column) -> Column:
    return F.concat(
        F.unhex(F.md5(F.coalesce(text, F.lit("")))),
        F.when(id_col.isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01"))),
        _eight(F.coalesce(id_col, F.lit(0).cast("long"))), _eight(F.xxhash64(F.monotonically_increasing_id())),
    )


def _keys(column: pa.Array) -> np.ndarray:
    """A column of keys as fixed-width strings, which numpy compares byte by byte."""
    column = column.cast(pa.binary(_KEY))
    raw = np.frombuffer(column.buffers()[1], dtype=np.uint8)
    return raw[column.offset * _KEY:(column.offset + len(column)) * _KEY].view(f"S{_KEY}")


def _array(keys: list[bytes]) -> np.ndarray:
    return np.array(keys, dtype=f"S{_KEY}")


def _histogram(batches, shared):
    probes = _array(shared.value)
    rows = np.zeros(len(probes) + 1, dtype=np.int64)
    size = np.zeros(len(probes) + 1, dtype=np.int64)
    for batch in batches:
        at = np.searchsorted(probes, _keys(batch.column(0)), side="right")
        np.add.at(rows, at, 1)
        np.add.at(size, at, batch.column(1).to_numpy())
    used = np.flatnonzero(rows)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(rows[used]), pa.array(size[used])], names=["bucket", "n", "bytes"])


def _draw(batches, shared):
    """Keys of the open ranges, each at its rate, by the hash of key and round."""
    low, high, rate, salt = shared.value
    low, high = _array(low), _array(high)
    limit = np.array([min(1 << 64, int(r * (1 << 64))) - 1 if r > 0 else 0 for r in rate], dtype=np.uint64)
    for batch in batches:
        keys = _keys(batch.column(0))
        at = np.searchsorted(low, keys, side="right") - 1
        inside = np.flatnonzero((at >= 0) & ((keys < high[at]) | (high[at] == b"")))
        keys, at = keys[inside], at[inside]
        raw = np.frombuffer(keys.tobytes(), dtype=np.uint8).reshape(-1, _KEY)
        h = np.full(len(keys), salt, dtype=np.uint64)
        for a in (0, 8, 17, 25):
            h = mix(h + np.ascontiguousarray(raw[:, a:a + 8]).view(np.uint64)[:, 0] + np.uint64(0x9E3779B97F4A7C15))
        taken = np.ascontiguousarray(raw[h <= limit[at]])
        yield pa.RecordBatch.from_arrays(
            [pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY), len(taken), [None, pa.py_buffer(taken.tobytes())])
             .cast(pa.binary())], names=["key"])


class Histogram:
    """Exact rows and bytes below each probe. The first probe is before all keys."""

    def __init__(self, narrow: DataFrame):
        self.narrow = narrow
        self.probes: list[bytes] = [b""]
        self.rows, self.bytes = [0], [0]
        self.total_rows = self.total_bytes = 0

    def count(self, keys) -> None:
        """Count below further probes; the table of totals comes to the driver, one row a range."""
        self.probes = sorted({*self.probes, *keys})
        shared = self.narrow.sparkSession.sparkContext.broadcast(self.probes[1:])
        per = map_arrow(self.narrow, lambda it: _histogram(it, shared), "bucket int, n long, bytes long")
        n, size = [0] * len(self.probes), [0] * len(self.probes)
        for r in per.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect():
            n[r["bucket"]], size[r["bucket"]] = r["n"], r["bytes"]
        self.rows, self.bytes = [0], [0]
        for a, b in zip(n, size):
            self.rows.append(self.rows[-1] + a)
            self.bytes.append(self.bytes[-1] + b)
        self.total_rows, self.total_bytes = self.rows.pop(), self.bytes.pop()

    def at(self, target: int) -> int:
        """The last probe with no more than `target` bytes below it."""
        return bisect.bisect_right(self.bytes, target) - 1

    def after(self, i: int) -> tuple[int, int]:
        """(rows, bytes) below the end of range i."""
        last = i + 1 == len(self.probes)
        return (self.total_rows, self.total_bytes) if last else (self.rows[i + 1], self.bytes[i + 1])

    def draw(self, ranges: list[int], wanted: int, salt: int) -> list[bytes]:
        low = [self.probes[i] for i in ranges]
        high = [self.probes[i + 1] if i + 1 < len(self.probes) else b"" for i in ranges]
        rate = [min(1.0, wanted / max(1, self.after(i)[0] - self.rows[i])) for i in ranges]
        shared = self.narrow.sparkSession.sparkContext.broadcast((low, high, rate, salt))
        return [bytes(r[0]) for r in map_arrow(self.narrow, lambda it: _draw(it, shared), "key binary").collect()]


def find_cuts(narrow: DataFrame, shards: int, tolerance: float, part_bytes: int, probes: int = PROBES):
    """(cuts between shards, cuts between parts) as keys; `narrow` has key and size."""
    found = Histogram(narrow)
    found.count([])
    total = found.total_bytes
    if not total:
        return [], []
    parts = shards * max(1, math.ceil(total / shards / part_bytes))
    exact = [total * k // shards for k in range(1, shards)]
    rough = [t for t in (total * k // parts for k in range(1, parts)) if t not in set(exact)]
    slack = total / parts / 8
    whole: list[tuple[bytes, bytes]] = []  # ranges that have been probed at every row

    def is_probed(i: int) -> bool:
        j = bisect.bisect_right(whole, (found.probes[i], b"\xff" * (_KEY + 1))) - 1
        return j >= 0 and (whole[j][1] == b"" or found.probes[i] < whole[j][1])

    salt = 0
    while True:
        open_exact = sorted({found.at(t) for t in exact})
        open_exact = [i for i in open_exact if not is_probed(i)]
        near = [(t, i) for t in rough for i in [found.at(t)] if not is_probed(i)]
        open_rough = {i for t, i in near if min(t - found.bytes[i], found.after(i)[1] - t) > slack}
        ranges = sorted({*open_exact, *open_rough})
        if not ranges:
            break
        wanted = max(probes, 16 * parts) // len(ranges) + 1
        for i in ranges:
            if found.after(i)[0] - found.rows[i] <= wanted:
                bisect.insort(whole, (found.probes[i], found.probes[i + 1] if i + 1 < len(found.probes) else b""))
        salt += 1
        found.count(found.draw(ranges, wanted, salt))

    # The borders of the groups of equal texts that the cuts fall into.
    crossing = [found.probes[found.at(t)] for t in exact]
    borders = [_group(key) for key in crossing]
    found.count([b for pair in borders for b in pair if b])
    cuts = []
    for t, key, (first, past) in zip(exact, crossing, borders):
        def below(k: bytes) -> int:
            return found.bytes[bisect.bisect_left(found.probes, k)] if k else total

        start, end = below(first), below(past)
        i = bisect.bisect_left(found.probes, key)
        if min(t - start, end - t) <= tolerance * total / shards:
            cuts.append(first if t - start <= end - t else past)
        else:
            row_end = found.after(i)[1]
            following = found.probes[i + 1] if i + 1 < len(found.probes) else b""
            cuts.append(key if t - found.bytes[i] <= row_end - t else following)
    last = b"\xff" * _KEY  # no key stands behind it: the digest of no text is all ones
    cuts = [c or last for c in cuts]
    inner = {found.probes[min((i for i in (found.at(t), found.at(t) + 1) if i < len(found.probes)),
                              key=lambda i: abs(found.bytes[i] - t))] for t in rough}
    return cuts, sorted({*cuts, *inner} - {b""})


def _group(key: bytes) -> tuple[bytes, bytes]:
    """First key of the group of `key`, and first key behind it (empty: none)."""
    digest = key[:_DIGEST].ljust(_DIGEST, b"\0")
    past = int.from_bytes(digest, "big") + 1
    return digest, past.to_bytes(_DIGEST, "big") if past < 1 << 128 else b""


def write_shards(
    docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write `docs` to `path`, a folder per shard; `read_shards` reads it."""
    spark = docs.sparkSession
    ship_package(spark)
    keyed = docs.select(
        F.struct(*docs.columns).alias("doc"),
        sort_key(F.col(text_col).cast("string"), F.col(id_col).cast("long")).alias("key"),
        (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + 1).alias("size"))
    cuts, parts = find_cuts(stage(keyed.select("key", "size"), "shard-keys"), shards, tolerance, part_bytes)
    shared = spark.sparkContext.broadcast((cuts, parts))  # one key per shard and per part

    @F.arrow_udf("struct<shard:int,part:int>")
    def place(keys: pa.Array) -> pa.Array:
        at = _keys(keys)
        out = [np.searchsorted(_array(c), at, side="right").astype(np.int32) for c in shared.value]
        return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in out], names=["shard", "part"])

    placed = keyed.withColumn("to", place("key")).select("doc", "key", "size", "to.part", "to.shard")
    placed = placed.repartitionById(len(parts) + 1, F.col("part")).sortWithinPartitions("shard", "key")
    placed.select("doc", "size", "part", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL)).alias("place"), "shard") \
        .write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """doc (struct with the columns of `docs`), size, shard, slot (from 0 within the shard)."""
    doc = docs.select(F.struct(*docs.columns).alias("doc")).schema["doc"].dataType
    rows = spark.read.schema(f"doc {doc.simpleString()}, size long, part int, place long, shard int").parquet(path)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part, however many documents there are.
    offsets = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(offsets), ["shard", "part"]).select(
        "doc", "size", "shard", (F.col("before") + F.col("place")).alias("slot"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = run_dir(spark, "shards")
    write_shards(docs, path)
    return read_shards(spark, path, docs).select(
        "doc.doc_id", "size", F.crc32(F.coalesce("doc.text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_steps() -> list[int]:
    """What four shifts of the CRC-32 register do to each value of its low four bits."""
    out = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


#: DuckDB has no crc32: the register is fed by half bytes, the lower half of each byte first.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS g,
         (strlen(coalesce(text, '')) + 1)::BIGINT AS size FROM documents),
o AS (SELECT *, (sum(size) OVER (ORDER BY g, doc_id NULLS FIRST, row) - size)::BIGINT AS before FROM d),
e AS (SELECT *, min(before) OVER (PARTITION BY g) AS first, max(before + size) OVER (PARTITION BY g) AS past FROM o),
goals AS (SELECT total, (total * k) // {SHARDS} AS goal FROM (SELECT sum(size)::BIGINT AS total FROM d), range(1, {SHARDS}) AS r(k)),
c AS (
  SELECT CASE WHEN least(goal - first, past - goal) <= {TOLERANCE}::DOUBLE * total / {SHARDS}
                THEN CASE WHEN goal - first <= past - goal THEN first ELSE past END
              WHEN goal - before <= before + size - goal THEN before ELSE before + size END AS cut
  FROM goals JOIN e ON before <= goal AND goal < before + size),
s AS (SELECT row, (SELECT count(*) FROM c WHERE cut <= before)::INTEGER AS shard FROM o),
nib AS (
  SELECT row, list_transform(string_split(hex(encode(t)), ''), lambda x: instr('0123456789ABCDEF', x) - 1)::BIGINT[] AS a
  FROM d WHERE t <> ''),
crc AS (
  SELECT row, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(len(a)), lambda i: a[xor(i, 1::BIGINT) + 1])),
    lambda r, x: xor(r >> 4, ({_crc_steps()}::BIGINT[])[(xor(r, x) & 15) + 1])), 4294967295::BIGINT) AS crc FROM nib)
SELECT doc_id, size, coalesce(crc, 0)::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY before) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM o JOIN s USING (row) LEFT JOIN crc USING (row)
"""
