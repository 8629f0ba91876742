"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ten consecutive item words (a shorter item is one window) is a pattern. Texts are
normalised to lower-case words between single spaces and scanned once; matches are mapped back to
word numbers and to character offsets of the original text.

The patterns are broadcast, so their size is checked: a benchmark with more than `max_chars`
pattern characters is split into several automata, each no larger, and the texts are scanned
once for each; what one scan finds is carried to the next.

Defined results: null or wordless texts have no words and no hits; null and wordless items have
no windows; windows that several items share count for each of them; repeated rows are judged
one by one; an empty benchmark leaves everything clean; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsfunnel.llm.textkit import map_arrow, stage, table

WINDOW = 10
MAX_CHARS = 3_000_000

_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the same before lower-casing
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
_ITEMS = pa.list_(pa.string())
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_FOUND = [("n_words", pa.int64()), ("runs", _RUNS), ("items", _ITEMS), ("spans", _SPANS)]
_DDL = ("text string, n_words long, runs array<struct<first:long,last:long>>, "
        "items array<string>, spans array<struct<start:long,end:long>>")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def _windows(batches, window: int):
    for batch in batches:
        ids, keys = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = [x.decode("utf-8", "surrogatepass") for x in normal_words(text)]
            if w and item is not None:
                found = {" ".join(w[i:i + window]) for i in range(max(1, len(w) - window + 1))}
                ids += [item] * len(found)
                keys += sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.string())],
                                         names=["item", "key"])


def _automaton(patterns: list[tuple[str, list[str]]]):
    import ahocorasick

    tree = ahocorasick.Automaton()
    for key, items in patterns:
        tree.add_word(f" {key} ", (key.count(" ") + 1, items))
    if patterns:
        tree.make_automaton()
    return tree


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_built: dict[str, object] = {}  # this worker's automaton, built once for all its tasks


def _scan(batches, shared, name: str, last_pass: bool):
    if name not in _built:
        _built.clear()
        _built[name] = _automaton(shared.value)
    tree = _built[name]
    for batch in batches:
        rows = []
        for text, runs, items in zip(batch.column(1).to_pylist(), batch.column(3), batch.column(4)):
            w = normal_words(text)
            runs = [(r["first"], r["last"]) for r in runs.as_py() or ()]
            items = set(items.as_py() or ())
            if w and len(tree):
                hay = f" {b' '.join(w).decode('utf-8', 'surrogatepass')} "
                found = list(tree.iter(hay))
                if found:
                    lengths = [len(x.decode("utf-8", "surrogatepass")) for x in w]
                    ends = np.cumsum(np.array(lengths) + 1)  # place of the space after each word
                    for end, (k, owners) in found:
                        last = int(np.searchsorted(ends, end))
                        runs.append((last - k + 1, last))
                        items.update(owners)
            runs = _merge(runs)
            spans = []
            if runs and last_pass:
                place = [m.span() for m in _WORD.finditer(text)]
                spans = [{"start": place[a][0], "end": place[b][1]} for a, b in runs]
            rows.append((len(w), [{"first": a, "last": b} for a, b in runs], sorted(items), spans))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], *(pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_FOUND))],
            names=["row", "text", *(name for name, _ in _FOUND)])


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), window: int = WINDOW,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """The columns `carry` of `docs` with n_words, n_hit, item_ids (sorted strings) and spans
    (character offsets in the text)."""
    spark = docs.sparkSession
    keys = stage(
        map_arrow(
            benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")),
            lambda it: _windows(it, window), "item string, key string",
        ).groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    size = keys.agg(F.sum(F.length("key") + 2)).first()[0] or 0
    shards = max(1, -(-size // max_chars))
    current = docs.select(
        F.struct(*carry).alias("row"), F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<first:long,last:long>>").alias("runs"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
    )
    ddl = f"row {current.schema['row'].dataType.simpleString()}, {_DDL}"
    for shard in range(shards):
        part = keys.filter(F.pmod(F.xxhash64("key"), F.lit(shards)) == shard)
        shared = spark.sparkContext.broadcast([(r["key"], list(r["items"])) for r in part.toLocalIterator()])
        last_pass = shard == shards - 1
        current = map_arrow(
            current,
            lambda it, shared=shared, name=uuid.uuid4().hex, last_pass=last_pass: _scan(it, shared, name, last_pass),
            ddl)
        if not last_pass:
            current = stage(current, "scanned")
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return current.select(
        "row.*", F.col("n_words"), n_hit.alias("n_hit"), F.col("items").alias("item_ids"), "spans")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER_SQL}, '{_PATTERN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER_SQL}, '{_PATTERN}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS k, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS key
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, key)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
