"""Ranked lexical search: accumulator-limited evaluation, one term at a time.

1. Terms of the items are counted and, since they are broadcast, their number is checked: items
   beyond `max_terms` item terms are dealt into several rounds.
2. One scan of the texts writes the postings: per document its length and its query terms.
3. Number of documents, their length and each term's document frequency are summed from them.
4. Each task ranks its own documents, a block at a time. Postings are turned to term order; an item
   takes its terms rarest first. New accumulators are created until the bounds of all terms still to
   come cannot reach the k-th best score so far; from then on only the accumulators at hand are
   updated, exactly. Nothing is approximated: a document without an accumulator cannot be among the k.
5. The best k of every task meet in one window per item.

Terms meet texts by 64-bit hashes; two item terms of one hash are refused.

Defined results: null or wordless texts are no documents of the collection and are never found;
rows that repeat a doc_id are ranked one by one; a null doc_id goes after all others among equal
scores; rows that share an item_id are one item with all their terms; items without terms or
without a scoring document give no rows; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from newsfunnel.llm.textkit import (
    ALNUM, Chunk, list_array, map_arrow, range_hashes, rows_of, slices, stage, table, words,
)

BEST = 20
MAX_TERMS = 1_000_000  # item terms broadcast at once
BLOCK = 65_536  # documents ranked at once

_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = ~ALNUM
_BREAK[0x41:0x5B] = False

_DDL = "doc_id long, n long, terms array<int>, counts array<long>"
_FOUND_DDL = "item int, score long, doc_id long"


def term_hashes(terms: list[str]) -> np.ndarray:
    """Hashes as the scan of the texts gives them."""
    raw = [t.encode("utf-8", "surrogatepass") for t in terms]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    starts = ends - np.array([len(r) for r in raw], dtype=np.int64)
    return range_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), starts, ends)


def _postings(batches, shared):
    wanted = shared.value  # sorted hashes
    for batch in batches:
        n = np.zeros(batch.num_rows, dtype=np.int64)
        keys, counts = [], []
        for rows, chunk in slices(batch.column(1), _BREAK):
            row, term, count = _chunk_postings(rows, chunk, wanted, n)
            keys.append(row * len(wanted) + term)
            counts.append(count)
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        count = np.concatenate([np.zeros(0, np.int64), *counts])
        # Parts of a very long text have been counted apart.
        key, where = np.unique(key, return_inverse=True)
        total = np.zeros(len(key), dtype=np.int64)
        np.add.at(total, where, count)
        splits = np.searchsorted(key, np.arange(batch.num_rows + 1) * max(1, len(wanted)))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(n), list_array(key % max(1, len(wanted)), splits, pa.int32()),
            list_array(total, splits),
        ], names=["doc_id", "n", "terms", "counts"])


def _chunk_postings(rows: np.ndarray, chunk: Chunk, wanted: np.ndarray, n: np.ndarray):
    low = chunk.lower()
    starts, ends, splits = words(low, chunk.offsets, ALNUM)
    np.add.at(n, rows, np.diff(splits))
    h = range_hashes(low, starts, ends)
    term = np.searchsorted(wanted, h)
    term[term == len(wanted)] = 0
    hit = np.flatnonzero(wanted[term] == h) if len(wanted) else np.zeros(0, np.int64)
    key, count = np.unique(rows[rows_of(splits)[hit]] * len(wanted) + term[hit], return_counts=True)
    return key // max(1, len(wanted)), key % max(1, len(wanted)), count


def term_weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def length_measure(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """The m of every document; whole numbers of any size are divided exactly."""
    if int(n.max(initial=0)) * 25 * documents < 1 << 62:
        return 75 + (25 * n * documents) // length
    return 75 + np.array([25 * int(x) * documents // length for x in n], dtype=np.int64)


class Block:
    """Postings of some documents in term order, with what each adds to a score."""

    def __init__(self, ids, n, terms, counts, splits, weights, documents, length):
        m = length_measure(n, documents, length)
        doc = rows_of(splits)
        adds = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * m[doc]))
        order = np.argsort(terms, kind="stable")
        self.ids, self.doc, self.adds = ids, doc[order], adds[order]
        self.begin = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        # Upper bound of each term in this block.
        self.bound = np.zeros(len(weights), dtype=np.int64)
        np.maximum.at(self.bound, terms, adds)
        self.score = np.zeros(len(n), dtype=np.int64)
        self.held = np.zeros(len(n), dtype=bool)

    def rank(self, item: list[tuple[int, int]], best: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, documents) that can be among the `best` of an item, whose terms come rarest
        first as (term, repeats); `floor` is the k-th best score known from elsewhere."""
        score, held = self.score, self.held
        score[:] = 0
        held[:] = False
        item = [(t, r) for t, r in item if self.begin[t] < self.begin[t + 1]]
        rest = sum(r * int(self.bound[t]) for t, r in item)
        creating, top = True, 0
        for t, repeats in item:
            if creating and rest <= max(floor, top):
                kth = max(floor, self._kth(best))
                creating = rest >= kth
            doc, add = self.doc[self.begin[t]:self.begin[t + 1]], self.adds[self.begin[t]:self.begin[t + 1]]
            if not creating:
                ours = held[doc]
                doc, add = doc[ours], add[ours]
            else:
                held[doc] = True
            if len(doc):
                score[doc] += repeats * add
                top = max(top, int(score[doc].max()))
            rest -= repeats * int(self.bound[t])
        found = np.flatnonzero(score > 0)
        if len(found) > best:
            kth = np.partition(score[found], len(found) - best)[len(found) - best]
            found = found[score[found] >= kth]
        return score[found], found

    def _kth(self, best: int) -> int:
        scores = self.score[self.held]
        if len(scores) < best:
            return 0
        return int(np.partition(scores, len(scores) - best)[len(scores) - best])


def _best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, best: int):
    """The best of (score, id); unknown ids last among equals."""
    order = np.lexsort((ids, ~known, -scores))[:best]
    return scores[order], ids[order], known[order]


def _rank_task(batches, shared, best: int, size: int):
    items, weights, documents, length = shared.value
    none = np.zeros(0, np.int64)
    kept = [(none, none, np.zeros(0, bool)) for _ in items]

    def block(part: pa.Table) -> None:
        part = part.combine_chunks()
        ids = part.column(0)
        known = ids.is_valid().to_numpy()
        ids = ids.fill_null(0).to_numpy()
        terms, counts = part.column(2), part.column(3)
        splits = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy())]).astype(np.int64)
        postings = Block(
            ids, part.column(1).to_numpy(), pc.list_flatten(terms).to_numpy().astype(np.int64),
            pc.list_flatten(counts).to_numpy(), splits, weights, documents, length)
        for i, item in enumerate(items):
            have = kept[i]
            score, found = postings.rank(item, best, int(have[0][-1]) if len(have[0]) == best else 0)
            if len(found):
                kept[i] = _best(*(np.concatenate([a, b]) for a, b in zip(have, (score, ids[found], known[found]))), best)

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            block(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        block(pa.Table.from_batches(held))
    out = [(i, s, d if k else None) for i, row in enumerate(kept) for s, d, k in zip(*(x.tolist() for x in row))]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))],
        names=["item", "score", "doc_id"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats) of all items."""
    low = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    found = items.select("item_id", F.explode(F.regexp_extract_all(low, F.lit(_PATTERN), F.lit(0))).alias("term"))
    return found.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def _search_round(docs: DataFrame, wanted: DataFrame, best: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    rows = wanted.collect()  # at most about max_terms
    vocabulary = sorted({r["term"] for r in rows})
    hashes = term_hashes(vocabulary)
    order = np.argsort(hashes)
    sorted_hashes = hashes[order]
    if len(vocabulary) > 1 and (sorted_hashes[1:] == sorted_hashes[:-1]).any():
        raise ValueError("two item terms have the same hash")
    number = {vocabulary[j]: i for i, j in enumerate(order.tolist())}
    index = stage(map_arrow(docs, lambda it, s=spark.sparkContext.broadcast(sorted_hashes): _postings(it, s), _DDL), "postings")
    documents, length = index.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    frequency = np.zeros(len(vocabulary), dtype=np.int64)  # one row per item term comes back
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        frequency[r["t"]] = r["count"]
    documents, length = int(documents or 0), int(length or 0)
    weights = np.array([term_weight(documents, int(f)) for f in frequency], dtype=np.int64)
    of: dict = {}
    for r in rows:
        of.setdefault(r["item_id"], []).append((number[r["term"]], r["repeats"]))
    names = list(of)
    items = [sorted(of[name], key=lambda x: (frequency[x[0]], x[0])) for name in names]
    shared = spark.sparkContext.broadcast((items, weights, documents, max(1, length)))
    found = map_arrow(index.filter("size(terms) > 0"), lambda it: _rank_task(it, shared, best, block), _FOUND_DDL)
    schema = StructType([StructField("item", IntegerType()), StructField("item_id", wanted.schema["item_id"].dataType)])
    lookup = spark.createDataFrame(list(enumerate(names)), schema)
    return found.join(F.broadcast(lookup), "item").select("item_id", "score", "doc_id")


def ranked_search(
    docs: DataFrame, items: DataFrame, best: int = BEST, max_terms: int = MAX_TERMS, block: int = BLOCK,
) -> DataFrame:
    """The `best` documents of every item: item_id, rank, doc_id, score."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = stage(item_terms(items), "item-terms")
    rounds = max(1, -(-wanted.count() // max_terms))
    found = None
    for number in range(rounds):
        mine = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == number)
        part = _search_round(narrow, mine, best, block)
        found = part if found is None else found.unionAll(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select(
        "item_id", "rank", "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER_SQL = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER_SQL}, '{_PATTERN}') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS big_n, sum(len(w))::BIGINT AS big_l FROM d),
q AS (SELECT item_id, term, count(*)::BIGINT AS repeats
      FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER_SQL}, '{_PATTERN}')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
x AS (
  SELECT item_id, row, sum(repeats * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                           * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w)::BIGINT * big_n) // big_l))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN d USING (row), s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
      FROM x JOIN d USING (row) WHERE score > 0)
SELECT * FROM r WHERE rank <= {BEST}
"""
