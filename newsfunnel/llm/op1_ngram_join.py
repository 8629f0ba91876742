"""N-gram Jaccard join: grouped prefix join over word-shingle sets, exact.

Order of shingles: by hash, but those in more than `heavy` groups come last. A similar pair
shares one of the first 20 % of either set in that order (prefix filter).

1. Every text becomes its set; equal sets are one node. Sets of one size whose prefixes (the
   smallest hashes, a sample a little above 20 %) are identical form one group, and only groups
   enter the counts and the prefix join.
2. Frequent shingles leave the prefixes. Sets that then have too short a prefix (texts made of
   much-repeated material) are joined among themselves by their rarest shingles, counted over
   their whole sets.
3. Filter: every member of a shingle's bucket meets the bucket's first member. Pairs pass the
   size filter, then a bound on the shared part of the sampled prefixes, then the exact check on
   whole sets ("expand and verify").
4. What is linked needs no further check. In buckets that still span several components, members
   outside the first component meet those of other components: so a family of near copies costs
   one check a copy, and no link between components is lost.

The result names components; pairs within a component are not listed.

Defined results: null, empty and wordless texts have the empty set and stay alone; null ids give
their row a null component; rows that share an id count as one node (each keeps its own set
size); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsfunnel.llm.shingles import (
    PERCENT, WORDS, below, digest, prefix_length, sample_share, shingle_sets,
)
from newsfunnel.llm.textkit import list_array, map_arrow, signed, stage, table
from newsfunnel.operators.components import connected_components

HEAVY = 64  # groups with a shingle beyond which it leaves the prefixes
BROADCAST_IDS = 100_000  # ids of texts to look up that may be broadcast (0.8 MB)

_SETS = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
    ("n_cover", pa.int32()), ("sample", pa.list_(pa.int64())),
])
_SETS_DDL = "doc_id long, n long, h1 long, h2 long, n_cover int, sample array<long>"


def _lists(arrays: list) -> pa.Array:
    import numpy as np

    splits = np.zeros(len(arrays) + 1, dtype=np.int64)
    np.cumsum([len(a) for a in arrays], out=splits[1:])
    flat = signed(np.concatenate(arrays)) if arrays else np.zeros(0, np.int64)
    return list_array(flat, splits)


def _sets(batches, k: int, percent: int):
    for batch in batches:
        rows, samples = [], []
        for doc, values in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k)):
            n = len(values)
            rows.append((doc, n, *digest(values), below(values, sample_share(n, percent))))
            samples.append(values[:below(values, sample_share(percent * n // 100, percent))])
        columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SETS) if i < 5]
        yield pa.RecordBatch.from_arrays([*columns, _lists(samples)], schema=_SETS)


def _whole_sets(batches, k: int):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), _lists(list(shingle_sets(batch.column(1), k)))], names=["sid", "items"])


def _alpha(n_a, n_b, percent: int):
    """Smallest overlap of two similar sets: ceil(t / (1 + t) * (|a| + |b|))."""
    return F.ceil(F.lit(percent) * (n_a + n_b) / F.lit(100 + percent) - 1e-9)


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int, heavy: int):
        self.k, self.percent, self.heavy = k, percent, heavy
        self.docs = docs
        self.sets = stage(
            map_arrow(docs, lambda it: _sets(it, k, percent), _SETS_DDL).withColumns({
                "g1": F.xxhash64("sample"), "g2": F.xxhash64(F.lit(7), "sample"),
                "n_sample": F.size("sample")}), "sets")
        same = ["n", "h1", "h2"]
        real = self.sets.drop("sample").filter("n > 0 and doc_id is not null")
        first = real.groupBy(*same).agg(F.min("doc_id").alias("sid"))
        placed = stage(real.join(first, same), "nodes")
        self.nodes = placed.select("doc_id", "sid", "n")
        # One row per distinct set; sets with equal sizes and prefixes form a group.
        distinct = placed.filter("doc_id = sid").dropDuplicates(["sid", *same])
        key = ["n", "g1", "g2"]
        groups = distinct.groupBy(*key).agg(F.min("sid").alias("gid"), F.count(F.lit(1)).alias("size"))
        self.members = stage(
            distinct.join(groups, key).select("sid", "gid", "n", "n_cover", "n_sample", "size"), "groups")

    def bucket_rows(self) -> DataFrame:
        """(tok, sid, n, pos): what each distinct set puts into the prefix join, and its place there."""
        leaders = self.members.filter("sid = gid").select(F.col("sid").alias("doc_id"), "n").distinct()
        tokens = (
            self.sets.select("doc_id", "n", "n_cover", "sample").join(leaders, ["doc_id", "n"], "left_semi")
            .select(F.col("doc_id").alias("gid"), "n_cover", F.posexplode("sample").alias("pos", "tok"))
            .select("tok", "gid", "pos", (F.col("pos") < F.col("n_cover")).alias("cover"))
        )
        counts = stage(tokens.groupBy("tok").count().filter("count > 1"), "counts")
        shared = stage(tokens.join(counts, "tok"), "shared")
        # What a group shares with any other, for the bound in `verified`: at most its sample.
        self.samples = stage(shared.groupBy("gid").agg(F.collect_set("tok").alias("toks")), "samples")
        # Sets whose prefix lost too much to frequent shingles.
        gone = shared.filter(f"count > {self.heavy}").groupBy("gid").agg(
            F.sum(F.col("cover").cast("int")).alias("lost"), F.collect_list("pos").alias("heavy_pos"))
        gone = stage(gone, "gone")  # lists within one sample
        p = F.col("n") - F.ceil(F.lit(self.percent) * F.col("n") / 100 - 1e-9) + 1
        bare = self.members.join(gone, "gid").filter(F.col("n_cover") - F.col("lost") < p)
        # Frequent shingles come last, so those before a shingle do not count for its place.
        before = F.coalesce(F.size(F.filter("heavy_pos", lambda x: x < F.col("pos"))), F.lit(0))
        light = (
            shared.filter(f"count <= {self.heavy}").join(gone.select("gid", "heavy_pos"), "gid", "left")
            .select("tok", "gid", F.when(F.col("heavy_pos").isNull(), F.col("pos")).otherwise(F.col("pos") - before).alias("pos"))
            .join(self.members.select("gid", "sid", "n"), "gid").select("tok", "sid", "n", "pos")
        )
        # Members of one group have the same prefix: the group is a bucket too.
        grouped = self.members.filter("size > 1").select(
            F.xxhash64(F.lit("group"), "gid", "n").alias("tok"), "sid", "n", F.lit(0).alias("pos"))
        return light.unionByName(grouped).unionByName(self._rarest(bare.select("sid").distinct()))

    def _rarest(self, sids: DataFrame) -> DataFrame:
        """Prefixes by rising frequency among `sids` alone, counted over their whole sets."""
        whole = self.whole_sets(sids)
        flat = whole.select("sid", F.size("items").alias("n"), F.explode("items").alias("item"))
        counts = flat.groupBy("item").count()
        # A set's members go through one sort; their number is bounded by the text's length.
        ranked = (
            flat.join(counts, "item")
            .groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("count", "item"))).alias("r"))
        )
        p = F.col("n") - F.ceil(F.lit(self.percent) * F.col("n") / 100 - 1e-9) + 1
        return (
            ranked.select("sid", "n", F.posexplode(F.slice("r", F.lit(1), p.cast("int"))).alias("pos", "x"))
            .filter("x.count > 1")
            .select(F.xxhash64(F.lit("rare"), "x.item").alias("tok"), "sid", "n", "pos")
        )

    def whole_sets(self, sids: DataFrame) -> DataFrame:
        """(sid, items) for the given nodes, from their texts."""
        wanted = stage(sids.select(F.col("sid").alias("doc_id")).distinct(), "wanted")
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)  # else the texts are shuffled once
        text = self.docs.join(wanted, "doc_id", "left_semi")
        k = self.k
        return stage(map_arrow(text, lambda it: _whole_sets(it, k), "sid long, items array<long>"), "whole")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct (a, b) that are similar."""
        side = self.members.select("sid", "gid", "n", "n_sample")
        sized = (
            pairs.join(side.toDF("a", "g_a", "n_a", "m_a"), "a").join(side.toDF("b", "g_b", "n_b", "m_b"), "b")
            .filter(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)")
        )
        # Of the larger set's sample, at most n - need members can be missing from the other set.
        need = _alpha(F.col("n_a"), F.col("n_b"), self.percent)
        sample = F.when(F.col("n_a") >= F.col("n_b"), F.col("m_a")).otherwise(F.col("m_b"))
        bound = sample - F.greatest("n_a", "n_b") + need
        toks = self.samples
        apart = (
            sized.filter("g_a != g_b").withColumn("bound", bound)
            .join(toks.toDF("g_a", "t_a"), "g_a").join(toks.toDF("g_b", "t_b"), "g_b")
            .filter(F.size(F.array_intersect("t_a", "t_b")) >= F.col("bound"))
        )
        free = sized.withColumn("bound", bound).filter("g_a = g_b or bound <= 0")
        hopeful = stage(apart.select("a", "b").union(free.select("a", "b")).distinct(), "hopeful")
        ends = hopeful.select(F.col("a").alias("sid")).union(hopeful.select("b"))
        whole = self.whole_sets(ends)
        shared = F.size(F.array_intersect("i_a", "i_b"))
        union = F.size("i_a") + F.size("i_b") - shared
        return stage(
            hopeful.join(whole.toDF("a", "i_a"), "a").join(whole.toDF("b", "i_b"), "b")
            .filter(F.lit(100) * shared >= F.lit(self.percent) * union).select("a", "b"), "links")

    def links(self) -> DataFrame:
        """Edges (a, b) whose components are those of all links."""
        rows = stage(self.bucket_rows(), "rows")
        first = rows.groupBy("tok").agg(F.min("sid").alias("b"), F.max("sid").alias("top")).filter("b < top")
        star = rows.join(first, "tok").filter("sid != b").select(F.col("sid").alias("a"), "b").distinct()
        star = stage(star, "star")
        found = self.verified(star)
        part = connected_components(found).toDF("sid", "comp")
        placed = (
            rows.join(first.select("tok"), "tok").join(part, "sid", "left")
            .select("tok", "sid", "n", "pos", F.coalesce("comp", "sid").alias("comp"))
        )
        mixed = placed.groupBy("tok").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        open_rows = stage(
            placed.join(mixed.filter("low < high"), "tok").select("tok", "sid", "n", "pos", "comp", "low"), "open")
        outside = open_rows.filter("comp != low").toDF("tok", "a", "n_a", "pos_a", "c_a", "low_a")
        others = open_rows.toDF("tok", "b", "n_b", "pos_b", "c_b", "low")
        # At the first shingle that two sets share, what follows must still be enough.
        need = _alpha(F.col("n_a"), F.col("n_b"), self.percent)
        rest = (
            outside.join(others, (outside["tok"] == others["tok"]) & F.expr("c_a != c_b and (c_b = low or a > b)")
                         & (F.col("n_a") - F.col("pos_a") >= need) & (F.col("n_b") - F.col("pos_b") >= need))
            .select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
        )
        return found.unionByName(self.verified(rest))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS,
    percent: int = PERCENT, heavy: int = HEAVY,
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    join = _Join(narrow, k, percent, heavy)
    # Rows that share an id are one node.
    twice = (
        join.nodes.groupBy("doc_id").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.count(F.lit(1)).alias("c"))
        .filter("c > 1")
    )
    tied = (
        twice.join(join.nodes.select("doc_id", "sid"), "doc_id").filter("sid != lo")
        .select(F.col("sid").alias("a"), F.col("lo").alias("b"))
    )
    parts = stage(connected_components(join.links().unionByName(tied)).toDF("sid", "comp"), "parts")
    placed = (
        join.nodes.join(parts, "sid", "left")
        .groupBy("doc_id").agg(F.min(F.coalesce("comp", "sid")).alias("component_id"))
    )
    return join.sets.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
)
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {WORDS}
        THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS sh FROM d),
flat AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
walk AS (
  SELECT doc_id, doc_id AS r FROM d
  UNION SELECT l.b, walk.r FROM walk JOIN links l ON l.a = walk.doc_id WHERE walk.r < l.b)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM walk GROUP BY 1) c USING (doc_id)
"""
