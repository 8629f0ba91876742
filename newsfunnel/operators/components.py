"""Connected components by alternating large-star and small-star steps.

Ids are mapped once to whole numbers in their own order, so rounds hash and compare eight bytes.
Each step is one grouped minimum (combined before the shuffle) and one equi-join back, so a hub
node is never gathered anywhere; adaptive execution splits its join partition. The edge set is
materialised in reliable storage after every round, in one action that also takes its fingerprint;
the round before is deleted then.

Many edges are contracted first: every node goes over to the neighbour of the smallest hash, which
is drawn anew each round, so that nodes and edges shrink by a share a round and finished components
drop out, instead of being written again in every round of stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from newsfunnel.operators.numbering import with_ordinal
from newsfunnel.session import StageStore, cut_lineage, drop_path, stage_store, write_stage

CONTRACT_ABOVE = 200_000  # edges; below, a round costs its start more than its rows


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"))
    return (
        both.filter(F.col("v") > F.col("u")).join(low, "u")
        .select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect every smaller neighbour of a node, and the node, to its smallest neighbour."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = (
        edges.join(low, "u").filter(F.col("v") != F.col("low"))
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
    )
    return moved.union(low.select("u", F.col("low").alias("v"))).distinct()


def _stored(edges: DataFrame) -> tuple[DataFrame, str, dict]:
    return write_stage(
        edges, "edges", n=F.count(F.lit(1)), x=F.bit_xor(F.xxhash64("u", "v")),
        s=F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")))


def _heads(edges: DataFrame, seed: int) -> DataFrame:
    """(node, head): the neighbour with the smallest hash of this round, or the node itself if its own
    is smaller. Any neighbour keeps what is connected connected, so equal hashes do no harm."""
    ends = edges.select(F.inline(F.expr(
        "array(named_struct('node', u, 'next', v), named_struct('node', v, 'next', u))")))
    low = ends.groupBy("node").agg(F.min_by("next", F.xxhash64("next", F.lit(seed))).alias("low"))
    own, other = F.xxhash64("node", F.lit(seed)), F.xxhash64("low", F.lit(seed))
    lower = (other < own) | ((other == own) & (F.col("low") < F.col("node")))
    return low.select("node", F.when(lower, F.col("low")).otherwise(F.col("node")).alias("head"))


def _contracted(edges: DataFrame, heads: DataFrame) -> DataFrame:
    for side in ("u", "v"):
        edges = edges.join(heads.toDF(side, f"head_{side}"), side)
    return edges.filter("head_u != head_v").select(
        F.greatest("head_u", "head_v").alias("u"), F.least("head_u", "head_v").alias("v")).distinct()


def _components_of_numbers(edges: DataFrame, max_rounds: int, spent: str | None = None) -> DataFrame:
    """`spent` is the path of a table that nothing but `edges` reads."""
    spark = edges.sparkSession
    current, path, seen = _stored(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    if spent:
        drop_path(spark, spent)
    rounds = []
    while seen["n"] > CONTRACT_ABOVE and len(rounds) < max_rounds:
        rounds.append(write_stage(_heads(current, len(rounds)), "heads")[:2])
        current, new_path, seen = _stored(_contracted(current, rounds[-1][0]))
        drop_path(spark, path)
        path = new_path
    for _ in range(max_rounds):
        if seen["n"] == 0:
            break
        current, new_path, now = _stored(_small_star(_large_star(current)))
        drop_path(spark, path)
        path = new_path
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    if not rounds:
        return found
    for heads, heads_path in reversed(rounds):  # a head that is not found has no further neighbour
        found, new_path, _ = write_stage(heads.join(found.withColumnRenamed("node", "head"), "head", "left").select(
            "node", F.coalesce("component", "head").alias("component")), "found")
        drop_path(spark, heads_path)
        drop_path(spark, path)
        path = new_path
    names = found.groupBy("component").agg(F.min("node").alias("name"))
    return found.join(names, "component").select("node", F.col("name").alias("component"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b); the component is named by
    its smallest node. Nodes without edges are not listed: they are their own component."""
    if isinstance(edges.schema["a"].dataType, IntegralType):
        return _components_of_numbers(edges, max_rounds)
    pairs, path, _ = write_stage(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    work = StageStore(edges.sparkSession, "nodes")
    with stage_store(work):
        numbered = with_ordinal(nodes, [F.asc("node")], "n")
    names = cut_lineage(numbered, "names")
    work.release()

    def number(side: str) -> DataFrame:
        return names.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"))

    numbers = pairs.join(number("a"), "a").join(number("b"), "b").select(
        F.col("n_a").alias("a"), F.col("n_b").alias("b"))
    found = _components_of_numbers(numbers, max_rounds, path).toDF("n_node", "n_component")
    return found.join(number("node"), "n_node").join(number("component"), "n_component").select("node", "component")
