"""Credibility: best source tier plus independent corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsfunnel import dims
from newsfunnel.operators.merge import members_of


def badge_for(score: Column) -> Column:
    out = None
    for floor, badge in dims.BADGES:
        rule = score >= floor
        out = F.when(rule, F.lit(badge)) if out is None else out.when(rule, F.lit(badge))
    return out.otherwise(F.lit(dims.LOWEST_BADGE))


def deal_evidence(deals: DataFrame, membership: DataFrame, articles: DataFrame) -> DataFrame:
    """(deal_id, article_id, source, source_tier) of every article behind a deal.

    A deal whose cluster is unknown falls back to its own article; members without an article
    are dropped.
    """
    members = members_of(deals.select("deal_id", "cluster_id"), membership, "deal_id")
    known = articles.select(F.col("id").alias("article_id"), "source", "source_tier")
    return members.select("deal_id", "article_id").join(known, "article_id")


def deal_sources(evidence: DataFrame) -> DataFrame:
    """(deal_id, source, tier): each publisher once per deal, however many articles it ran."""
    return evidence.groupBy("deal_id", "source").agg(F.min("source_tier").alias("tier"))


def corroborating_sources(sources: DataFrame) -> DataFrame:
    """(deal_id, sources): publisher names, sorted. Takes the already distinct long form, so a
    list is bounded by the number of publishers."""
    return sources.groupBy("deal_id").agg(
        F.sort_array(F.collect_list("source")).alias("sources")
    )


def credibility_score(best_tier: Column, n_sources: Column) -> Column:
    base = F.lit(dims.TIER_SCORE[3])
    for tier in (1, 2):
        base = F.when(best_tier == tier, F.lit(dims.TIER_SCORE[tier])).otherwise(base)
    extra = F.greatest(n_sources - 1, F.lit(0)) * F.lit(dims.CORROBORATION_STEP)
    return F.least(base + F.least(extra, F.lit(dims.CORROBORATION_CAP)), F.lit(1.0))


def apply_credibility(deals: DataFrame, sources: DataFrame) -> DataFrame:
    """Add n_sources, credibility_score and the badge `confidence`.

    A deal without evidence scores as an unknown publisher with no outlet.
    """
    per_deal = sources.groupBy("deal_id").agg(
        F.min("tier").alias("best_tier"), F.count(F.lit(1)).alias("n_sources")
    )
    scored = deals.join(per_deal, "deal_id", "left").withColumns({
        "best_tier": F.coalesce("best_tier", F.lit(dims.UNKNOWN_TIER)),
        "n_sources": F.coalesce("n_sources", F.lit(0)).cast("bigint"),
    }).withColumn(
        "credibility_score", credibility_score(F.col("best_tier"), F.col("n_sources"))
    )
    return scored.withColumn("confidence", badge_for(F.col("credibility_score"))).drop("best_tier")
