"""Scoring, top-n selection, canonical grouping and table sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsfunnel import dims
from newsfunnel.functions import dates, money
from newsfunnel.operators.numbering import with_ordinal


def deal_score(
    deals: DataFrame, now: Column, window_days: int, weights: dict[str, float] = dims.WEIGHTS
) -> DataFrame:
    """Weighted sum of relevance, credibility, recency and size. Clock and window are given
    once and are the same for every stage."""
    score = (
        F.lit(weights["relevance"]) * F.col("relevance_conf")
        + F.lit(weights["credibility"]) * F.col("credibility_score")
        + F.lit(weights["recency"]) * dates.recency_score(F.col("announced_date"), now, window_days)
        + F.lit(weights["size"]) * money.size_score(F.col("deal_value"), F.col("currency"))
    )
    return deals.withColumn("score", score)


def rank_deals(scored: DataFrame, top_n: int = dims.TOP_N) -> DataFrame:
    """The `top_n` best deals with rank_pos 1..n; ties go to the earlier arrival.

    The limit runs before the numbering, so the window sees top_n rows only.
    """
    order = [F.desc("score"), F.asc("feed_pos"), F.asc("deal_id")]
    return scored.orderBy(*order).limit(top_n).withColumn(
        "rank_pos", F.row_number().over(Window.orderBy(*order))
    )


def group_by_category(selected: DataFrame, categories: DataFrame) -> DataFrame:
    """Selected deals with category_pos and item_pos: canonical category order, rank order
    inside. Categories without deals do not appear."""
    inside = Window.partitionBy("category").orderBy("rank_pos")
    return selected.join(categories, "category").withColumn(
        "item_pos", F.row_number().over(inside)
    )


def sort_key(key: str) -> Column:
    if key == "value":
        return money.usd_millions(F.col("deal_value"), F.col("currency"))
    if key == "announced":
        return F.col("announced_date")
    if key == "confidence":
        rank = F.lit(None).cast("int")
        for badge, level in dims.BADGE_RANK.items():
            rank = F.when(F.col("confidence") == badge, F.lit(level)).otherwise(rank)
        return rank
    raise ValueError(f"unknown sort key: {key}")


def sort_table(deals: DataFrame, key: str, direction: str = "desc", stable_by=("rank_pos",)):
    """Rows numbered (row_pos from 1) by value, announcement or badge. Missing values go last
    in both directions; equal keys keep the order of `stable_by`."""
    column = sort_key(key)
    first = column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last()
    numbered = with_ordinal(deals, [first, *[F.asc(c) for c in stable_by]], "row_pos")
    return numbered.withColumn("row_pos", F.col("row_pos") + 1)


def facet_filter(
    deals: DataFrame, category: str = "all", deal_type: str = "all", confidence: str = "all"
) -> DataFrame:
    """Keep rows matching every facet; 'all' switches a facet off."""
    for column, wanted in (
        ("category", category), ("deal_type", deal_type), ("confidence", confidence)
    ):
        if wanted != "all":
            deals = deals.filter(F.col(column) == wanted)
    return deals


def facet_values(deals: DataFrame) -> DataFrame:
    """(facet, value, n): the categories and types present, with their counts, in one pass."""
    facets = F.array(
        F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")),
        F.struct(F.lit("deal_type").alias("facet"), F.col("deal_type").alias("value")),
    )
    return deals.select(F.inline(facets)).groupBy("facet", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
