"""Normalisation of raw articles and exact-URL de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from newsfunnel import dims
from newsfunnel.functions import text, urls
from newsfunnel.operators.ingest import unify_source


def tier_for(df: DataFrame, tiers: DataFrame, source: str = "source") -> DataFrame:
    """Add source_tier by allowlist lookup on a unified name; unknown publishers are tier 3."""
    known = tiers.withColumnRenamed("tier_source", source)
    return (
        df.drop("source_tier").join(known, source, "left")
        .withColumn("source_tier", F.coalesce("tier", F.lit(dims.UNKNOWN_TIER)))
        .drop("tier")
    )


def clean_articles(df: DataFrame, aliases: DataFrame, tiers: DataFrame) -> DataFrame:
    """Canonical URL and id, plain-text title and snippet, unified publisher and its tier."""
    return plain_texts(identify_articles(df, aliases, tiers))


def plain_texts(df: DataFrame) -> DataFrame:
    return df.withColumns({"title": text.strip_html(F.col("title")), "snippet": text.strip_html(F.col("snippet"))})


def identify_articles(df: DataFrame, aliases: DataFrame, tiers: DataFrame) -> DataFrame:
    """What copies are told by: canonical URL and id, unified publisher and its tier; texts as they are.

    Ids are recomputed from the canonical URL, so copies reached through different tracking
    links meet under one id.
    """
    url = urls.canonicalize_url(F.col("url"))
    cleaned = df.withColumn("url", url).withColumns({
        "id": urls.article_id(F.col("url")),
        "source": F.when(
            text.blank_to_null(F.col("source")).isNull(), urls.source_from_url(F.col("url"))
        ).otherwise(F.col("source")),
    })
    return tier_for(unify_source(cleaned, aliases), tiers)


def best_article(id_col: str = "id") -> list[str]:
    """Order of preference: lowest tier, then earliest, then first arrival, then id."""
    return ["source_tier", "published_at", "feed_pos", id_col]


def dedupe_by_url(df: DataFrame) -> DataFrame:
    """One row per id: lowest tier, then earliest, then first to arrive (feed_pos is unique).

    The winners are found on the four narrow columns, with a group limit before the shuffle, so an
    id with very many copies sends one row per task; complete rows are moved once, to meet them.
    """
    order = Window.partitionBy("id").orderBy("source_tier", "published_at", "feed_pos")
    best = (
        df.select("id", "source_tier", "published_at", "feed_pos")
        .withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").select("id", "feed_pos")
    )
    return df.join(best, ["id", "feed_pos"], "left_semi").select(*df.columns)
