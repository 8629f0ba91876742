"""Threshold calibration on labelled and unlabelled pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsfunnel import dims
from newsfunnel.functions import text
from newsfunnel.operators import cosine


def similarity_band(
    pairs: DataFrame, low: float = dims.BAND_LOW, high: float = dims.BAND_HIGH
) -> DataFrame:
    return pairs.filter((F.col("sim") >= low) & (F.col("sim") < high))


def control_separation(pairs: DataFrame) -> DataFrame:
    """One row over labelled pairs (truth SAME or DIFFERENT, sim): both ranges, and whether a
    threshold can split them (gap and midpoint) or by how much they overlap."""
    same, different = F.col("truth") == "SAME", F.col("truth") == "DIFFERENT"
    ranges = pairs.agg(
        F.min(F.when(same, F.col("sim"))).alias("min_same"),
        F.max(F.when(same, F.col("sim"))).alias("max_same"),
        F.min(F.when(different, F.col("sim"))).alias("min_different"),
        F.max(F.when(different, F.col("sim"))).alias("max_different"),
    )
    separable = F.col("min_same") > F.col("max_different")
    return ranges.withColumns({
        "verdict": F.when(separable, F.lit("SEPARABLE")).otherwise(F.lit("OVERLAP")),
        "width": F.abs(F.col("min_same") - F.col("max_different")),
        "midpoint": F.when(separable, (F.col("min_same") + F.col("max_different")) / 2),
    })


def threshold_sweep(
    vectors: DataFrame, thresholds: list[float] = dims.SWEEP_THRESHOLDS,
    current: float = dims.COSINE_THRESHOLD, **columns,
) -> DataFrame:
    """(threshold, pairs, is_current): how many pairs would merge at each threshold."""
    return cosine.pair_counts(vectors, thresholds, **columns).withColumn(
        "is_current", F.col("threshold") == current
    )


def with_title_ratio(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """Scored pairs (a, b, sim) with both titles and their token-sort ratio, for inspection."""
    left = articles.select(F.col("id").alias("a"), F.col("title").alias("title_a"))
    right = articles.select(F.col("id").alias("b"), F.col("title").alias("title_b"))
    return pairs.join(left, "a").join(right, "b").withColumn(
        "ratio", text.token_sort_ratio(F.col("title_a"), F.col("title_b"))
    )
