"""Run diagnostics: funnel, relevance statistics, origin yield, tier counts, drift, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STAGES = ["ingested", "deduped", "relevant", "selected"]


def stage_counts(**stages: DataFrame) -> DataFrame:
    """(stage, n) of any number of frames, in one aggregation over their union."""
    tagged = None
    for name, frame in stages.items():
        part = frame.select(F.lit(name).alias("stage"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def funnel(counts: DataFrame) -> DataFrame:
    """One row: ingested, deduped, relevant, selected and the retained percentage."""
    picked = [
        F.coalesce(F.max(F.when(F.col("stage") == s, F.col("n"))), F.lit(0)).alias(s)
        for s in STAGES
    ]
    row = counts.agg(*picked)
    share = F.floor(F.col("selected") / F.col("ingested") * 1000 + 0.5) / 10
    return row.withColumn(
        "retained_pct", F.when(F.col("ingested") > 0, share).otherwise(F.lit(0.0))
    )


def funnel_bars(funnel_row: DataFrame) -> DataFrame:
    """(stage_pos, stage, n, bar_pct): bar widths relative to the first stage, at least 1."""
    steps = F.array(*[
        F.struct(F.lit(i).alias("stage_pos"), F.lit(s).alias("stage"), F.col(s).alias("n"))
        for i, s in enumerate(STAGES)
    ])
    widest = F.greatest(F.col("ingested"), F.lit(1))
    return funnel_row.select(widest.alias("_w"), F.inline(steps)).select(
        "stage_pos", "stage", "n",
        F.greatest(F.col("n") / F.col("_w") * 100, F.lit(1.0)).alias("bar_pct"),
    )


def relevance_stats(flags: DataFrame) -> DataFrame:
    """One row over per-article flags (pre_filtered, screen, answered, is_deal).

    screen is true, false or NULL (no answer); NULL is promoted. `unanswered` counts
    shortlisted articles without a verdict, which are dropped.
    """
    candidate = F.col("pre_filtered")
    shortlisted = candidate & F.coalesce("screen", F.lit(True))
    answered = shortlisted & F.col("answered")
    return flags.agg(
        F.count(F.lit(1)).alias("input"),
        F.count_if(candidate).alias("pre_filtered"),
        F.count_if(answered).alias("classified"),
        F.count_if(shortlisted).alias("batch_survivors"),
        F.count_if(answered & F.col("is_deal")).alias("relevant"),
        F.count_if(shortlisted & ~F.col("answered")).alias("unanswered"),
    ).withColumns({
        "calls_saved": F.col("input") - F.col("pre_filtered"),
        "false_positives": F.col("batch_survivors") - F.col("relevant"),
    })


def flag_relevant(articles: DataFrame, relevant_ids: DataFrame) -> DataFrame:
    """Add is_relevant: is the article in the relevant set?"""
    marks = relevant_ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return articles.join(marks, "id", "left").withColumn(
        "is_relevant", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def origin_yield(flagged: DataFrame) -> DataFrame:
    """(query_term, total, relevant) for every origin."""
    return flagged.groupBy("query_term").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_relevant").alias("relevant")
    )


def productive_origins(yields: DataFrame) -> DataFrame:
    return yields.filter("relevant > 0").orderBy(F.desc("relevant"), "query_term")


def origin_dead_weight(yields: DataFrame) -> DataFrame:
    """One row: origins that produced nothing, and the articles they brought."""
    idle = yields.filter("relevant = 0")
    return idle.agg(
        F.count(F.lit(1)).alias("origins"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("articles"),
    )


def tier_counts(articles: DataFrame) -> DataFrame:
    """(source_tier, n) for tiers 1 to 3, zero included."""
    counted = articles.agg(*[
        F.count_if(F.col("source_tier") == t).alias(f"t{t}") for t in (1, 2, 3)
    ])
    rows = F.array(*[
        F.struct(F.lit(t).alias("source_tier"), F.col(f"t{t}").alias("n")) for t in (1, 2, 3)
    ])
    return counted.select(F.inline(rows))


def confidence_drift(deals: DataFrame, conf: str = "relevance_conf") -> DataFrame:
    """One row: range and number of distinct two-decimal confidences of `deals` or of any rows
    with a confidence. One distinct value means the confidence carries no ranking signal."""
    c = F.col(conf)
    return deals.agg(
        F.min(c).alias("min_conf"), F.max(c).alias("max_conf"),
        F.count_distinct(F.round(c, 2)).alias("distinct_conf"),
        F.count(c).alias("deals"),
    )


def audit_chain(deals: DataFrame, membership: DataFrame, articles: DataFrame) -> DataFrame:
    """(deal_id, cluster_id, article_id, url): every deal down to the evidence it rests on."""
    urls = articles.select(F.col("id").alias("article_id"), "url")
    return (
        deals.select("deal_id", "cluster_id").join(membership, "cluster_id", "left")
        # A deal whose cluster is unknown rests on its own article.
        .withColumn("article_id", F.coalesce("article_id", "deal_id"))
        .join(urls, "article_id", "left")
        .select("deal_id", "cluster_id", "article_id", "url")
    )


def threshold_counts(scores: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n) of already scored rows, one pass."""
    counted = scores.agg(*[
        F.count_if(F.col(score) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)
    ])
    rows: Column = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n"))
        for i, t in enumerate(thresholds)
    ])
    return counted.select(F.inline(rows))
