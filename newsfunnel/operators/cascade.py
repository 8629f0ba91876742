"""Relevance cascade: free pattern filter, cheap screen, careful confirmation; extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from newsfunnel import dims
from newsfunnel.functions import text
from newsfunnel.operators import batches
from newsfunnel.operators.deals import attach_verdicts, coerce_deals, coerce_verdict
from newsfunnel.session import cut_lineage


def passes_pre_filter(
    title: Column, snippet: Column,
    deal: str = dims.DEAL_VERB_PATTERN, signal: str = dims.SECTOR_SIGNAL_PATTERN,
    noise: str = dims.NOISE_PATTERN,
) -> Column:
    """Deal verb AND sector signal AND NOT noise, over the whole title and snippet. Noise is
    absolute; the other two favour recall."""
    hay = F.concat(title, F.lit(" "), snippet)
    return ~hay.rlike(f"(?i){noise}") & hay.rlike(f"(?i){deal}") & hay.rlike(f"(?i){signal}")


def pre_filter(articles: DataFrame, **patterns) -> DataFrame:
    return articles.filter(passes_pre_filter(F.col("title"), F.col("snippet"), **patterns))


def shortlist(screened: DataFrame, screen: str = "screen") -> DataFrame:
    """Drop a clear no; keep yes and no-answer, which the confirmation decides."""
    return screened.filter(F.coalesce(F.col(screen), F.lit(True)))


def confirmed(judged: DataFrame, flag: str = "is_deal") -> DataFrame:
    """Keep a clear yes only."""
    return judged.filter(F.coalesce(F.col(flag), F.lit(False)))


def relevance_cascade(
    articles: DataFrame, screen_fn: Callable, confirm_fn: Callable,
    order: list[str] = ("feed_pos", "id"), parallel: int | None = None, ledger: str | None = None,
    failures: list[DataFrame] | None = None, **patterns,
) -> tuple[DataFrame, DataFrame]:
    """(flags, verdicts).

    flags holds one row per article (id, pre_filtered, screen, answered, is_deal), enough for
    the statistics; verdicts is (id, is_deal, verdict_type, confidence, reasoning) for answered
    articles. Answers are materialised after each scorer, so a finished one is not called again.
    `failures` receives one row per scorer: how many of its batches failed, and why.
    """
    failures = [] if failures is None else failures
    by = [F.asc(c) for c in order]
    candidates = pre_filter(articles, **patterns)
    packed = cut_lineage(batches.pack_batches(candidates, dims.SCREEN_BATCH, by))
    answers = cut_lineage(batches.score_batches(packed, screen_fn, ["title"], parallel, ledger, "screen"))
    failures.append(batches.failed_batches("screen", answers))
    screened = cut_lineage(
        batches.match_by_echo(packed, answers)
        .withColumn("screen", batches.screen_flag(F.col("answer"))).drop("answer", "batch", "n")
    )
    packed = cut_lineage(batches.pack_batches(shortlist(screened), dims.CONFIRM_BATCH, by))
    answers = cut_lineage(
        batches.score_batches(packed, confirm_fn, ["title", "source", "snippet"], parallel, ledger, "confirm")
    )
    failures.append(batches.failed_batches("confirm", answers))
    judged = batches.match_by_echo(packed, answers, "$.verdicts").filter("answer is not null")
    verdicts = cut_lineage(
        judged.select("id", coerce_verdict(F.col("answer")).alias("v")).select("id", "v.*")
    )
    marks = screened.select("id", "screen", F.lit(True).alias("pre_filtered"))
    flags = (
        articles.select("id").join(marks, "id", "left")
        .join(verdicts.select("id", "is_deal"), "id", "left")
        .select(
            "id", F.coalesce("pre_filtered", F.lit(False)).alias("pre_filtered"), "screen",
            F.col("is_deal").isNotNull().alias("answered"),
            F.coalesce("is_deal", F.lit(False)).alias("is_deal"),
        )
    )
    return flags, verdicts


def relevant_articles(articles: DataFrame, verdicts: DataFrame) -> DataFrame:
    return articles.join(confirmed(verdicts).select("id"), "id", "left_semi")


def extract_deals(
    relevant: DataFrame, verdicts: DataFrame, extract_fn: Callable,
    parallel: int | None = None, ledger: str | None = None, failures: list[DataFrame] | None = None,
    **coercion,
) -> DataFrame:
    """Deal records of the relevant articles, one model call per article."""
    judged = attach_verdicts(relevant, verdicts)
    prompt = text.extract_prompt(
        F.col("title"), F.col("source"), F.col("published_at"), F.col("snippet")
    )
    # Batches of one need no order, only distinct numbers that stay as they are.
    packed = cut_lineage(judged.select(
        "id", prompt.alias("prompt"), F.lit(1).alias("n"),
        F.monotonically_increasing_id().alias("batch"),
    ))
    answers = cut_lineage(batches.score_batches(packed, extract_fn, ["prompt"], parallel, ledger, "extract"))
    if failures is not None:
        failures.append(batches.failed_batches("extract", answers))
    answered = packed.join(answers, "batch").select("id", F.col("response").alias("answer"))
    return coerce_deals(
        judged.select("id", "verdict_type", "confidence", "published_at", "feed_pos")
        .join(answered, "id"),
        **coercion,
    )
