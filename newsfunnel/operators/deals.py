"""Typed deal records out of model answers, and the publishability gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsfunnel import dims
from newsfunnel.functions import dates, model_json, money, text


def one_of(c: Column, allowed: list[str], *fallbacks: Column) -> Column:
    """`c` when it is an allowed value, else the first non-null fallback."""
    return F.coalesce(F.when(c.isin(allowed), c), *fallbacks)


def coerce_verdict(v: Column) -> Column:
    """Verdict struct of one parsed answer: strict flag, known type, confidence in [0, 1]."""
    confidence = model_json.number_at(v, "$.confidence")
    return F.struct(
        model_json.strictly_true(v, "$.is_fmcg_deal").alias("is_deal"),
        one_of(model_json.text_at(v, "$.deal_type"), dims.DEAL_TYPES).alias("verdict_type"),
        F.coalesce(F.when(confidence.between(0.0, 1.0), confidence), F.lit(0.5)).alias(
            "confidence"),
        F.coalesce(model_json.text_at(v, "$.reasoning"), F.lit("")).alias("reasoning"),
    )


def coerce_deals(
    answers: DataFrame, categories: list[str] = dims.CATEGORIES,
    caps: dict[str, float] = dims.MAX_VALUE,
) -> DataFrame:
    """Deal rows from (id, answer, verdict_type, confidence, published_at, feed_pos).

    Unusable answers give no row. Money needs a value and a known currency together; a share
    above 100 percent is dropped; blank names become Undisclosed.
    """
    fields = [
        "acquirer", "target", "deal_type", "deal_value", "currency", "stake_pct", "category",
        "region", "announced_date",
    ]
    currency = F.col("_a.currency")
    value = money.plausible_value(
        money.clean_number(F.col("_a.deal_value")), currency, caps
    )
    stake = money.clean_number(F.col("_a.stake_pct"))

    def named(field: str, default: str) -> Column:
        return F.coalesce(text.blank_to_null(F.col(f"_a.{field}")), F.lit(default))

    answered = answers.select(
        "id", "verdict_type", "confidence", "published_at", "feed_pos",
        F.explode(model_json.parsed_fields(F.col("answer"), fields)).alias("_a"),
    )
    return answered.select(
        F.col("id").alias("deal_id"),
        F.col("id").alias("cluster_id"),
        named("acquirer", dims.UNDISCLOSED).alias("acquirer"),
        named("target", dims.UNDISCLOSED).alias("target"),
        one_of(
            F.col("_a.deal_type"), dims.DEAL_TYPES, F.col("verdict_type"),
            F.lit(dims.DEAL_TYPES[0]),
        ).alias("deal_type"),
        value.alias("deal_value"),
        F.when(value.isNotNull(), currency).alias("currency"),
        F.when(stake <= 100, stake).alias("stake_pct"),
        one_of(F.col("_a.category"), categories, F.lit(dims.CATEGORIES[-1])).alias("category"),
        named("region", dims.DEFAULT_REGION).alias("region"),
        dates.iso_date_or(F.col("_a.announced_date"), F.col("published_at")).alias(
            "announced_date"),
        F.col("confidence").alias("relevance_conf"),
        "feed_pos",
    )


def is_publishable(target: Column, generic: list[str] = dims.GENERIC_TOKENS) -> Column:
    """A deal needs a target that names something; value and buyer may be undisclosed."""
    return (
        (target != dims.UNDISCLOSED) & (F.length(target) > 1)
        & text.names_an_entity(target, generic)
    )


def flag_publishable(deals: DataFrame, generic: list[str] = dims.GENERIC_TOKENS) -> DataFrame:
    """One flag column; callers split on it without computing the deals twice."""
    return deals.withColumn("publishable", is_publishable(F.col("target"), generic))


def split_publishable(
    deals: DataFrame, generic: list[str] = dims.GENERIC_TOKENS
) -> tuple[DataFrame, DataFrame]:
    flagged = flag_publishable(deals, generic)
    return (
        flagged.filter("publishable").drop("publishable"),
        flagged.filter(~F.col("publishable")).drop("publishable"),
    )


def attach_verdicts(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdict columns by id; an item without a verdict counts as a deal at 0.5."""
    return items.join(verdicts, "id", "left").withColumns({
        "is_deal": F.coalesce("is_deal", F.lit(True)),
        "confidence": F.coalesce("confidence", F.lit(0.5)),
        "reasoning": F.coalesce("reasoning", F.lit("")),
    })
