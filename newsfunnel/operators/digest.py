"""Digest assembly: prose, sections, methodology, export rows. Works on selected deals, so the
nested forms hold at most top_n items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsfunnel import dims
from newsfunnel.functions import money, text


def attach_prose(items: DataFrame, prose: DataFrame, articles: DataFrame) -> DataFrame:
    """Headline, summary, why_it_matters and url per deal.

    `prose` is (deal_id, pos, headline, summary, why_it_matters); the last row per deal wins,
    rows for other deals are ignored and blank fields fall back to a template.
    """
    last = prose.groupBy("deal_id").agg(
        F.max_by(F.struct("headline", "summary", "why_it_matters"), "pos").alias("_p")
    )
    urls = articles.select(F.col("id").alias("deal_id"), "url")
    verb = F.when(F.col("deal_type") == "Funding", F.lit(dims.INVESTS)).otherwise(
        F.lit(dims.ACQUIRES)
    )
    return (
        items.join(last, "deal_id", "left").join(urls, "deal_id", "left")
        .withColumns({
            "headline": F.coalesce(
                text.blank_to_null(F.col("_p.headline")),
                F.concat("acquirer", F.lit(" → "), "target")),
            "summary": F.coalesce(
                text.blank_to_null(F.col("_p.summary")),
                F.concat("acquirer", verb, "target", F.lit("."))),
            "why_it_matters": F.coalesce(
                text.blank_to_null(F.col("_p.why_it_matters")), F.lit("")),
            "primary_source_url": F.coalesce("url", F.lit("")),
        })
        .drop("_p", "url")
    )


def build_sections(items: DataFrame) -> DataFrame:
    """(category_pos, category, items): one row per section, items in rank order.

    `items` are selected deals with category_pos, item_pos and prose columns.
    """
    item = F.struct(
        "item_pos", "deal_id", "headline", "summary", "why_it_matters", "primary_source_url",
        F.col("confidence").alias("badge"),
    )
    return items.groupBy("category_pos", "category").agg(
        F.sort_array(F.collect_list(item)).alias("items")
    )


def sections_flat(sections: DataFrame) -> DataFrame:
    return sections.select(
        "category_pos", "category", F.posexplode("items").alias("item_no", "item")
    ).select("category_pos", "category", (F.col("item_no") + 1).alias("item_no"), "item.*")


def source_count(selected_sources: DataFrame) -> DataFrame:
    """Distinct publishers behind the selected deals: one row, `sources`."""
    return selected_sources.agg(F.count_distinct("source").alias("sources"))


def methodology(
    ingested: Column, deduped: Column, relevant: Column, selected: Column, days: Column,
    sources: Column,
) -> Column:
    """The closing paragraph, from computed numbers only."""
    return F.format_string(
        dims.METHODOLOGY,
        ingested, sources, days, deduped, relevant, selected,
    )


def tldr(n_deals: Column, bullets: Column) -> Column:
    """Digest bullets: the given ones, trimmed and without blanks, or a counted fallback."""
    clean = F.filter(F.transform(bullets, text.web_trim), lambda b: b != "")
    return (
        F.when(n_deals == 0, F.array(F.lit(dims.NO_DEALS)))
        .when(F.coalesce(F.size(clean), F.lit(0)) > 0, clean)
        .otherwise(F.array(F.concat(
            n_deals.cast("string"), F.lit(dims.DEALS_TRACKED))))
    )


def deal_payload(deals: DataFrame, sources: DataFrame) -> DataFrame:
    """(deal_id, payload): the JSON facts a prose writer may use, and nothing else."""
    facts = F.struct(
        "deal_id", "acquirer", "target", "deal_type",
        money.format_value(F.col("deal_value"), F.col("currency")).alias("value"),
        "stake_pct", "category", "region",
        F.date_format("announced_date", "yyyy-MM-dd").alias("announced"),
        "confidence", F.coalesce("sources", F.array().cast("array<string>")).alias("reported_by"),
    )
    return deals.join(sources, "deal_id", "left").select(
        "deal_id", F.to_json(facts, {"ignoreNullFields": "false"}).alias("payload")
    )


def export_rows(
    deals: DataFrame, sources: DataFrame, clusters: DataFrame, articles: DataFrame
) -> DataFrame:
    """The 15-column export, all text or number: url by way of cluster and canonical article."""
    canonical = clusters.select("cluster_id", "canonical_id")
    urls = articles.select(F.col("id").alias("_canonical"), "url")
    joined = (
        deals.join(canonical, "cluster_id", "left")
        .withColumn("_canonical", F.coalesce("canonical_id", "deal_id"))
        .join(urls, "_canonical", "left")
        .join(sources, "deal_id", "left")
        .withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    )

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    columns = [
        F.col("acquirer"), F.col("target"), F.col("deal_type"),
        money.format_value(F.col("deal_value"), F.col("currency")),
        plain_number(F.col("deal_value")), shown("currency"), plain_number(F.col("stake_pct")),
        F.col("category"), F.col("region"), F.date_format("announced_date", "yyyy-MM-dd"),
        F.col("confidence"), F.array_join("sources", "; "),
        F.size("sources").cast("bigint"), plain_number(F.col("credibility_score")), shown("url"),
    ]
    return joined.select(*[c.alias(n) for c, n in zip(columns, dims.EXPORT_COLUMNS)])


def plain_number(c: Column) -> Column:
    """A number as plain decimal text, shortest form, never in exponent notation; '' for NULL."""
    digits = c.cast("string").try_cast("decimal(38,17)").cast("string")
    return F.coalesce(F.rtrim(F.rtrim(digits, F.lit("0")), F.lit(".")), F.lit(""))
