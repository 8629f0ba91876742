"""Test views over the driver tables, one definition for Spark.

The SQL twins are in checks/sqlviews.py. Every view covers its whole tables and texts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsfunnel.functions import text, urls
from newsfunnel.operators import credibility, rank
from newsfunnel.session import cut_lineage, shared_dir, ship_package, spread

CATEGORIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NOW = dt.datetime(2001, 8, 2, tzinfo=dt.timezone.utc)
EVENTS_NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
WINDOW = 365
ALIASES = {"src0": "src1"}
TIER1, TIER2 = [f"src{i}" for i in range(0, 5)], [f"src{i}" for i in range(5, 10)]
BLOCKED = ["spam-farm.example.org"]
PATTERNS = {"deal": r"\bthe\b", "signal": r"\bof\b", "noise": r"\bwith\b"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    shared_dir(spark)
    ship_package(spark, "checks")  # stand-in models run in the workers
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    for field in df.schema.fields:  # stored without a zone; they are UTC
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return spread(df) if name in ("documents", "pages", "conversations") else df


def _hours_after(start: str, hours) -> F.Column:
    return F.lit(start).cast("timestamp") + F.make_dt_interval(hours=hours)


def articles_v(spark: SparkSession, sf: str) -> DataFrame:
    """Every page, plus a copy of every page reached through a tracking link an hour later."""
    pages = table(spark, sf, "pages").select(  # texts are read out of a page once, for both copies
        "page_id", "url", text.html_title(F.col("html")).alias("title"), text.strip_html(F.col("html")).alias("snippet"),
    ).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    joiner = F.when(F.col("url").contains("?"), F.lit("&")).otherwise(F.lit("?"))
    base, fragment = F.substring_index("url", "#", 1), F.regexp_extract("url", "#.*$", 0)
    tracked = F.concat(base, joiner, F.lit("utm_campaign=x"), fragment)
    url = F.when(F.col("copy") == 1, tracked).otherwise(F.col("url"))
    host = urls.host(F.col("url"))
    return pages.select(
        urls.article_id(urls.canonicalize_url(url)).alias("id"),
        "title",
        url.alias("url"),
        host.alias("source"),
        F.when(host.endswith(".com"), 1).when(host.endswith(".net"), 2).otherwise(3).alias(
            "source_tier"),
        _hours_after("2024-01-01", (F.col("page_id") + F.col("copy")).cast("int")).alias(
            "published_at"),
        "snippet",
        host.alias("query_term"),
        (F.col("page_id") + F.col("copy") * 1_000_000_000).alias("feed_pos"),
    )


def doc_articles_v(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as articles: the first line is the title, all the rest the snippet."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("a"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("id"),
        "doc_id",
        text.headline(F.col("text")).alias("title"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"),
        "source",
        F.lit(3).alias("source_tier"),
        _hours_after("2024-01-01", F.col("doc_id").cast("int")).alias("published_at"),
        text.after_headline(F.col("text")).alias("snippet"),
        F.col("source").alias("query_term"),
        F.col("doc_id").alias("feed_pos"),
    )


def deal_id(col: str) -> F.Column:
    return F.concat(F.lit("d"), F.lpad(F.col(col).cast("string"), 10, "0"))


def deals_v(spark: SparkSession, sf: str) -> DataFrame:
    """One deal per order that has line items."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("p_partkey"), F.min("l_quantity").alias("qty")
    )
    orders = table(spark, sf, "orders")
    joined = (
        orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
        .join(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    kind = F.substring("o_orderpriority", 1, 1)
    money = key % 5
    return joined.select(
        deal_id("o_orderkey").alias("deal_id"),
        deal_id("o_orderkey").alias("cluster_id"),
        F.when(F.col("o_custkey") % 7 == 0, F.lit("Undisclosed")).otherwise(
            F.replace(F.col("c_name"), F.lit("Customer#"), F.lit("C"))).alias("acquirer"),
        F.col("p_name").alias("target"),
        F.when(kind == "2", "Funding").when(kind == "3", "Stake").when(kind == "4", "JV")
        .otherwise("M&A").alias("deal_type"),
        F.when(money <= 1, price / 1000).when(money == 2, price * 10_000)
        .when(money == 3, price * 1000).alias("deal_value"),
        F.when(money == 0, "INR_CRORE").when(money == 1, "USD_MILLION").when(money == 2, "INR")
        .when(money == 3, "USD").alias("currency"),
        F.when(key % 3 == 0, F.col("qty")).alias("stake_pct"),
        F.col("c_mktsegment").alias("category"),
        F.col("r_name").alias("region"),
        F.col("o_orderdate").alias("announced_date"),
        ((key % 101) / 100).alias("relevance_conf"),
        key.alias("feed_pos"),
    )


def deal_articles_v(spark: SparkSession, sf: str) -> DataFrame:
    """(article_id, deal_id, source, source_tier): one article per line item and supplier."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat_ws("-", deal_id("l_orderkey"), F.col("l_suppkey").cast("string")).alias(
            "article_id"),
        deal_id("l_orderkey").alias("deal_id"),
        F.col("s_name").alias("source"),
        (F.col("l_suppkey") % 3 + 1).cast("int").alias("source_tier"),
    )


def membership_of(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", F.col("deal_id").alias("cluster_id"))


def deal_membership_v(spark: SparkSession, sf: str) -> DataFrame:
    return membership_of(deal_articles_v(spark, sf))


def stored_deals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The deals and their articles, each joined and stored once for queries that read them often."""
    return cut_lineage(deals_v(spark, sf), "deals"), cut_lineage(deal_articles_v(spark, sf), "articles")


def evidence_of(deals: DataFrame, articles: DataFrame) -> DataFrame:
    return credibility.deal_evidence(
        deals, membership_of(articles), articles.withColumnRenamed("article_id", "id"))


def scored(deals: DataFrame, sources: DataFrame) -> DataFrame:
    return rank.deal_score(credibility.apply_credibility(deals, sources), F.lit(NOW), WINDOW)


def evidence_v(spark: SparkSession, sf: str) -> DataFrame:
    return evidence_of(*stored_deals(spark, sf))


def sources_v(spark: SparkSession, sf: str) -> DataFrame:
    return credibility.deal_sources(evidence_v(spark, sf))


def deals_scored_v(spark: SparkSession, sf: str) -> DataFrame:
    deals, articles = stored_deals(spark, sf)
    return scored(deals, credibility.deal_sources(evidence_of(deals, articles)))


def scored_and_sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`deals_scored_v`, the `sources_v` behind it, which are found once, and the membership."""
    deals, articles = stored_deals(spark, sf)
    sources = cut_lineage(credibility.deal_sources(evidence_of(deals, articles)), "sources")
    return scored(deals, sources), sources, membership_of(articles)


def deals_raw_v(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers for every deal, with seeded defects by order key."""
    defect = F.col("feed_pos") % 11

    def num(c: str) -> F.Column:
        return F.when(F.col(c).isNull(), F.lit("null")).otherwise(
            F.col(c).cast("decimal(30,2)").cast("string"))

    def quoted(c: F.Column) -> F.Column:
        return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), c, F.lit('"')))

    def alt(when: int, bad: str, good: F.Column) -> F.Column:
        return F.when(defect == when, F.lit(bad)).otherwise(good)

    value = F.when(defect == 0, F.lit('"1,200"')).when(defect == 3, F.lit("900000000000000"))
    fields = [
        ("acquirer", quoted(F.col("acquirer"))),
        ("target", F.when(defect == 2, F.lit('" "')).when(
            defect == 9, F.lit('"Beverages Major"')).otherwise(quoted(F.col("target")))),
        ("deal_type", alt(1, '"Rumour"', quoted(F.col("deal_type")))),
        ("deal_value", value.otherwise(num("deal_value"))),
        ("currency", alt(4, "null", quoted(F.col("currency")))),
        ("stake_pct", alt(5, "140", num("stake_pct"))),
        ("category", quoted(F.col("category"))),
        ("region", quoted(F.col("region"))),
        ("announced_date", alt(6, '"2024-13-01"', quoted(
            F.date_format("announced_date", "yyyy-MM-dd")))),
    ]
    body = F.concat(
        F.lit("{"),
        F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in fields]),
        F.lit("}"),
    )
    answer = F.when(defect == 7, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).when(
        defect == 8, F.substring(body, 1, 40)).otherwise(body)
    return deals_v(spark, sf).select(
        F.col("deal_id").alias("id"), answer.alias("answer"),
        F.when(F.col("feed_pos") % 2 == 0, F.lit("JV")).alias("verdict_type"),
        F.col("relevance_conf").alias("confidence"),
        F.lit("2024-02-01").cast("timestamp").alias("published_at"), "feed_pos",
    )


def verdicts_v(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as verdicts of the documents."""
    return table(spark, sf, "labels").select(
        F.concat(F.lit("a"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("id"),
        (F.col("quality") == 1).alias("is_deal"),
        (F.col("toxic") == 0).alias("screen"),
    )
