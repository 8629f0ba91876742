"""The whole run: landed items to a ranked, audited digest."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsfunnel import dims
from newsfunnel.functions import dates, model_json, text
from newsfunnel.operators import (
    batches, cascade, clean, clusters, credibility, deals as deal_ops, diagnostics, digest,
    ingest, merge, rank,
)
from newsfunnel.session import StageStore, cut_lineage, stage_store
from newsfunnel.sources import feeds, snapshot


@dataclass
class DigestOptions:
    """`now` and `window_days` are given once and reach every stage."""

    now: datetime
    screen_fn: Callable
    confirm_fn: Callable
    extract_fn: Callable
    embed_fn: Callable | None = None
    prose_fn: Callable | None = None
    window_days: int = dims.WINDOW_DAYS
    per_feed_cap: int | None = dims.PER_FEED_CAP  # None: no cap
    query_limit: int | None = None  # queries of the grid that are expected to bring feeds
    expected: Callable | None = None  # (spark, query limit) -> feeds that should have items; else the grid's
    ledger: str | None = None  # folder that keeps the scorers' answers from run to run
    embed_store: str | None = None  # folder that keeps vectors from run to run
    embed_dim: int = dims.EMBED_DIM
    cosine_threshold: float = dims.COSINE_THRESHOLD
    title_ratio: int = dims.TITLE_MATCH_RATIO
    top_n: int = dims.TOP_N
    parallel: int | None = None
    title: str = "Deal digest"
    categories: list[str] = field(default_factory=lambda: list(dims.CATEGORIES))
    patterns: dict[str, str] = field(default_factory=dict)


@dataclass
class DigestRun:
    """The tables rest on stage tables in the run's own folder, which `close` deletes: store or read
    what is wanted first. Also a context manager."""

    tables: dict[str, DataFrame]
    diagnostics: dict[str, DataFrame]
    stages: StageStore | None = None

    def close(self) -> None:
        if self.stages is not None:
            self.stages.release()
            self.stages = None

    def __enter__(self) -> DigestRun:
        return self

    def __exit__(self, *error) -> None:
        self.close()


def _prose(selected: DataFrame, sources: DataFrame, fn: Callable | None):
    """(prose rows, tldr row) from one call over the selected deals (top_n at most)."""
    spark = selected.sparkSession
    schema = "deal_id string, pos int, headline string, summary string, why_it_matters string"
    if fn is None:
        return (
            spark.createDataFrame([], schema),
            spark.createDataFrame([([],)], "bullets array<string>"),
        )
    payloads = digest.deal_payload(selected, sources).join(
        selected.select("deal_id", F.col("rank_pos").alias("n")), "deal_id"
    ).withColumn("batch", F.lit(0).cast("bigint"))
    answer = cut_lineage(
        batches.score_batches(payloads, fn, ["payload"])
        .select(model_json.parse_model_json(F.col("response")).alias("v"))
        .select(
            F.to_json(F.try_variant_get("v", "$.items", "variant")).alias("items"),
            F.try_variant_get("v", "$.tldr", "array<string>").alias("bullets"),
        )
    )
    item = F.explode(F.try_variant_get(
        F.try_parse_json("items"), "$",
        "array<struct<deal_id:string,headline:string,summary:string,why_it_matters:string>>",
    ))
    rows = answer.select(item.alias("i")).select("i.*").withColumn(
        "pos", F.monotonically_increasing_id().cast("int")
    )
    bullets = answer.agg(F.first("bullets", ignorenulls=True).alias("bullets"))
    return rows, bullets


def run_digest(
    spark: SparkSession, items: DataFrame, opts: DigestOptions, scan: DataFrame | None = None,
) -> DigestRun:
    """Run every stage on feed items (feed, feed_pos and item columns).

    An empty result is valid. A scorer that raises FatalScoringError is not, and fails the run.
    `scan` has the items by which silent and broken feeds are told, if `items` are only some of them.
    Close the run when its tables are stored.
    """
    store = StageStore(spark)
    try:
        with stage_store(store):
            run = _run(spark, items, opts, items if scan is None else scan)
    except BaseException:
        store.release()
        raise
    run.stages = store
    return run


def _run(spark: SparkSession, items: DataFrame, opts: DigestOptions, scan: DataFrame) -> DigestRun:
    now = F.lit(opts.now)
    start = dates.cutoff(now, opts.window_days)
    aliases, tiers = dims.alias_dim(spark), dims.tier_dim(spark)
    expected = (
        opts.expected(spark, opts.query_limit) if opts.expected
        else ingest.expected_feeds(dims.term_dim(spark), limit=opts.query_limit)
    )
    scoring: list[DataFrame] = []
    raw = cut_lineage(ingest.accept_items(
        feeds.good_items(items), now, opts.window_days, dims.blocklist_dim(spark), aliases,
        opts.per_feed_cap,
    ))
    # Copies go first: only the texts that stay are cleaned.
    articles = cut_lineage(clean.plain_texts(clean.dedupe_by_url(clean.identify_articles(raw, aliases, tiers))))

    vectors = None
    if opts.embed_fn is not None:
        texts = articles.select("id", text.embed_text(F.col("title"), F.col("snippet")).alias("t"))
        vectors = cut_lineage(
            batches.embed_column(texts, opts.embed_fn, "id", "t", opts.embed_dim, store=opts.embed_store)
        )
    links = clusters.story_links(articles, vectors, opts.cosine_threshold, opts.title_ratio)
    membership, cluster_rows = clusters.build_clusters(articles, links)
    membership, cluster_rows = cut_lineage(membership), cut_lineage(cluster_rows)
    canonical = cut_lineage(clusters.canonical_articles(articles, cluster_rows))

    flags, verdicts = cascade.relevance_cascade(
        canonical, opts.screen_fn, opts.confirm_fn, parallel=opts.parallel, ledger=opts.ledger,
        failures=scoring, **opts.patterns
    )
    flags = cut_lineage(flags)
    relevant = cut_lineage(cascade.relevant_articles(canonical, verdicts))
    records = cut_lineage(deal_ops.flag_publishable(cascade.extract_deals(
        relevant, verdicts, opts.extract_fn, opts.parallel, opts.ledger, scoring, categories=opts.categories
    )))
    publishable = records.filter("publishable").drop("publishable")
    rejected = records.filter(~F.col("publishable")).select("acquirer", "target", "deal_type")

    merged, merged_membership = merge.merge_deals(
        publishable, merge.same_deal_links(publishable), membership, cluster_rows
    )
    merged, merged_membership = cut_lineage(merged), cut_lineage(merged_membership)
    evidence = credibility.deal_evidence(merged, merged_membership, articles)
    sources = cut_lineage(credibility.deal_sources(evidence))
    scored = rank.deal_score(
        credibility.apply_credibility(merged, sources), now, opts.window_days
    )
    selected = cut_lineage(rank.rank_deals(scored, opts.top_n))
    picked = sources.join(F.broadcast(selected.select("deal_id")), "deal_id", "left_semi")
    source_lists = credibility.corroborating_sources(picked)

    prose, bullets = _prose(selected, source_lists, opts.prose_fn)
    grouped = rank.group_by_category(selected, dims.category_dim(spark, opts.categories))
    sections = digest.build_sections(digest.attach_prose(grouped, prose, articles))

    funnel = cut_lineage(diagnostics.funnel(diagnostics.stage_counts(
        ingested=raw, deduped=canonical, relevant=relevant, selected=selected
    )))
    one = F.lit(1)
    header = (
        funnel.withColumn("_one", one)
        .join(digest.source_count(picked).withColumn("_one", one), "_one")
        .join(bullets.withColumn("_one", one), "_one")
        .select(
            F.lit(opts.title).alias("title"),
            now.alias("generated_at"), start.alias("window_from"), now.alias("window_to"),
            dates.period_label(start, now).alias("period"),
            digest.tldr(F.col("selected"), F.col("bullets")).alias("tldr"),
            digest.methodology(
                F.col("ingested"), F.col("deduped"), F.col("relevant"), F.col("selected"),
                dates.window_days(start, now), F.col("sources"),
            ).alias("methodology"),
        )
    )
    merged_clusters = merged_membership.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size")
    ).withColumn("canonical_id", F.col("cluster_id"))
    yields = diagnostics.origin_yield(
        diagnostics.flag_relevant(canonical, relevant.select("id"))
    )
    return DigestRun(
        tables={
            "deals": selected.join(source_lists, "deal_id", "left"),
            "clusters": merged_clusters.select("cluster_id", "canonical_id", "size"),
            "membership": merged_membership,
            "story_membership": membership,
            "articles": articles,
            "funnel": funnel,
            "sections": sections,
            "header": header,
        },
        diagnostics={
            "relevance": diagnostics.relevance_stats(flags),
            "rejected": rejected,
            "merged": merged.agg(F.coalesce(F.sum("merged"), F.lit(0)).alias("merged")),
            "origins": yields,
            "tiers": diagnostics.tier_counts(canonical),
            "drift": diagnostics.confidence_drift(
                verdicts.join(relevant.select("id"), "id", "left_semi"), "confidence"),
            "failures": feeds.feed_failures(scan, expected),
            "scoring": functools.reduce(DataFrame.unionByName, scoring),
        },
    )


def snapshot_export(run: DigestRun) -> dict[str, DataFrame]:
    """The run's JSON export: the nested digest (one row), the members of its clusters as rows
    (a cluster of any size has the same form) and its articles."""
    t = run.tables
    members, articles = snapshot.evidence(t["deals"], t["membership"], t["articles"])
    return {
        "digest": snapshot.snapshot_row(t["header"], t["funnel"], t["deals"], t["sections"]),
        "members": members,
        "articles": articles,
    }
