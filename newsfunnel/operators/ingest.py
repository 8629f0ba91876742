"""Feed items to raw articles: publisher resolution, blocklist, window, per-feed cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsfunnel import dims
from newsfunnel.functions import dates, text, urls


def query_grid(
    terms: DataFrame, verbs: list[str] = dims.QUERY_VERBS, limit: int | None = None
) -> DataFrame:
    """Search feeds (name, url, grid_pos) for every verb x term, verb-outer.

    `terms` is (term, term_pos) with positions 0..n-1. Each term meets the fixed verb list by
    exploding an array literal. The first `limit` grid positions are kept, by default two
    verbs per term, so breadth over terms comes before depth.
    """
    n_terms = terms.agg(F.count(F.lit(1)).alias("_n"))
    kept_verbs = F.array(*[F.lit(v) for v in verbs])
    grid = terms.select(
        "term", "term_pos", F.posexplode(kept_verbs).alias("verb_pos", "verb")
    )
    n = n_terms.first()["_n"]
    pos = (F.col("verb_pos").cast("bigint") * n + F.col("term_pos")).alias("grid_pos")
    name = F.concat_ws(" ", "term", "verb")
    out = grid.select(name.alias("name"), urls.search_url(name).alias("url"), pos)
    return out.filter(F.col("grid_pos") < (2 * n if limit is None else limit))


def published_at() -> Column:
    """When a landed item says it was published."""
    return dates.parse_feed_date(F.coalesce("isoDate", "pubDate"))


def filter_window(df: DataFrame, now: Column, days: int, ts: str = "published_at") -> DataFrame:
    """Rows with a date inside the window. There is no upper bound: future dates stay."""
    return df.filter(F.col(ts).isNotNull() & (F.col(ts) >= dates.cutoff(now, days)))


def split_title(title: Column) -> tuple[Column, Column]:
    """(title, publisher suffix) at the last ' - '; the suffix is NULL when there is none."""
    pattern = r"(?s)^(.*) - (.*)$"
    has_suffix = title.rlike(pattern)
    head = F.when(has_suffix, text.web_trim(F.regexp_extract(title, pattern, 1)))
    tail = F.when(has_suffix, text.web_trim(F.regexp_extract(title, pattern, 2)))
    return F.coalesce(head, title), tail


def resolve_source(df: DataFrame) -> DataFrame:
    """Publisher of an item: explicit source, else title suffix, else feed name.

    An explicit '' is kept as it is; only an absent source falls through.
    """
    title, suffix = split_title(F.col("title"))
    return df.withColumns(
        {"title": title, "source": F.coalesce(F.col("source"), suffix, F.col("feed"))}
    )


def publisher_key(raw: Column) -> Column:
    return F.regexp_replace(F.lower(text.web_trim(raw)), r"^www\.", "")


def unify_source(df: DataFrame, aliases: DataFrame, source: str = "source") -> DataFrame:
    """Replace a publisher spelling by its unified name; unknown ones are only trimmed.

    `aliases` is (alias_key, unified), a fixed lookup list.
    """
    keyed = df.withColumn("_key", publisher_key(F.col(source)))
    known = aliases.withColumnRenamed("alias_key", "_key")
    return (
        keyed.join(known, "_key", "left")
        .withColumn(source, F.coalesce("unified", text.web_trim(F.col(source))))
        .drop("_key", "unified")
    )


def drop_blocked(
    df: DataFrame, blocklist: DataFrame, aliases: DataFrame, source: str = "source"
) -> DataFrame:
    """Drop items whose raw or unified publisher is on the blocklist."""
    with_unified = unify_source(
        df.withColumn("_unified", F.col(source)), aliases, "_unified"
    ).withColumns({"_raw_key": publisher_key(F.col(source)), "_uni_key": F.lower("_unified")})
    for key in ("_raw_key", "_uni_key"):
        with_unified = with_unified.join(
            blocklist, with_unified[key] == blocklist["blocked"], "left_anti"
        )
    return with_unified.drop("_unified", "_raw_key", "_uni_key")


def cap_per_feed(
    df: DataFrame, cap: int | None = dims.PER_FEED_CAP, feed: str = "feed",
    order: tuple = ("feed_pos",),
) -> DataFrame:
    """The first `cap` accepted items of each feed, in arrival order; all of them if it is None.

    Catalyst turns this into a partial group limit before the shuffle, so even a feed that
    holds most rows sends at most `cap` rows per task.
    """
    if cap is None:
        return df
    first = Window.partitionBy(feed).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= cap).drop("_rn")
    )


def accept_items(
    items: DataFrame, now: Column, window_days: int, blocklist: DataFrame, aliases: DataFrame,
    per_feed_cap: int | None = dims.PER_FEED_CAP,
) -> DataFrame:
    """Feed items (feed, feed_pos, FEED_ITEM columns) to raw articles."""
    dated = items.filter(
        (F.coalesce("title", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != "")
    )
    if "published_at" not in items.columns:  # a store of items has read their dates already
        dated = dated.withColumn("published_at", published_at())
    kept = drop_blocked(
        resolve_source(filter_window(dated, now, window_days)), blocklist, aliases
    )
    return cap_per_feed(kept, per_feed_cap).select(
        urls.article_id(F.col("link")).alias("id"),
        "title",
        F.col("link").alias("url"),
        "source",
        F.lit(dims.UNKNOWN_TIER).alias("source_tier"),
        "published_at",
        F.coalesce("contentSnippet", "content", F.lit("")).alias("snippet"),
        F.col("feed").alias("query_term"),
        "feed_pos",
    )


def union_feeds(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All items of all feeds, duplicates kept."""
    for other in others:
        first = first.unionByName(other)
    return first


def expected_feeds(
    terms: DataFrame, direct: dict[str, str] = dims.DIRECT_FEEDS,
    verbs: list[str] = dims.QUERY_VERBS, limit: int | None = None,
) -> DataFrame:
    """(feed, url): the query grid, cut to `limit` queries, then the direct feeds."""
    grid = query_grid(terms, verbs, limit).select(F.col("name").alias("feed"), "url")
    rows = F.array(*[F.struct(F.lit(k).alias("feed"), F.lit(v).alias("url")) for k, v in direct.items()])
    return union_feeds(grid, terms.sparkSession.range(1).select(F.inline(rows)))
