"""Feed operators: grid, scan, failures, window, cap, publishers, URL de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsfunnel import dims
from newsfunnel.functions import model_json
from newsfunnel.operators import clean, diagnostics, ingest
from newsfunnel.session import run_dir
from newsfunnel.sources import feeds

from checks import sqlviews as S, views as V
from checks.registry import query

_VERBS = ", ".join(f"({i}, {S.lit(v)})" for i, v in enumerate(dims.QUERY_VERBS))


@query("query_grid", f"""
    SELECT s_name || ' & Co ' || verb AS name,
      '{dims.SEARCH_URL_PREFIX}' || replace(s_name, '#', '%23') || '%20%26%20Co%20' || verb
        || '{dims.SEARCH_URL_SUFFIX}' AS url,
      CAST(pos * n + s_suppkey AS BIGINT) AS grid_pos
    FROM supplier, (VALUES {_VERBS}) v(pos, verb), (SELECT count(*) AS n FROM supplier)
    WHERE pos < 2""")
def query_grid(spark, sf):
    terms = V.table(spark, sf, "supplier").select(
        F.concat("s_name", F.lit(" & Co")).alias("term"), F.col("s_suppkey").alias("term_pos"))
    return ingest.query_grid(terms)


@query("expected_feeds", f"""
    SELECT s_name || ' & Co ' || verb AS feed,
      '{dims.SEARCH_URL_PREFIX}' || replace(s_name, '#', '%23') || '%20%26%20Co%20' || verb
        || '{dims.SEARCH_URL_SUFFIX}' AS url
    FROM supplier, (VALUES {_VERBS}) v(pos, verb), (SELECT count(*) AS n FROM supplier)
    WHERE pos * n + s_suppkey < 8
    UNION ALL VALUES {", ".join(f"({S.lit(k)}, {S.lit(v)})" for k, v in dims.DIRECT_FEEDS.items())}""")
def expected_feeds(spark, sf):
    """What a refresh expects: the first queries of the grid and the direct feeds."""
    terms = V.table(spark, sf, "supplier").select(
        F.concat("s_name", F.lit(" & Co")).alias("term"), F.col("s_suppkey").alias("term_pos"))
    return ingest.expected_feeds(terms, limit=dims.REFRESH_PRESET["query_limit"])


def landed_pages(spark, sf, folder: str) -> str:
    """Pages landed as RSS files, one folder per publisher domain."""
    path = f"{run_dir(spark, folder)}/feeds"
    articles = V.articles_v(spark, sf)
    items = articles.select(
        F.regexp_extract("source", r"[^.]+$", 0).alias("feed"),
        F.concat("title", F.lit(" - "), "source").alias("title"),
        F.col("url").alias("link"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pubDate"),
        F.col("snippet").alias("description"),
    )
    feeds.write_feeds(items, path)
    return path


@query("scan_feeds", S.with_views("articles_v", body=f"""
    SELECT regexp_extract(source, '[^.]+$') AS feed, trim(title || ' - ' || source) AS title,
      url AS link, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS "pubDate",
      {S.strip_html('snippet')} AS "contentSnippet"
    FROM articles_v"""))
def scan_feeds(spark, sf):
    items = feeds.good_items(feeds.scan_feeds(spark, landed_pages(spark, sf, "scan")))
    return items.select("feed", "title", "link", "pubDate", "contentSnippet")


@query("feed_failures", """
    SELECT 'u' || c_custkey AS feed, CASE WHEN items IS NULL THEN 'no items'
      ELSE 'unreadable items: ' || broken END AS error
    FROM customer FULL JOIN (SELECT user_id, count(*) AS items,
      count(*) FILTER (WHERE event_type = 'error' AND value < 5) AS broken
      FROM events GROUP BY 1) ON user_id = c_custkey
    WHERE c_custkey IS NOT NULL AND (items IS NULL OR broken > 0)""")
def feed_failures(spark, sf):
    props = F.col("props")
    cut = (F.col("event_type") == "error") & (F.col("value") < 5)
    payload = F.when(cut, F.substring(props, 1, 4)).otherwise(props)
    feed = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    scan = V.table(spark, sf, "events").select(
        feed.alias("feed"),
        model_json.text_at(model_json.parse_model_json(payload), "$").alias("title"),
        F.when(model_json.parse_model_json(payload).isNull(), payload).alias("_corrupt_record"))
    expected = V.table(spark, sf, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("feed"))
    return feeds.feed_failures(scan, expected)


@query("filter_window", f"""
    SELECT event_id FROM events WHERE ts >= TIMESTAMP '{S.EVENTS_NOW}' - INTERVAL 21 DAY""")
def filter_window(spark, sf):
    events = V.table(spark, sf, "events")
    return ingest.filter_window(events, F.lit(V.EVENTS_NOW), 21, "ts").select("event_id")


@query("cap_per_feed", """
    SELECT event_type, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 25""")
def cap_per_feed(spark, sf):
    events = V.table(spark, sf, "events").select("event_type", "event_id")
    return ingest.cap_per_feed(events, 25, "event_type", ("event_id",))


@query("refresh_preset", f"""
    SELECT event_type, event_id FROM events
    WHERE ts >= TIMESTAMP '{S.EVENTS_NOW}' - INTERVAL 21 DAY
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 10""")
def refresh_preset(spark, sf):
    preset = dims.REFRESH_PRESET
    recent = ingest.filter_window(
        V.table(spark, sf, "events").select("event_type", "event_id", "ts"),
        F.lit(V.EVENTS_NOW), preset["window_days"], "ts")
    return ingest.cap_per_feed(
        recent.drop("ts"), preset["per_feed_cap"], "event_type", ("event_id",))


@query("resolve_source", """
    SELECT p_partkey, title, source FROM (
      SELECT p_partkey, p_name || ' - ' || p_type AS title, p_brand AS source FROM part
      WHERE p_size % 3 = 0
      UNION ALL SELECT p_partkey, p_name, '' FROM part WHERE p_size % 3 = 1
      UNION ALL SELECT p_partkey, p_name, 'feed ' || p_type FROM part WHERE p_size % 3 = 2)""")
def resolve_source(spark, sf):
    kind = F.col("p_size") % 3
    title = F.when(kind == 0, F.concat_ws(" - ", "p_name", "p_type", "p_brand")).when(
        kind == 1, F.concat("p_name", F.lit(" - "), "p_brand")).otherwise(F.col("p_name"))
    items = V.table(spark, sf, "part").select(
        "p_partkey", title.alias("title"),
        F.when(kind == 1, F.lit("")).alias("source"),
        F.concat(F.lit("feed "), "p_type").alias("feed"))
    return ingest.resolve_source(items).drop("feed")


@query("drop_blocked", f"""
    SELECT page_id FROM pages WHERE {S.host('url')} NOT IN {S.in_list(V.BLOCKED)}""")
def drop_blocked(spark, sf):
    host = F.concat(F.lit(" WWW."), F.upper(F.regexp_extract("url", "//(?:www[.])?([^/?#]+)", 1)))
    pages = V.table(spark, sf, "pages").select("page_id", host.alias("source"))
    return ingest.drop_blocked(
        pages, dims.blocklist_dim(spark, V.BLOCKED), dims.alias_dim(spark, V.ALIASES)
    ).select("page_id")


@query("union_feeds", """
    SELECT 'document' AS feed, doc_id AS item FROM documents
    UNION ALL SELECT 'page', page_id FROM pages""")
def union_feeds(spark, sf):
    docs = V.table(spark, sf, "documents").select(
        F.lit("document").alias("feed"), F.col("doc_id").alias("item"))
    pages = V.table(spark, sf, "pages").select(
        F.lit("page").alias("feed"), F.col("page_id").alias("item"))
    return ingest.union_feeds(docs, pages)


@query("dedupe_by_url", S.with_views("articles_v", body="""
    SELECT id, feed_pos, source_tier FROM articles_v
    QUALIFY row_number() OVER (PARTITION BY id
      ORDER BY source_tier, published_at, feed_pos) = 1"""))
def dedupe_by_url(spark, sf):
    return clean.dedupe_by_url(V.articles_v(spark, sf)).select("id", "feed_pos", "source_tier")


@query("clean_articles", S.with_views("articles_v", body=f"""
    SELECT feed_pos, {S.canonical_url('url')} AS url, {S.strip_html('title')} AS title,
      CASE WHEN source_tier = 1 THEN {S.host('url')} ELSE source END AS source,
      CASE WHEN source LIKE 'thth%' THEN 1 ELSE 3 END AS tier_of
    FROM articles_v"""))
def clean_articles(spark, sf):
    raw = V.articles_v(spark, sf).withColumn(
        "source", F.when(F.col("source_tier") != 1, F.col("source")).otherwise(F.lit(" ")))
    hosts = V.articles_v(spark, sf).select("source").distinct().filter("source like 'thth%'")
    tiers = hosts.select(F.col("source").alias("tier_source"), F.lit(1).alias("tier"))
    return clean.clean_articles(raw, dims.alias_dim(spark), tiers).select(
        "feed_pos", "url", "title", "source", F.col("source_tier").alias("tier_of"))


@query("tier_counts", S.with_views("articles_v", body="""
    SELECT t AS source_tier, count(source_tier) AS n
    FROM (VALUES (1), (2), (3)) d(t) LEFT JOIN articles_v ON source_tier = t GROUP BY 1"""))
def tier_counts(spark, sf):
    return diagnostics.tier_counts(V.articles_v(spark, sf))
