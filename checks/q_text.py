"""Scalar expressions: text, URL, date, number, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsfunnel import dims
from newsfunnel.functions import dates, model_json, money, text, urls, vectors
from newsfunnel.operators import clean, ingest

from checks import sqlviews as S, views as V
from checks.registry import query


@query("strip_html", f"SELECT page_id, {S.strip_html('html')} AS plain FROM pages")
def strip_html(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias(
        "plain"))


@query("canonicalize_url", S.with_views("articles_v", body=f"""
    SELECT feed_pos, {S.canonical_url('url')} AS canonical FROM articles_v"""))
def canonicalize_url(spark, sf):
    return V.articles_v(spark, sf).select(
        "feed_pos", urls.canonicalize_url(F.col("url")).alias("canonical"))


@query("article_id", f"SELECT page_id, {S.article_id('url')} AS id FROM pages")
def article_id(spark, sf):
    return V.table(spark, sf, "pages").select(
        "page_id", urls.article_id(F.col("url")).alias("id"))


@query("source_from_url", f"""
    SELECT page_id, {S.host('url')} AS of_url, 'Unknown' AS of_path
    FROM pages""")
def source_from_url(spark, sf):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return V.table(spark, sf, "pages").select(
        "page_id", urls.source_from_url(F.col("url")).alias("of_url"),
        urls.source_from_url(path).alias("of_path"))


@query("unify_source", """
    SELECT doc_id, CASE source WHEN 'src0' THEN 'src1' ELSE source END AS source
    FROM documents""")
def unify_source(spark, sf):
    noisy = F.concat(F.lit(" WWW."), F.upper("source"), F.lit(" "))
    docs = V.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("source") == "src0", noisy).otherwise(F.col("source")).alias(
            "source"))
    return ingest.unify_source(docs, dims.alias_dim(spark, V.ALIASES))


@query("tier_for", f"""
    SELECT doc_id, CASE WHEN source IN {S.in_list(V.TIER1)} THEN 1
      WHEN source IN {S.in_list(V.TIER2)} THEN 2 ELSE 3 END AS source_tier FROM documents""")
def tier_for(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "source")
    unified = ingest.unify_source(docs, dims.alias_dim(spark, V.ALIASES))
    tiers = dims.tier_dim(spark, V.TIER1, V.TIER2)
    return clean.tier_for(unified, tiers).select("doc_id", "source_tier")


@query("normalise_ts", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN
      'about ' || strftime(o_orderdate, '%Y-%m-%d')
      WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 4 THEN '12:30'
      ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') END AS published FROM orders""")
def normalise_ts(spark, sf):
    day = F.col("o_orderdate")
    raw = F.when(
        F.col("o_orderstatus") == "F",
        F.concat(F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")),
    ).when(
        F.col("o_orderstatus") == "P", F.concat(F.lit("about "), F.date_format(day, "yyyy-MM-dd"))
    ).when(
        F.col("o_orderkey") % 5 == 1, F.date_format(day, "EEE, d MMM yyyy HH:mm 'GMT'")
    ).when(
        F.col("o_orderkey") % 5 == 2, F.date_format(day, "d MMM yy HH:mm:ss '+0000'")
    ).when(
        F.col("o_orderkey") % 5 == 3, F.date_format(day, "EEE, d MMMM yyyy HH:mm:ss 'GMT'")
    ).when(
        F.col("o_orderkey") % 5 == 4, F.lit("12:30")
    ).otherwise(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return V.table(spark, sf, "orders").select(
        "o_orderkey", dates.normalise_ts(raw).alias("published"))


@query("embed_text", S.with_views("articles_v", body="""
    SELECT feed_pos, left(title || '. ' || snippet, 512) AS embed_text,
      '7. Title: ' || title || chr(10) || '   Source: ' || source || chr(10)
        || '   Snippet: ' || left(snippet, 400) AS prompt,
      '7. ' || title AS title_line,
      'Title: ' || title || chr(10) || 'Source: ' || source || chr(10) || 'Date: '
        || strftime(published_at, '%Y-%m-%d') || chr(10) || 'Snippet: '
        || left(snippet, 800) AS extract_prompt
    FROM articles_v"""))
def embed_text(spark, sf):
    title, snippet, source = F.col("title"), F.col("snippet"), F.col("source")
    return V.articles_v(spark, sf).select(
        "feed_pos", text.embed_text(title, snippet).alias("embed_text"),
        text.article_lines(F.lit(7), title, source, snippet).alias("prompt"),
        text.title_line(F.lit(7), title).alias("title_line"),
        text.extract_prompt(title, source, F.col("published_at"), snippet).alias(
            "extract_prompt"))


@query("normalize_title", f"SELECT doc_id, {S.norm_title('text')} AS norm FROM documents")
def normalize_title(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", text.normalize_title(F.col("text")).alias("norm"))


@query("token_sort_ratio", f"""
    WITH n AS (SELECT conv_id, turn, {S.norm_title('text')} AS norm FROM conversations)
    SELECT x.conv_id, x.turn, {S.title_ratio('x.norm', 'y.norm')} AS ratio
    FROM n x JOIN n y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1""")
def token_sort_ratio(spark, sf):
    turns = V.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return turns.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", text.token_sort_ratio(F.col("text"), F.col("next")).alias("ratio"))


@query("distinctive_tokens", f"""
    SELECT o.name, array_to_string({S.distinctive('o.name')}, ' ') AS tokens,
      len({S.distinctive('o.name')}) > 0 AS names_entity
    FROM (SELECT p_name || ' Foods of India' AS name FROM part
          UNION ALL SELECT c_name || ' Group' FROM customer
          UNION ALL SELECT 'The ' || n_name || ' Beverages Major' FROM nation
          UNION ALL SELECT 'Leading Global Brands' FROM region) o""")
def distinctive_tokens(spark, sf):
    def named(table, expr):
        return V.table(spark, sf, table).select(F.expr(expr).alias("name"))

    names = (
        named("part", "p_name || ' Foods of India'")
        .unionByName(named("customer", "c_name || ' Group'"))
        .unionByName(named("nation", "'The ' || n_name || ' Beverages Major'"))
        .unionByName(named("region", "'Leading Global Brands'"))
    )
    tokens = text.distinctive_tokens(F.col("name"))
    return names.select(
        "name", F.array_join(tokens, " ").alias("tokens"),
        text.names_an_entity(F.col("name")).alias("names_entity"))


@query("shares_token", S.with_views("deals_v", body=f"""
    SELECT x.deal_id, list_has_any({S.distinctive('x.target')}, {S.distinctive('y.target')})
      AS shares
    FROM deals_v x JOIN deals_v y ON y.feed_pos = x.feed_pos + 1"""))
def shares_token(spark, sf):
    deals = V.deals_v(spark, sf).select("deal_id", "feed_pos", "target")
    after = deals.select((F.col("feed_pos") - 1).alias("feed_pos"), F.col("target").alias("next"))
    return deals.join(after, "feed_pos").select(
        "deal_id", text.shares_distinctive_token(F.col("target"), F.col("next")).alias("shares"))


@query("clean_number", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN round(o_totalprice, 6) END AS n
    FROM orders""")
def clean_number(spark, sf):
    price = F.col("o_totalprice")
    raw = F.when(F.col("o_orderstatus") == "F", F.format_number(price, 2)).when(
        F.col("o_orderstatus") == "O", (-price).cast("string")).otherwise(F.lit("n/a"))
    return V.table(spark, sf, "orders").select(
        "o_orderkey", F.round(money.clean_number(raw), 6).alias("n"))


@query("plausible_value", S.with_views("deals_v", body="""
    SELECT deal_id, CASE WHEN v <= CASE currency WHEN 'INR_CRORE' THEN 1e5
      WHEN 'USD_MILLION' THEN 1e5 WHEN 'INR' THEN 1e13 WHEN 'USD' THEN 1e11 END THEN v END
      AS value
    FROM (SELECT deal_id, deal_value * 400 AS v,
      CASE WHEN region = 'ASIA' THEN 'EUR' ELSE currency END AS currency FROM deals_v)"""))
def plausible_value(spark, sf):
    currency = F.when(F.col("region") == "ASIA", F.lit("EUR")).otherwise(F.col("currency"))
    return V.deals_v(spark, sf).select("deal_id", money.plausible_value(
        F.col("deal_value") * 400, currency).alias("value"))


@query("iso_date_or", """
    SELECT o_orderkey, strftime(coalesce(CASE WHEN o_orderstatus <> 'P' THEN
      try_cast(CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
        ELSE strftime(o_orderdate, '%Y-%m-31') END AS TIMESTAMP) END,
      TIMESTAMP '2024-02-01'), '%Y-%m-%d') AS announced FROM orders""")
def iso_date_or(spark, sf):
    day = F.col("o_orderdate")
    raw = F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy-MM-dd")).when(
        F.col("o_orderstatus") == "O", F.date_format(day, "yyyy-MM-'31'")
    ).otherwise(F.date_format(day, "yyyy/MM/dd"))
    out = dates.iso_date_or(raw, F.lit("2024-02-01").cast("timestamp"))
    return V.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(out, "yyyy-MM-dd").alias("announced"))


@query("usd_millions", S.with_views("deals_v", body=f"""
    SELECT deal_id, round({S.usd()}, 6) AS usd FROM deals_v"""))
def usd_millions(spark, sf):
    return V.deals_v(spark, sf).select("deal_id", F.round(
        money.usd_millions(F.col("deal_value"), F.col("currency")), 6).alias("usd"))


@query("size_score", S.with_views("deals_v", body=f"""
    SELECT deal_id, {S.size_score()} AS size_score FROM deals_v"""))
def size_score(spark, sf):
    return V.deals_v(spark, sf).select("deal_id", money.size_score(
        F.col("deal_value"), F.col("currency")).alias("size_score"))


@query("recency_score", f"""
    SELECT event_id, round({S.recency('ts', S.EVENTS_NOW, 21)}, 6) AS recency FROM events""")
def recency_score(spark, sf):
    return V.table(spark, sf, "events").select("event_id", F.round(
        dates.recency_score(F.col("ts"), F.lit(V.EVENTS_NOW), 21), 6).alias("recency"))


@query("format_value", S.with_views("deals_v", body=f"""
    SELECT deal_id, {S.format_value()} AS shown, {S.format_value('deal_value', "'EUR'")} AS eur
    FROM deals_v"""))
def format_value(spark, sf):
    value = F.col("deal_value")
    return V.deals_v(spark, sf).select(
        "deal_id", money.format_value(value, F.col("currency")).alias("shown"),
        money.format_value(value, F.lit("EUR")).alias("eur"))


@query("relative_age", f"""
    WITH m AS (SELECT event_id, floor((epoch_ms(TIMESTAMP '{S.EVENTS_NOW}') - epoch_ms(ts))
        ::DOUBLE / 60000 + 0.5)::BIGINT AS mins FROM events),
      h AS (SELECT *, floor(mins::DOUBLE / 60 + 0.5)::BIGINT AS hrs FROM m),
      d AS (SELECT *, floor(hrs::DOUBLE / 24 + 0.5)::BIGINT AS days FROM h)
    SELECT event_id, CASE WHEN mins < 1 THEN 'just now' WHEN mins < 60 THEN mins || ' min ago'
      WHEN hrs < 24 THEN hrs || ' hour' || CASE WHEN hrs = 1 THEN '' ELSE 's' END || ' ago'
      ELSE days || ' day' || CASE WHEN days = 1 THEN '' ELSE 's' END || ' ago' END AS age
    FROM d""")
def relative_age(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id", dates.relative_age(F.col("ts"), F.lit(V.EVENTS_NOW)).alias("age"))


@query("cosine_column", """
    SELECT x.vec_id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]),
      6) AS sim
    FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""")
def cosine_column(spark, sf):
    vecs = V.table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return vecs.join(after, "vec_id").select("vec_id", F.round(
        vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("sim"))


@query("parse_model_json", """
    SELECT event_id, CASE WHEN event_type <> 'error' THEN
      CAST(json_extract(props, '$.k') AS DOUBLE) END AS k, event_type <> 'error' AS usable
    FROM events""")
def parse_model_json(spark, sf):
    props = F.col("props")
    answer = (
        F.when(F.col("event_type") == "error", F.substring(props, 1, 4))
        .when(F.col("event_type") == "click", F.concat(F.lit("Sure:\n"), props, F.lit(" ok?")))
        .otherwise(props)
    )
    v = model_json.parse_model_json(answer)
    return V.table(spark, sf, "events").select(
        "event_id", F.try_variant_get(v, "$.k", "double").alias("k"),
        v.isNotNull().alias("usable"))
