"""Deal records: coercion, identity merge, credibility, ranking, digest, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsfunnel import dims
from newsfunnel.operators import (
    credibility, deals as deal_ops, diagnostics, digest, merge, rank,
)
from newsfunnel.session import run_dir
from newsfunnel.sources import exports

from checks import sqlviews as S, views as V
from checks.registry import query

GENERIC = dims.GENERIC_TOKENS

# --- coercion and gate --------------------------------------------------------------------

_COERCED = f"""
    SELECT deal_id, acquirer,
      CASE feed_pos % 11 WHEN 2 THEN 'Undisclosed' WHEN 9 THEN 'Beverages Major' ELSE target END
        AS target,
      CASE WHEN feed_pos % 11 <> 1 THEN deal_type WHEN feed_pos % 2 = 0 THEN 'JV' ELSE 'M&A' END
        AS deal_type,
      v AS deal_value, CASE WHEN v IS NOT NULL THEN currency END AS currency,
      CASE WHEN feed_pos % 11 <> 5 THEN stake_pct END AS stake_pct,
      CASE WHEN category IN {S.in_list(V.CATEGORIES)} THEN category ELSE 'Other' END AS category,
      region,
      strftime(CASE WHEN feed_pos % 11 = 6 THEN TIMESTAMP '2024-02-01' ELSE announced_date END,
        '%Y-%m-%d') AS announced,
      relevance_conf
    FROM (SELECT *, CASE WHEN currency IS NULL THEN NULL ELSE CASE feed_pos % 11
        WHEN 0 THEN 1200.0::DOUBLE WHEN 3 THEN NULL WHEN 4 THEN NULL
        ELSE CAST(CAST(deal_value AS DECIMAL(30,2)) AS DOUBLE) END END AS v FROM deals_v)
    WHERE feed_pos % 11 <> 8"""


def coerced(spark, sf):
    return deal_ops.coerce_deals(V.deals_raw_v(spark, sf), V.CATEGORIES)


@query("coerce_deal", S.with_views("deals_v", body=f"""
    SELECT * REPLACE (floor(deal_value) AS deal_value) FROM ({_COERCED})"""))
def coerce_deal(spark, sf):
    return coerced(spark, sf).select(
        "deal_id", "acquirer", "target", "deal_type",
        F.floor("deal_value").cast("double").alias("deal_value"), "currency",
        "stake_pct", "category", "region",
        F.date_format("announced_date", "yyyy-MM-dd").alias("announced"), "relevance_conf")


@query("publishable", S.with_views("deals_v", body=f"""
    SELECT deal_id, feed_pos % 11 NOT IN (2, 9) AND target <> 'Undisclosed' AS publishable
    FROM deals_v WHERE feed_pos % 11 <> 8"""))
def publishable(spark, sf):
    kept, rejected = deal_ops.split_publishable(coerced(spark, sf))
    return kept.select("deal_id", F.lit(True).alias("publishable")).unionByName(
        rejected.select("deal_id", F.lit(False).alias("publishable")))


@query("attach_verdicts", S.with_views("doc_articles_v", "verdicts_v", body="""
    SELECT id, coalesce(is_deal, true) AS is_deal,
      CASE WHEN is_deal IS NULL THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence
    FROM doc_articles_v LEFT JOIN verdicts_v USING (id)"""))
def attach_verdicts(spark, sf):
    verdicts = V.verdicts_v(spark, sf).select(
        "id", "is_deal", F.lit(0.9).alias("confidence"), F.lit("label").alias("reasoning"))
    items = V.doc_articles_v(spark, sf).select("id")
    return deal_ops.attach_verdicts(items, verdicts).select("id", "is_deal", "confidence")


# --- identity merge -----------------------------------------------------------------------

_UND = "(lower(trim({0}.acquirer)) IN ('', 'undisclosed'))"
_EQ = (
    "coalesce(x.currency IS NOT DISTINCT FROM y.currency AND abs(x.deal_value - y.deal_value) "
    "<= 0.01::DOUBLE * greatest(x.deal_value, y.deal_value), false)"
)


def _identity(deals: str) -> list[str]:
    return [
        f"toks AS (SELECT *, {S.distinctive('target')} AS tt, {S.distinctive('acquirer')} AS at "
        f"FROM ({deals}))",
        "pairs AS (SELECT x.deal_id AS a, y.deal_id AS b FROM toks x JOIN toks y ON "
        "x.deal_type = y.deal_type AND x.deal_id < y.deal_id "
        "AND y.announced_date BETWEEN x.announced_date - INTERVAL 5 DAY "
        "AND x.announced_date + INTERVAL 5 DAY "
        "WHERE list_has_any(x.tt, y.tt) AND CASE "
        f"WHEN NOT {_UND.format('x')} AND NOT {_UND.format('y')} THEN "
        "list_has_any(x.at, y.at) AND (x.deal_value IS NULL OR y.deal_value IS NULL "
        f"OR {_EQ}) ELSE {_EQ} OR coalesce(x.stake_pct = y.stake_pct, false) END)",
    ]


def busy_deals(spark, sf):
    """Deals told by a second outlet a day later, without value, so that groups form."""
    deals = V.deals_v(spark, sf)
    again = deals.withColumns({
        "deal_id": F.concat("deal_id", F.lit("b")),
        "cluster_id": F.concat("cluster_id", F.lit("b")),
        "deal_value": F.when(F.col("acquirer") == "Undisclosed", F.col("deal_value")),
        "currency": F.when(F.col("acquirer") == "Undisclosed", F.col("currency")),
        "announced_date": F.col("announced_date") + F.make_dt_interval(days=F.lit(1)),
        "feed_pos": F.col("feed_pos") + 1_000_000_000,
    })
    return deals.unionByName(again)


_BUSY = """SELECT * FROM deals_v UNION ALL SELECT * REPLACE (deal_id || 'b' AS deal_id,
    cluster_id || 'b' AS cluster_id,
    CASE WHEN acquirer = 'Undisclosed' THEN deal_value END AS deal_value,
    CASE WHEN acquirer = 'Undisclosed' THEN currency END AS currency,
    announced_date + INTERVAL 1 DAY AS announced_date, feed_pos + 1000000000 AS feed_pos)
    FROM deals_v"""
_NODES = "SELECT a FROM pairs UNION SELECT b FROM pairs"


@query("same_deal_pairs", S.with_views(
    "deals_v", recursive=True,
    extra=_identity("SELECT * FROM deals_v") + S.components(_NODES, "SELECT a, b FROM pairs"),
    body="SELECT node, component FROM comp"))
def same_deal_pairs(spark, sf):
    """Same-deal groups of the orders' deals: every linked record with its group."""
    from newsfunnel.operators.components import connected_components

    return connected_components(merge.same_deal_links(V.deals_v(spark, sf)))


_MERGED = _identity(_BUSY) + S.components(_NODES, "SELECT a, b FROM pairs") + [
    f"busy AS ({_BUSY})",
    "sized AS (SELECT b.*, coalesce(component, deal_id) AS grp, "
    "CASE WHEN n IS NULL THEN 1 ELSE n END AS size "
    "FROM busy b LEFT JOIN comp ON node = deal_id "
    "LEFT JOIN (SELECT deal_id AS c, count(*) AS n FROM evidence_v GROUP BY 1) e "
    "ON e.c = b.cluster_id)",
    "best AS (SELECT * FROM sized QUALIFY row_number() OVER (PARTITION BY grp ORDER BY "
    "deal_value IS NULL, acquirer = 'Undisclosed', size DESC, announced_date, feed_pos) = 1)",
    "facts AS (SELECT grp, count(*) - 1 AS merged, "
    "arg_min(deal_value, feed_pos) FILTER (WHERE deal_value IS NOT NULL) AS value, "
    "arg_min(currency, feed_pos) FILTER (WHERE deal_value IS NOT NULL) AS cur, "
    "arg_min(acquirer, feed_pos) FILTER (WHERE acquirer <> 'Undisclosed') AS buyer, "
    "arg_min(stake_pct, feed_pos) FILTER (WHERE stake_pct IS NOT NULL) AS stake "
    "FROM sized GROUP BY 1)",
]


def _merge(spark, sf):
    deals = busy_deals(spark, sf)
    membership = V.deal_membership_v(spark, sf)
    clusters = membership.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return merge.merge_deals(deals, merge.same_deal_links(deals), membership, clusters)


@query("merge_deals", S.with_views(
    "deals_v", "evidence_v", recursive=True, extra=_MERGED, body="""
    SELECT deal_id, CASE WHEN b.acquirer = 'Undisclosed' THEN coalesce(buyer, b.acquirer)
        ELSE b.acquirer END AS acquirer,
      round(coalesce(b.deal_value, value), 2) AS deal_value,
      CASE WHEN b.deal_value IS NULL THEN cur ELSE b.currency END AS currency,
      coalesce(b.stake_pct, stake) AS stake_pct, CAST(merged AS BIGINT) AS merged
    FROM best b JOIN facts USING (grp)"""))
def merge_deals(spark, sf):
    merged, _ = _merge(spark, sf)
    return merged.select("deal_id", "acquirer", F.round("deal_value", 2).alias("deal_value"),
                         "currency", "stake_pct", "merged")


@query("merged_membership", S.with_views(
    "deals_v", "evidence_v", recursive=True, extra=_MERGED, body="""
    SELECT DISTINCT coalesce(e.article_id, s.deal_id) AS article_id, b.cluster_id
    FROM sized s JOIN best b USING (grp) LEFT JOIN evidence_v e ON e.deal_id = s.cluster_id"""))
def merged_membership(spark, sf):
    return _merge(spark, sf)[1]


# --- credibility --------------------------------------------------------------------------


@query("deal_evidence", S.with_views("deals_v", "evidence_v", body="""
    SELECT deal_id, article_id, source, source_tier FROM evidence_v
    JOIN deals_v USING (deal_id)"""))
def deal_evidence(spark, sf):
    return V.evidence_v(spark, sf)


@query("corroboration", S.with_views("evidence_v", body="""
    SELECT deal_id, array_to_string(list_sort(list(DISTINCT source)), '; ') AS sources
    FROM evidence_v JOIN orders ON deal_id = 'd' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0')
    GROUP BY 1"""))
def corroboration(spark, sf):
    lists = credibility.corroborating_sources(V.sources_v(spark, sf))
    return lists.select("deal_id", F.array_join("sources", "; ").alias("sources"))


@query("credibility", S.with_views("deals_scored_v", body="""
    SELECT deal_id, CAST(n_sources AS BIGINT) AS n_sources,
      round(credibility_score, 6) AS credibility_score, confidence FROM deals_scored_v"""))
def credibility_query(spark, sf):
    rated = credibility.apply_credibility(V.deals_v(spark, sf), V.sources_v(spark, sf))
    return rated.select("deal_id", "n_sources", F.round("credibility_score", 6).alias(
        "credibility_score"), "confidence")


# --- ranking ------------------------------------------------------------------------------


@query("deal_score", S.with_views("deals_scored_v", body="""
    SELECT deal_id, round(score, 6) AS score FROM deals_scored_v"""))
def deal_score(spark, sf):
    return V.deals_scored_v(spark, sf).select("deal_id", F.round("score", 6).alias("score"))


@query("rank_deals", S.with_views("selected_v", body="""
    SELECT deal_id, CAST(rank_pos AS INTEGER) AS rank_pos, round(score, 6) AS score
    FROM selected_v"""))
def rank_deals(spark, sf):
    return rank.rank_deals(V.deals_scored_v(spark, sf)).select(
        "deal_id", "rank_pos", F.round("score", 6).alias("score"))


def _grouped(spark, sf):
    return rank.group_by_category(
        rank.rank_deals(V.deals_scored_v(spark, sf)), dims.category_dim(spark, V.CATEGORIES))


_CATS = S.values_cte("cats", "category, category_pos", [
    (c, i) for i, c in enumerate(V.CATEGORIES)])
_ITEM_POS = "row_number() OVER (PARTITION BY category ORDER BY rank_pos)"


@query("grouped_deals", S.with_views("selected_v", extra=[_CATS], body=f"""
    SELECT category_pos, category, CAST({_ITEM_POS} AS INTEGER) AS item_pos, deal_id
    FROM selected_v JOIN cats USING (category)"""))
def grouped_deals(spark, sf):
    return _grouped(spark, sf).select("category_pos", "category", "item_pos", "deal_id")


def _sort_sql(order: str) -> str:
    return S.with_views("deals_scored_v", body=f"""
        SELECT deal_id, row_number() OVER (ORDER BY {order}, feed_pos) AS row_pos
        FROM deals_scored_v""")


@query("sort_value_asc", _sort_sql(f"{S.usd()} ASC NULLS LAST"))
def sort_value_asc(spark, sf):
    deals = V.deals_v(spark, sf).select("deal_id", "deal_value", "currency", "feed_pos")
    return rank.sort_table(deals, "value", "asc", ("feed_pos",)).select("deal_id", "row_pos")


@query("sort_value_desc", _sort_sql(f"{S.usd()} DESC NULLS LAST"))
def sort_value_desc(spark, sf):
    deals = V.deals_v(spark, sf).select("deal_id", "deal_value", "currency", "feed_pos")
    return rank.sort_table(deals, "value", "desc", ("feed_pos",)).select("deal_id", "row_pos")


@query("sort_announced", _sort_sql("announced_date DESC NULLS LAST"))
def sort_announced(spark, sf):
    deals = V.deals_v(spark, sf).select("deal_id", "announced_date", "feed_pos")
    return rank.sort_table(deals, "announced", "desc", ("feed_pos",)).select("deal_id", "row_pos")


@query("sort_confidence", _sort_sql(
    "CASE confidence WHEN 'High' THEN 3 WHEN 'Med' THEN 2 ELSE 1 END DESC"))
def sort_confidence(spark, sf):
    deals = V.deals_scored_v(spark, sf).select("deal_id", "confidence", "feed_pos")
    return rank.sort_table(deals, "confidence", "desc", ("feed_pos",)).select(
        "deal_id", "row_pos")


@query("facet_filter", S.with_views("deals_scored_v", body="""
    SELECT deal_id FROM deals_scored_v
    WHERE category = 'BUILDING' AND deal_type = 'Funding' AND confidence = 'High'"""))
def facet_filter(spark, sf):
    return rank.facet_filter(
        V.deals_scored_v(spark, sf), "BUILDING", "Funding", "High").select("deal_id")


@query("facet_values", S.with_views("deals_v", body="""
    SELECT 'category' AS facet, category AS value, count(*) AS n FROM deals_v GROUP BY 2
    UNION ALL SELECT 'deal_type', deal_type, count(*) FROM deals_v GROUP BY 2"""))
def facet_values(spark, sf):
    return rank.facet_values(V.deals_v(spark, sf))


@query("confidence_drift", S.with_views("deals_v", body="""
    SELECT round(min(relevance_conf), 6) AS min_conf, round(max(relevance_conf), 6) AS max_conf,
      count(DISTINCT round(relevance_conf, 2)) AS distinct_conf, count(*) AS deals
    FROM deals_v"""))
def confidence_drift(spark, sf):
    return diagnostics.confidence_drift(V.deals_v(spark, sf))


# --- digest -------------------------------------------------------------------------------


def _prose(spark, sf):
    """Conversation turns as prose of the deals: one row per turn, the last one counts."""
    def by_role(role: str):
        return F.when(F.col("role") == role, F.col("text")).otherwise(F.lit(" "))

    return V.table(spark, sf, "conversations").select(
        V.deal_id("conv_id").alias("deal_id"), F.col("turn").alias("pos"),
        by_role("user").alias("headline"), by_role("assistant").alias("summary"),
        by_role("system").alias("why_it_matters"))


def _urls(spark, sf):
    return V.table(spark, sf, "pages").select(V.deal_id("page_id").alias("id"), "url")


_PROSE = [
    f"prose AS (SELECT {S.deal_key('conv_id')} AS deal_id, role, {S.web_trim('text')} AS text "
    "FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)",
    f"urls AS (SELECT {S.deal_key('page_id')} AS deal_id, url FROM pages)",
]
_PROSE_COLS = """
      CASE WHEN role = 'user' AND text <> '' THEN text ELSE acquirer || ' → ' || target END
        AS headline,
      CASE WHEN role = 'assistant' AND text <> '' THEN text ELSE acquirer || CASE deal_type
        WHEN 'Funding' THEN ' invests in ' ELSE ' acquires ' END || target || '.' END AS summary,
      CASE WHEN role = 'system' THEN text ELSE '' END AS why_it_matters,
      coalesce(url, '') AS primary_source_url"""


@query("attach_prose", S.with_views("deals_v", extra=_PROSE, body=f"""
    SELECT deal_id, {_PROSE_COLS}
    FROM deals_v LEFT JOIN prose USING (deal_id) LEFT JOIN urls USING (deal_id)"""))
def attach_prose(spark, sf):
    return digest.attach_prose(V.deals_v(spark, sf), _prose(spark, sf), _urls(spark, sf)).select(
        "deal_id", "headline", "summary", "why_it_matters", "primary_source_url")


@query("sections_flat", S.with_views("selected_v", extra=[_CATS, *_PROSE], body=f"""
    SELECT category_pos, category, CAST({_ITEM_POS} AS INTEGER) AS item_no,
      CAST({_ITEM_POS} AS INTEGER) AS item_pos, deal_id, {_PROSE_COLS}, confidence AS badge
    FROM selected_v JOIN cats USING (category) LEFT JOIN prose USING (deal_id)
    LEFT JOIN urls USING (deal_id)"""))
def sections_flat(spark, sf):
    items = digest.attach_prose(_grouped(spark, sf), _prose(spark, sf), _urls(spark, sf))
    return digest.sections_flat(digest.build_sections(items))


def _selected_sources(spark, sf):
    deals, sources, _ = V.scored_and_sources(spark, sf)
    selected = rank.rank_deals(deals).select("deal_id")
    return sources.join(F.broadcast(selected), "deal_id", "left_semi")


@query("source_count", S.with_views("selected_v", body="""
    SELECT count(DISTINCT s) AS sources FROM (SELECT unnest(sources) AS s FROM selected_v)"""))
def source_count(spark, sf):
    return digest.source_count(_selected_sources(spark, sf))


@query("methodology", S.with_views("selected_v", "evidence_v", body="""
    SELECT 'Method: ' || (SELECT count(*) FROM evidence_v) || ' articles ingested from '
      || (SELECT count(DISTINCT s) FROM (SELECT unnest(sources) AS s FROM selected_v))
      || ' sources over the last 365 days, de-duplicated to '
      || (SELECT count(*) FROM deals_v) || ' unique stories (embedding similarity + title '
      || 'match), filtered to ' || (SELECT count(*) FROM deals_v WHERE deal_value IS NOT NULL)
      || ' confirmed FMCG deals, ranked to the top ' || (SELECT count(*) FROM selected_v)
      || '. Confidence badges reflect source tier and how many independent outlets reported a '
      || 'deal — they measure corroboration, not truth, and are not fact-checking. Deal values '
      || 'are as reported; "Undisclosed" means terms were not made public.' AS methodology,
      (SELECT strftime(max(announced_date) - INTERVAL 365 DAY, '%Y-%m-%d') || ' → '
        || strftime(max(announced_date), '%Y-%m-%d') FROM deals_v) AS period"""))
def methodology(spark, sf):
    from newsfunnel.functions import dates

    deals = V.deals_v(spark, sf)
    counts = _funnel_counts(spark, sf).withColumn("_one", F.lit(1))
    sources = digest.source_count(_selected_sources(spark, sf)).withColumn("_one", F.lit(1))
    window = deals.agg(F.max("announced_date").alias("to")).withColumn("_one", F.lit(1))
    start = dates.cutoff(F.col("to"), 365)
    return counts.join(sources, "_one").join(window, "_one").select(
        digest.methodology(
            F.col("ingested"), F.col("deduped"), F.col("relevant"), F.col("selected"),
            dates.window_days(start, F.col("to")), F.col("sources")).alias("methodology"),
        dates.period_label(start, F.col("to")).alias("period"))


def counted(deals, articles, selected):
    return diagnostics.funnel(diagnostics.stage_counts(
        ingested=articles, deduped=deals, relevant=deals.filter("deal_value is not null"), selected=selected))


def _funnel_counts(spark, sf):
    deals, articles = V.stored_deals(spark, sf)
    selected = rank.rank_deals(V.scored(deals, credibility.deal_sources(V.evidence_of(deals, articles))))
    return counted(deals, articles, selected)


_FUNNEL = """SELECT (SELECT count(*) FROM evidence_v) AS ingested,
    (SELECT count(*) FROM deals_v) AS deduped,
    (SELECT count(*) FROM deals_v WHERE deal_value IS NOT NULL) AS relevant,
    (SELECT count(*) FROM selected_v) AS selected"""


@query("funnel", S.with_views("selected_v", "evidence_v", body=f"""
    SELECT *, floor(selected::DOUBLE / ingested * 1000 + 0.5) / 10 AS retained_pct
    FROM ({_FUNNEL})"""))
def funnel(spark, sf):
    return _funnel_counts(spark, sf)


@query("funnel_bars", S.with_views("selected_v", "evidence_v", extra=[f"f AS ({_FUNNEL})"], body="""
    SELECT stage_pos, stage, n, round(greatest(n::DOUBLE / (SELECT ingested FROM f) * 100, 1.0), 6)
      AS bar_pct
    FROM (SELECT 0 AS stage_pos, 'ingested' AS stage, ingested AS n FROM f
      UNION ALL SELECT 1, 'deduped', deduped FROM f UNION ALL SELECT 2, 'relevant', relevant FROM f
      UNION ALL SELECT 3, 'selected', selected FROM f)"""))
def funnel_bars(spark, sf):
    return diagnostics.funnel_bars(_funnel_counts(spark, sf)).withColumn(
        "bar_pct", F.round("bar_pct", 6))


@query("digest_header", """
    SELECT lang, CASE WHEN n = 0 THEN 'No qualifying FMCG deals in this window.'
      WHEN lang = 'en' THEN 'first | second' ELSE n || ' FMCG deals tracked this period.' END
      AS tldr
    FROM (SELECT lang, count(*) FILTER (WHERE lang <> 'de') AS n FROM documents GROUP BY 1)""")
def digest_header(spark, sf):
    per_lang = V.table(spark, sf, "documents").groupBy("lang").agg(
        F.count_if(F.col("lang") != "de").alias("n"))
    bullets = F.when(
        F.col("lang") == "en", F.array(F.lit(" first "), F.lit("  "), F.lit("second")))
    return per_lang.select("lang", F.array_join(digest.tldr(F.col("n"), bullets), " | ").alias(
        "tldr"))


@query("deal_payload", S.with_views("deals_scored_v", body=f"""
    SELECT deal_id, CAST(to_json({{'deal_id': deal_id, 'acquirer': acquirer, 'target': target,
      'deal_type': deal_type, 'value': {S.format_value()}, 'stake_pct': stake_pct,
      'category': category, 'region': region,
      'announced': strftime(announced_date, '%Y-%m-%d'), 'confidence': confidence,
      'reported_by': coalesce(sources, [])}}) AS VARCHAR) AS payload
    FROM deals_scored_v"""))
def deal_payload(spark, sf):
    deals, sources, _ = V.scored_and_sources(spark, sf)
    return digest.deal_payload(deals, credibility.corroborating_sources(sources))


# --- exports ------------------------------------------------------------------------------


def exported(spark, sf):
    deals, sources, membership = V.scored_and_sources(spark, sf)
    clusters = membership.select("cluster_id").distinct().select(
        "cluster_id", F.col("cluster_id").alias("canonical_id"))
    return digest.export_rows(
        deals, credibility.corroborating_sources(sources), clusters, _urls(spark, sf))


_EXPORT = f"""
    SELECT acquirer AS "Acquirer", target AS "Target", deal_type AS "Type",
      {S.format_value()} AS "Value", {S.plain_number('deal_value')} AS "Value (raw)",
      coalesce(currency, '') AS "Currency", {S.plain_number('stake_pct')} AS "Stake %",
      category AS "Category", region AS "Region",
      strftime(announced_date, '%Y-%m-%d') AS "Announced", confidence AS "Confidence",
      array_to_string(sources, '; ') AS "Sources", CAST(n_sources AS {{0}}) AS "Source count",
      {S.plain_number('credibility_score')} AS "Credibility", coalesce(url, '') AS "Source URL"
    FROM deals_scored_v LEFT JOIN urls USING (deal_id)"""


@query("export_rows", S.with_views(
    "deals_scored_v", extra=_PROSE[1:], body=_EXPORT.format("BIGINT")))
def export_rows(spark, sf):
    return exported(spark, sf)


@query("export_csv_roundtrip", S.with_views(
    "deals_scored_v", extra=_PROSE[1:], body=f"""
    SELECT * REPLACE ('"' || "Acquirer" || '", Ltd' || chr(10) || 'x' AS "Acquirer")
    FROM ({_EXPORT.format('VARCHAR')})"""))
def export_csv_roundtrip(spark, sf):
    path = run_dir(spark, "csv")
    awkward = F.concat(F.lit('"'), F.col("Acquirer"), F.lit('", Ltd\nx'))
    exports.write_csv(exported(spark, sf).withColumn("Acquirer", awkward), path)
    return exports.read_csv(spark, path)
