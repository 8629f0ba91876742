"""Batch scoring, the cascade, snapshots and the whole run."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from newsfunnel import dims
from newsfunnel.functions import text
from newsfunnel.operators import (
    batches, cascade, credibility, deals as deal_ops, diagnostics, digest, rank,
)
from newsfunnel.plans import digest_run
from newsfunnel.session import cut_lineage, run_dir
from newsfunnel.sources import exports, feeds, snapshot
from newsfunnel.streaming import refresh

from checks import q_deals, q_ingest, sqlviews as S, views as V
from checks.registry import query

# --- filters ------------------------------------------------------------------------------

_HAY = "(title || ' ' || snippet)"
_PASSES = " AND ".join([
    f"NOT regexp_matches({_HAY}, '(?i)' || {S.lit(V.PATTERNS['noise'])})",
    f"regexp_matches({_HAY}, '(?i)' || {S.lit(V.PATTERNS['deal'])})",
    f"regexp_matches({_HAY}, '(?i)' || {S.lit(V.PATTERNS['signal'])})",
])


@query("pre_filter", S.with_views("doc_articles_v", body=f"""
    SELECT id FROM doc_articles_v WHERE {_PASSES}"""))
def pre_filter(spark, sf):
    return cascade.pre_filter(V.doc_articles_v(spark, sf), **V.PATTERNS).select("id")


@query("pre_filter_default", f"""
    SELECT conv_id, turn, regexp_matches(t, '(?i)' || {S.lit(dims.NOISE_PATTERN)}) AS noise,
      regexp_matches(t, '(?i)' || {S.lit(dims.DEAL_VERB_PATTERN)}) AS deal,
      regexp_matches(t, '(?i)' || {S.lit(dims.SECTOR_SIGNAL_PATTERN)}) AS signal
    FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'FMCG firm to acquire stake ' || text
      WHEN 'assistant' THEN text || ' Purchases 12,045 Shares of Northwind (NYSE: NWC)'
      ELSE text END AS t FROM conversations)""")
def pre_filter_default(spark, sf):
    hay = F.when(F.col("role") == "user", F.concat(F.lit("FMCG firm to acquire stake "), "text")).when(
        F.col("role") == "assistant",
        F.concat("text", F.lit(" Purchases 12,045 Shares of Northwind (NYSE: NWC)"))
    ).otherwise(F.col("text"))
    return V.table(spark, sf, "conversations").select("conv_id", "turn", *[
        hay.rlike(f"(?i){pattern}").alias(name) for name, pattern in [
            ("noise", dims.NOISE_PATTERN), ("deal", dims.DEAL_VERB_PATTERN),
            ("signal", dims.SECTOR_SIGNAL_PATTERN)]])


@query("shortlist", S.with_views("doc_articles_v", "verdicts_v", body="""
    SELECT id FROM doc_articles_v LEFT JOIN verdicts_v USING (id)
    WHERE coalesce(screen, true)"""))
def shortlist(spark, sf):
    screened = V.doc_articles_v(spark, sf).join(V.verdicts_v(spark, sf), "id", "left")
    return cascade.shortlist(screened).select("id")


@query("confirmed", S.with_views("doc_articles_v", "verdicts_v", body="""
    SELECT id FROM doc_articles_v LEFT JOIN verdicts_v USING (id)
    WHERE coalesce(is_deal, false)"""))
def confirmed(spark, sf):
    judged = V.doc_articles_v(spark, sf).join(V.verdicts_v(spark, sf), "id", "left")
    return cascade.confirmed(judged).select("id")


_FLAGS = f"""flags AS (SELECT id, query_term, {_PASSES} AS pre, coalesce(screen, true) AS short,
    is_deal FROM doc_articles_v LEFT JOIN verdicts_v USING (id))"""


def _flags(spark, sf):
    docs = V.doc_articles_v(spark, sf).join(V.verdicts_v(spark, sf), "id", "left")
    return docs.select(
        "id", "query_term",
        cascade.passes_pre_filter(F.col("title"), F.col("snippet"), **V.PATTERNS).alias(
            "pre_filtered"),
        "screen", F.col("is_deal").isNotNull().alias("answered"),
        F.coalesce("is_deal", F.lit(False)).alias("is_deal"))


@query("relevance_stats", S.with_views("doc_articles_v", "verdicts_v", extra=[_FLAGS], body="""
    SELECT *, input - pre_filtered AS calls_saved, batch_survivors - relevant AS false_positives
    FROM (SELECT count(*) AS input, count(*) FILTER (WHERE pre) AS pre_filtered,
      count(*) FILTER (WHERE pre AND short AND is_deal IS NOT NULL) AS classified,
      count(*) FILTER (WHERE pre AND short) AS batch_survivors,
      count(*) FILTER (WHERE pre AND short AND is_deal) AS relevant,
      count(*) FILTER (WHERE pre AND short AND is_deal IS NULL) AS unanswered FROM flags)"""))
def relevance_stats(spark, sf):
    return diagnostics.relevance_stats(_flags(spark, sf))


def _yields(spark, sf):
    flags = _flags(spark, sf)
    hits = flags.filter("pre_filtered and coalesce(screen, true) and is_deal").select("id")
    return diagnostics.origin_yield(diagnostics.flag_relevant(flags.select("id", "query_term"), hits))


_YIELD = _FLAGS + """, yields AS (SELECT query_term, count(*) AS total,
    count(*) FILTER (WHERE coalesce(pre AND short AND is_deal, false)) AS relevant
    FROM flags GROUP BY 1)"""


@query("origin_yield", S.with_views("doc_articles_v", "verdicts_v", extra=[_YIELD], body="""
    SELECT query_term, total, relevant FROM yields WHERE relevant > 0"""))
def origin_yield(spark, sf):
    return diagnostics.productive_origins(_yields(spark, sf))


@query("origin_dead_weight", S.with_views("doc_articles_v", "verdicts_v", extra=[_YIELD], body="""
    SELECT count(*) AS origins, CAST(coalesce(sum(total), 0) AS BIGINT) AS articles
    FROM yields WHERE relevant = 0"""))
def origin_dead_weight(spark, sf):
    return diagnostics.origin_dead_weight(_yields(spark, sf))


# --- batches ------------------------------------------------------------------------------

_PACKED = """packed AS (SELECT *, (rn - 1) // 25 AS batch, CAST((rn - 1) % 25 + 1 AS INTEGER) AS n
    FROM (SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY conv_id, turn) AS rn
      FROM conversations))"""


def _packed(spark, sf):
    turns = V.table(spark, sf, "conversations")
    return batches.pack_batches(turns, 25, [F.asc("conv_id"), F.asc("turn")])


@query("pack_batches", f"WITH {_PACKED} SELECT conv_id, turn, batch, n FROM packed")
def pack_batches(spark, sf):
    return _packed(spark, sf).select("conv_id", "turn", "batch", "n")


@query("render_requests", f"""
    WITH {_PACKED} SELECT batch, CAST(count(*) AS INTEGER) AS n_items,
      string_agg(n || '. ' || text, chr(10) ORDER BY n) AS prompt,
      CAST(16 * count(*) + 32 AS INTEGER) AS max_tokens FROM packed GROUP BY 1""")
def render_requests(spark, sf):
    return batches.render_requests(_packed(spark, sf), text.title_line(F.col("n"), F.col("text")))


def shown(flag):
    """A three-valued flag as text."""
    return F.when(flag, F.lit("yes")).when(~flag, F.lit("no")).otherwise(F.lit("unanswered"))


@query("match_by_echo", f"""
    WITH {_PACKED} SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'unanswered'
      WHEN role = 'user' OR turn % 2 = 1 THEN 'yes' ELSE 'no' END AS screen FROM packed""")
def match_by_echo(spark, sf):
    """Answers are built from the turns: system turns stay unanswered, entries come in reverse
    order, and every answer is preceded by a contrary one that it overrides."""
    packed = _packed(spark, sf)
    d = F.when(F.col("role") == "user", F.lit("true")).otherwise(
        (F.col("turn") % 2).cast("string"))
    entry = F.concat(F.lit('{"n": '), F.col("n").cast("string"), F.lit(', "d": '), d, F.lit("}"))
    wrong = F.concat(F.lit('{"n": '), F.col("n").cast("string"), F.lit(', "d": "1"}'))
    told = packed.filter("role <> 'system'").select("batch", "n", wrong.alias("w"), entry.alias(
        "e"))
    both = told.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("n", "w", "e")),
                                                  asc=False).alias("x"))
    body = F.concat(
        F.array_join(F.transform("x", lambda s: s["w"]), ","), F.lit(","),
        F.array_join(F.transform("x", lambda s: s["e"]), ","))
    responses = both.select("batch", F.concat(
        F.lit('Verdicts: {"v": ['), body, F.lit("]} done")).alias("response"))
    return batches.match_by_echo(packed, responses).select(
        "conv_id", "turn", shown(batches.screen_flag(F.col("answer"))).alias("screen"))


def _sizes(rows: list[dict]) -> str:
    if any(r["role"] == "system" for r in rows):
        raise ValueError("this batch fails")
    return f"{len(rows)}:{sum(len(r['text']) for r in rows)}"


@query("score_batches", f"""
    WITH {_PACKED} SELECT batch, CASE WHEN count(*) FILTER (WHERE role = 'system') = 0 THEN
      count(*) || ':' || CAST(sum(length(text)) AS BIGINT) END AS response
    FROM packed GROUP BY 1""")
def score_batches(spark, sf):
    return batches.score_batches(_packed(spark, sf), _sizes, ["role", "text"], parallel=4).select("batch", "response")


def _letter_counts(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("e")), float(t.count(" ")), 1.0] for t in texts]


@query("embed_hash", """
    SELECT CAST(doc_id AS VARCHAR) AS id, length(t) AS n_chars,
      length(t) - length(replace(t, 'e', '')) AS n_e,
      length(t) - length(replace(t, ' ', '')) AS n_blank
    FROM (SELECT doc_id, CASE WHEN source = 'src0' THEN 'empty' ELSE
      regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS t FROM documents)""")
def embed_hash(spark, sf):
    docs = V.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("source") == "src0", F.lit(" ")).otherwise(F.col("text")).alias(
            "text"))
    out = batches.embed_column(docs, _letter_counts, "doc_id", "text", dim=4)
    return out.select("id", *[
        F.col("embedding")[i].cast("bigint").alias(name)
        for i, name in enumerate(["n_chars", "n_e", "n_blank"])])


# --- cascade and extraction ----------------------------------------------------------------


def _screen(rows: list[dict]) -> str:
    answers = [
        {"n": r["n"], "d": 1 if len(r["title"]) % 3 else 0}
        for r in rows if len(r["title"]) % 7
    ]
    return json.dumps({"v": answers})


def _confirm(rows: list[dict]) -> str:
    verdicts = [
        {"n": r["n"], "is_fmcg_deal": len(r["snippet"]) % 2 == 0, "deal_type": "Funding",
         "confidence": 0.9, "reasoning": "length"}
        for r in rows if len(r["snippet"]) % 11
    ]
    return "Here: " + json.dumps({"verdicts": verdicts})


@query("relevance_cascade", S.with_views("doc_articles_v", body=f"""
    SELECT id, pre AS pre_filtered, CASE WHEN NOT pre OR length(title) % 7 = 0 THEN
        'unanswered' WHEN length(title) % 3 <> 0 THEN 'yes' ELSE 'no' END AS screen,
      short AND length(snippet) % 11 <> 0 AS answered,
      short AND length(snippet) % 11 <> 0 AND length(snippet) % 2 = 0 AS is_deal
    FROM (SELECT *, pre AND (length(title) % 7 = 0 OR length(title) % 3 <> 0) AS short
      FROM (SELECT *, {_PASSES} AS pre FROM doc_articles_v))"""))
def relevance_cascade(spark, sf):
    flags, _ = cascade.relevance_cascade(
        V.doc_articles_v(spark, sf), _screen, _confirm, parallel=4, **V.PATTERNS)
    return flags.withColumn("screen", shown(F.col("screen")))


def _extract(rows: list[dict]) -> str:
    """A stand-in model: reads the prompt's title as '<buyer> <target words>'."""
    words = rows[0]["prompt"].split("\n", 1)[0].removeprefix("Title: ").split()
    return json.dumps({
        "acquirer": words[0] if words else "", "target": " ".join(words[1:4]),
        "deal_type": "M&A", "deal_value": f"{len(words) * 100:,}", "currency": "INR_CRORE",
        "stake_pct": None, "category": "Food", "region": "", "announced_date": "soon",
    })


@query("extract_deals", S.with_views("doc_articles_v", "verdicts_v", body="""
    SELECT id AS deal_id, coalesce(w[1], 'Undisclosed') AS acquirer,
      CASE WHEN len(w) < 2 THEN 'Undisclosed' ELSE array_to_string(w[2:4], ' ') END AS target,
      CASE WHEN len(w) > 0 THEN len(w) * 100.0::DOUBLE END AS deal_value, 'India' AS region,
      strftime(published_at, '%Y-%m-%d') AS announced
    FROM (SELECT id, published_at, list_filter(regexp_split_to_array(title, '\\s+'),
        lambda x: x <> '') AS w
      FROM doc_articles_v JOIN verdicts_v USING (id) WHERE is_deal)"""))
def extract_deals(spark, sf):
    verdicts = V.verdicts_v(spark, sf).select(
        "id", "is_deal", F.lit(None).cast("string").alias("verdict_type"),
        F.lit(0.8).alias("confidence"), F.lit("").alias("reasoning"))
    relevant = cascade.relevant_articles(V.doc_articles_v(spark, sf), verdicts)
    return cascade.extract_deals(relevant, verdicts, _extract, parallel=4).select(
        "deal_id", "acquirer", "target", "deal_value", "region",
        F.date_format("announced_date", "yyyy-MM-dd").alias("announced"))


# --- snapshots ----------------------------------------------------------------------------


def _snapshot_tables(spark, sf):
    deals, articles = V.stored_deals(spark, sf)
    sources = credibility.deal_sources(V.evidence_of(deals, articles))
    selected = cut_lineage(rank.rank_deals(V.scored(deals, sources)), "selected")
    membership = V.membership_of(articles)
    return {
        "deals": selected,
        "membership": membership,
        "clusters": membership.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")),
        "articles": articles,
        "funnel": q_deals.counted(deals, articles, selected),
    }


@query("snapshot_counts", S.with_views("selected_v", "evidence_v", body="""
    SELECT 'live' AS origin, (SELECT count(*) FROM selected_v) AS deals,
      (SELECT count(*) FROM evidence_v) AS membership,
      (SELECT count(DISTINCT deal_id) FROM evidence_v) AS clusters,
      (SELECT count(*) FROM evidence_v) AS articles, CAST(1 AS BIGINT) AS funnel"""))
def snapshot_counts(spark, sf):
    path = run_dir(spark, "snapshot")
    snapshot.write_snapshot(_snapshot_tables(spark, sf), path)
    loaded = snapshot.load_snapshot(spark, path, path)
    counts = diagnostics.stage_counts(**loaded.tables)
    return counts.agg(F.lit(loaded.source).alias("origin"), *[
        F.max(F.when(F.col("stage") == t, F.col("n"))).alias(t) for t in loaded.tables])


@query("snapshot_guard", S.with_views("selected_v", body="""
    SELECT true AS refused, count(*) AS kept, CAST(0 AS BIGINT) AS after_force
    FROM selected_v"""))
def snapshot_guard(spark, sf):
    path = run_dir(spark, "guard")
    # Three snapshots are written or refused; all deals are scored and ranked once.
    deals = cut_lineage(rank.rank_deals(V.deals_scored_v(spark, sf)))
    snapshot.write_snapshot({"deals": deals}, path)
    empty = {"deals": deals.filter("rank_pos < 0")}
    try:
        snapshot.write_snapshot(empty, path)
        refused = False
    except snapshot.EmptySnapshotError:
        refused = True
    kept = snapshot.read_snapshot(spark, path)["deals"].agg(F.count(F.lit(1)).alias("kept"))
    snapshot.write_snapshot(empty, path, force=True)
    after = snapshot.read_snapshot(spark, path)["deals"].agg(
        F.count(F.lit(1)).alias("after_force"))
    one = F.lit(1)
    return kept.withColumn("_one", one).join(after.withColumn("_one", one), "_one").select(
        F.lit(refused).alias("refused"), "kept", "after_force")


@query("snapshot_fallback", S.with_views("deals_v", body="""
    SELECT 'seed' AS origin, deal_type, count(*) AS deals FROM deals_v GROUP BY 2"""))
def snapshot_fallback(spark, sf):
    seed = run_dir(spark, "seed")
    snapshot.write_snapshot({"deals": V.deals_v(spark, sf)}, seed)
    loaded = snapshot.load_snapshot(spark, f"{seed}-never-written", seed)
    return loaded.tables["deals"].groupBy("deal_type").agg(
        F.count(F.lit(1)).alias("deals")).withColumn("origin", F.lit(loaded.source))


@query("audit_chain", S.with_views("evidence_v", body=f"""
    SELECT deal_id, deal_id AS cluster_id, article_id, url FROM evidence_v
    LEFT JOIN (SELECT {S.deal_key('page_id')} || '-' || page_id AS article_id, url FROM pages)
      USING (article_id)"""))
def audit_chain(spark, sf):
    urls = V.table(spark, sf, "pages").select(
        F.concat_ws("-", V.deal_id("page_id"), F.col("page_id").cast("string")).alias("id"), "url")
    return diagnostics.audit_chain(
        V.deals_v(spark, sf), V.deal_membership_v(spark, sf), urls)


# --- the whole run ------------------------------------------------------------------------


def _embed_words(texts: list[str]) -> list[list[float]]:
    """Deterministic bag-of-words embedder, 64 wide."""
    out = []
    for t in texts:
        vec = [0.0] * 64
        for word in t.lower().split():
            vec[sum(word.encode()) * 31 % 61] += 1.0
        vec[63] = 0.1
        out.append(vec)
    return out


def _write_prose(rows: list[dict]) -> str:
    facts = [json.loads(r["payload"]) for r in rows]
    return json.dumps({
        "tldr": [f"{len(facts)} deals, led by {facts[0]['target']}", " "],
        "items": [{"deal_id": f["deal_id"], "headline": f"{f['acquirer']} takes {f['target']}",
                   "summary": ""} for f in facts],
    })


def options(now: dt.datetime) -> digest_run.DigestOptions:
    return digest_run.DigestOptions(
        now=now, screen_fn=_screen, confirm_fn=_confirm, extract_fn=_extract,
        embed_fn=_embed_words, prose_fn=_write_prose, window_days=3650, per_feed_cap=None,
        embed_dim=64, cosine_threshold=0.97, parallel=4,
        patterns={"deal": r"\bthe\b", "signal": r"\bof\b", "noise": r"\bnever-there\b"},
    )


def whole_run(spark, sf):
    landed = q_ingest.landed_pages(spark, sf, "run")
    now = dt.datetime(2030, 1, 1, tzinfo=dt.timezone.utc)
    return digest_run.run_digest(spark, feeds.scan_feeds(spark, landed), options(now))


_BYTE_SUM = (
    "list_sum(list_transform(range(1, strlen(w) * 2, 2), "
    "lambda i: CAST('0x' || substr(hex(encode(w)), i, 2) AS INTEGER)))"
)
_STRIPPED = S.strip_html(S.strip_html("snippet"))
#: The whole run's stories in SQL: articles, both kinds of links, components, canonical articles.
_STORIES = [
    f"""arts AS (SELECT id, arg_min(trim(title), published_at) AS title, min(published_at) AS published_at,
      arg_min({_STRIPPED}, published_at) AS snippet, any_value(source) AS source,
      any_value({S.canonical_url('url')}) AS url FROM articles_v GROUP BY id)""",
    f"named AS (SELECT id, {S.norm_title('title')} AS norm FROM arts)",
    """wordlist AS (SELECT id, unnest(list_filter(regexp_split_to_array(
      lower(left(title || '. ' || snippet, 512)), '\\s+'), lambda x: x <> '')) AS w FROM arts)""",
    f"bins AS (SELECT id, {_BYTE_SUM} * 31 % 61 AS bin, count(*)::DOUBLE AS c FROM wordlist GROUP BY 1, 2)",
    "norms AS (SELECT id, sqrt(sum(c * c) + 0.01) AS norm FROM bins GROUP BY 1)",
    """near AS (SELECT x.id AS a, y.id AS b FROM bins x JOIN bins y ON x.bin = y.bin AND x.id < y.id
      JOIN norms n ON n.id = x.id JOIN norms m ON m.id = y.id
      GROUP BY x.id, y.id, n.norm, m.norm HAVING (sum(x.c * y.c) + 0.01) / (n.norm * m.norm) >= 0.97)""",
    f"""same_title AS (SELECT x.id AS a, y.id AS b FROM named x JOIN named y ON x.id < y.id
      WHERE {S.title_ratio('x.norm', 'y.norm')} >= {dims.TITLE_MATCH_RATIO})""",
    *S.components("SELECT id FROM arts", "SELECT a, b FROM near UNION ALL SELECT a, b FROM same_title"),
    "placed AS (SELECT arts.*, component FROM arts JOIN comp ON comp.node = arts.id)",
    "canon AS (SELECT component, arg_min(id, published_at) AS cluster_id FROM placed GROUP BY 1)",
]
#: From the relevant stories on: deal records, groups of one deal, evidence, scores, the top deals.
_RUN_DEALS = [
    "members AS (SELECT id AS article_id, cluster_id, source FROM placed JOIN canon USING (component))",
    r"""told AS (SELECT id, published_at, url, list_filter(regexp_split_to_array(title, '\s+'), lambda x: x <> '') AS w
      FROM placed JOIN canon ON id = cluster_id
      WHERE regexp_matches(title || ' ' || snippet, '(?i)\bthe\b') AND regexp_matches(title || ' ' || snippet, '(?i)\bof\b')
        AND (length(title) % 7 = 0 OR length(title) % 3 <> 0) AND length(snippet) % 11 <> 0 AND length(snippet) % 2 = 0)""",
    f"""good AS (SELECT id AS deal_id, id AS cluster_id, w[1] AS acquirer, array_to_string(w[2:4], ' ') AS target,
        'M&A' AS deal_type, len(w) * 100.0::DOUBLE AS deal_value, 'INR_CRORE' AS currency,
        NULL::DOUBLE AS stake_pct, published_at AS announced_date, url
      FROM told WHERE len(w) > 1 AND length(array_to_string(w[2:4], ' ')) > 1
        AND len({S.distinctive("array_to_string(w[2:4], ' ')")}) > 0)""",
    *q_deals._identity("SELECT * FROM good"),
    *S.components(q_deals._NODES, "SELECT a, b FROM pairs", "deal_"),
    """sized AS (SELECT good.*, coalesce(component, deal_id) AS grp, n AS size
      FROM good LEFT JOIN deal_comp ON node = deal_id
      JOIN (SELECT cluster_id, count(*) AS n FROM members GROUP BY 1) USING (cluster_id))""",
    """best AS (SELECT * FROM sized QUALIFY row_number() OVER (PARTITION BY grp ORDER BY size DESC, announced_date) = 1)""",
    """moved AS (SELECT DISTINCT m.article_id, m.source, best.deal_id FROM sized JOIN best USING (grp)
      JOIN members m ON m.cluster_id = sized.cluster_id)""",
    """rated AS (SELECT best.*, least(0.25::DOUBLE + least((n - 1) * 0.12::DOUBLE, 0.25::DOUBLE), 1.0::DOUBLE) AS credibility_score
      FROM best JOIN (SELECT deal_id, count(DISTINCT source) AS n FROM moved GROUP BY 1) USING (deal_id))""",
    f"""top AS (SELECT *, row_number() OVER (ORDER BY score DESC, announced_date) AS rank_pos FROM (
      SELECT *, {S.badge('credibility_score')} AS confidence, 0.35::DOUBLE * 0.9::DOUBLE + 0.3::DOUBLE * credibility_score
        + 0.2::DOUBLE * {S.recency('announced_date', '2030-01-01 00:00:00', 3650)} + 0.15::DOUBLE * {S.size_score()} AS score
      FROM rated) ORDER BY score DESC, announced_date LIMIT {dims.TOP_N})""",
]
_RUN_CATEGORY = S.lit("Food" if "Food" in dims.CATEGORIES else dims.CATEGORIES[-1])


@query("digest_end_to_end", S.with_views("articles_v", recursive=True, extra=[*_STORIES, *_RUN_DEALS], body=f"""
    SELECT {_RUN_CATEGORY} AS category, CAST(rank_pos AS INTEGER) AS item_no, deal_id,
      acquirer || ' takes ' || target AS headline, acquirer || {S.lit(dims.ACQUIRES)} || target || '.' AS summary,
      url AS primary_source_url, confidence AS badge FROM top"""))
def digest_end_to_end(spark, sf):
    run = whole_run(spark, sf)
    flat = digest.sections_flat(run.tables["sections"])
    return flat.select("category", "item_no", "deal_id", "headline", "summary",
                       "primary_source_url", "badge")


@query("digest_articles", S.with_views("articles_v", body=f"""
    SELECT id, any_value({S.canonical_url('url')}) AS url, min(feed_pos) AS feed_pos,
      any_value(CASE WHEN trim(title) = '' THEN NULL ELSE title END) AS title
    FROM articles_v GROUP BY id"""))
def digest_articles(spark, sf):
    """The articles of a whole run: landed, scanned, accepted, cleaned and de-duplicated."""
    articles = whole_run(spark, sf).tables["articles"]
    origin = V.articles_v(spark, sf).groupBy("id").agg(F.min("feed_pos").alias("feed_pos"))
    return articles.select("id", "url", "title").join(origin, "id")


@query("digest_story_membership", S.with_views("articles_v", recursive=True, extra=_STORIES, body="""
    SELECT id AS article_id, cluster_id FROM placed JOIN canon USING (component)"""))
def digest_story_membership(spark, sf):
    """The stories of a whole run: near embeddings or near titles, named by their first article."""
    return whole_run(spark, sf).tables["story_membership"].select("article_id", "cluster_id")


@query("digest_funnel", S.with_views("articles_v", recursive=True, extra=_STORIES, body=r"""
    SELECT (SELECT count(*) FROM articles_v) AS ingested, count(*) AS deduped,
      CAST(count_if(pre) AS BIGINT) AS pre_filtered, CAST(count_if(short AND said) AS BIGINT) AS classified,
      CAST(count_if(short AND NOT said) AS BIGINT) AS unanswered,
      CAST(count_if(short AND said AND length(snippet) % 2 = 0) AS BIGINT) AS relevant
    FROM (SELECT *, pre AND (length(title) % 7 = 0 OR length(title) % 3 <> 0) AS short,
        length(snippet) % 11 <> 0 AS said
      FROM (SELECT title, snippet, regexp_matches(title || ' ' || snippet, '(?i)\bthe\b')
          AND regexp_matches(title || ' ' || snippet, '(?i)\bof\b') AS pre
        FROM placed JOIN canon ON id = cluster_id))"""))
def digest_funnel(spark, sf):
    """The whole run's funnel and relevance statistics, up to the relevant articles."""
    run = whole_run(spark, sf)
    one = F.lit(1)
    stats = run.diagnostics["relevance"].select("pre_filtered", "classified", "unanswered", one.alias("_one"))
    return run.tables["funnel"].select("ingested", "deduped", "relevant", one.alias("_one")).join(
        stats, "_one").drop("_one")


@query("export_json_roundtrip", S.with_views("articles_v", recursive=True, extra=[*_STORIES, *_RUN_DEALS], body="""
    SELECT 'Deal digest' AS title, CAST(rank_pos AS INTEGER) AS rank_pos, top.deal_id, cluster_id, confidence,
      article_id AS id, arts.url FROM top JOIN moved USING (deal_id) JOIN arts ON arts.id = article_id"""))
def export_json_roundtrip(spark, sf):
    """The snapshot of a whole run, written as JSON and read back: deals with their evidence."""
    path = exports.export_path(run_dir(spark, "json"), F.lit(V.NOW), spark)
    with whole_run(spark, sf) as run:
        parts = digest_run.snapshot_export(run)
        exports.write_json(parts, path)
    back = {n: spark.read.schema(p.schema).json(f"{path}/{n}") for n, p in parts.items()}
    deals = back["digest"].select("title", F.explode("deals").alias("d")).select(
        "title", "d.rank_pos", "d.deal_id", "d.cluster_id", "d.confidence")
    members = back["members"].select("cluster_id", F.col("article_id").alias("id"))
    return deals.join(members, "cluster_id").join(
        back["articles"].select("id", "url"), "id", "left")


@query("refresh_run")
def refresh_run(spark, sf):
    """Two refreshes over landed feeds: the second one finds nothing new."""
    base = run_dir(spark, "refresh")
    landed = q_ingest.landed_pages(spark, sf, "refresh")
    now = V.table(spark, sf, "pages").agg(F.max("page_id")).first()[0]
    opts = options(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=now + 1))
    args = (spark, landed, f"{base}/items", f"{base}/checkpoint", f"{base}/live", opts)
    refresh.refresh(*args)
    return refresh.refresh(*args).tables["funnel"]


@query("deal_sources_flat", S.with_views("evidence_v", body="""
    SELECT deal_id, source, min(source_tier) AS tier FROM evidence_v GROUP BY 1, 2"""))
def deal_sources_flat(spark, sf):
    return credibility.deal_sources(V.evidence_v(spark, sf))


@query("rejected_deals", S.with_views("deals_v", body="""
    SELECT acquirer, deal_type_shown AS deal_type, count(*) AS n FROM (
      SELECT *, deal_type AS deal_type_shown FROM deals_v WHERE feed_pos % 11 IN (2, 9))
    GROUP BY 1, 2"""))
def rejected_deals(spark, sf):
    _, rejected = deal_ops.split_publishable(q_deals.coerced(spark, sf))
    return rejected.groupBy("acquirer", "deal_type").agg(F.count(F.lit(1)).alias("n"))
