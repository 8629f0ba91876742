"""Literal cases of the scalar rules and the small operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsfunnel import dims
from newsfunnel.functions import dates, model_json, money, text, urls, vectors
from newsfunnel.operators import (
    batches, calibrate, cascade, clean, credibility, deals, diagnostics, digest, ingest, rank,
)

from tests import brute

TS = dt.datetime(2024, 1, 1)

CONTROLS = [  # labelled headline pairs
    ("SAME", "Northwind buys oat drink label Millet Moon for Rs 310 crore",
     "Northwind Foods to take over Millet Moon in Rs 310 crore deal"),
    ("SAME", "Harrowby to pick up 26% stake in Hillside Spices",
     "Regulator clears Harrowby purchase of Hillside Spices shares"),
    ("DIFFERENT", "Harrowby picks up majority stake in Hillside Spices",
     "Ostwind picks up majority stake in Corvane"),
    ("DIFFERENT", "Brightbrook buys Tin Kettle Foods for Rs 640 crore",
     "Brightbrook buys Fern Valley Organics for Rs 75 crore"),
    ("DIFFERENT", "Northwind buys oat drink label Millet Moon for Rs 310 crore",
     "Lumenfold opens twelve shops on the coast"),
]


def apply(spark, values, build, kind="string"):
    """Results of a one-argument expression over literal values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(build(F.col("c"))).collect()]


def test_strip_html(spark):
    cases = {
        "<p>a&nbsp;&amp;<b>b</b></p>": "a & b",
        "<SCRIPT x>var t='<p>';</script >kept": "var t=' '; kept",
        "<script>one\ntwo</script>x<style>\n.a{}</style>y": "x y",
        "&amp;lt;b&amp;gt;": "<b>",
        "&lt;b&gt; survives": "<b> survives",
        "a\u00a0\u2003 b\ufeff": "a b",
        "&quot;q&quot; &#39;s&apos; &eacute;": "\"q\" 's' &eacute;",
        "": "",
    }
    assert apply(spark, cases, text.strip_html) == list(cases.values())


def test_canonicalize_url(spark):
    cases = {
        " HTTPS://WWW.Example.COM/a/b/?utm_source=x&b=2&a=1&a=0#top ":
            "https://example.com/a/b?a=1&a=0&b=2",
        "http://example.com": "http://example.com/",
        "http://example.com/?": "http://example.com/",
        "http://example.com///": "http://example.com/",
        "https://example.com:443/x?REF=1&Ncid=2&page=3": "https://example.com/x?page=3",
        "https://example.com:8443/x/": "https://example.com:8443/x",
        "https://u:p@www.example.com/x": "https://u:p@example.com/x",
        "https://news.google.com/rss?url=https%3A%2F%2Fwww.mint.com%2Fa%3Fgclid%3D1%26x%3D2&hl=en":
            "https://mint.com/a?x=2",
        "https://news.google.com/rss/articles/CBMi?oc=5":
            "https://news.google.com/rss/articles/CBMi?oc=5",
        "https://news.google.com/rss?url=nonsense&a=1":
            "https://news.google.com/rss?a=1&url=nonsense",
        "https://other.com/r?url=https%3A%2F%2Fa.com": "https://other.com/r?url=https%3A%2F%2Fa.com",
        " not a url ": "not a url",
        "https://example.com/a b?q=%zz": "https://example.com/a b?q=%zz",
    }
    assert apply(spark, cases, urls.canonicalize_url) == list(cases.values())


def test_article_id_and_source(spark):
    assert apply(spark, ["abc"], urls.article_id) == ["a9993e364706"]
    assert apply(spark, ["https://www.Mint.com/x", "nope"], urls.source_from_url) == [
        "mint.com", "Unknown"]


def test_search_url_encoding(spark):
    assert apply(spark, ["Procter & Gamble (P+G)!"], urls.encode_component) == [
        "Procter%20%26%20Gamble%20(P%2BG)!"]


def test_title_ratio_on_controls(spark):
    df = spark.createDataFrame(CONTROLS + [("", "", "!!"), ("", "abc", "")],
                               "truth string, a string, b string")
    got = [r[0] for r in df.select(text.token_sort_ratio(F.col("a"), F.col("b"))).collect()]
    want = [brute.title_ratio(a, b) for _, a, b in CONTROLS] + [100, 0]
    assert sorted(got) == sorted(want)


def test_distinctive_tokens(spark):
    got = apply(spark, ["Zolvia, BrightHull parent", "Beverages Major", "Quenta Cosmetics", "A 1",
                        "D'Éclats"], text.distinctive_tokens)
    assert got == [["zolvia", "brighthull"], [], ["quenta"], [], ["clats"]]


def test_legal_suffixes_can_be_made_generic(spark):
    df = spark.createDataFrame([("Ironvale LLC", "Mossgate LLC")], "a string, b string")
    shared = df.select(
        text.shares_distinctive_token(F.col("a"), F.col("b")),
        text.shares_distinctive_token(
            F.col("a"), F.col("b"), dims.GENERIC_TOKENS + dims.LEGAL_SUFFIXES)).first()
    assert tuple(shared) == (True, False)


def test_clean_number(spark):
    got = apply(spark, ["1,200", "12.5", " 7 ", "-3", "0", "n/a", "1e3", "NaN", "Infinity", "5d",
                        "", None], money.clean_number)
    assert got == [1200.0, 12.5, 7.0, None, None, None, 1000.0, None, None, None, None, None]


def test_values(spark):
    rows = [(2955.0, "INR_CRORE"), (8.0, "USD_MILLION"), (None, None), (1234567.8915, "INR"),
            (999.0, "USD"), (1000.0, "EUR"), (12.0, None), (8320000.0, "INR_CRORE")]
    df = spark.createDataFrame(rows, "v double, c string")
    v, c = F.col("v"), F.col("c")
    got = df.select(money.format_value(v, c), money.plausible_value(v, c),
                    money.size_score(v, c)).collect()
    assert [r[0] for r in got] == [
        "₹2,955 cr", "$8 mn", "Undisclosed", "₹12,34,567.892", "$999", "1,000 EUR", "12",
        "₹83,20,000 cr"]
    assert [r[1] for r in got] == [2955.0, 8.0, None, 1234567.8915, 999.0, None, None, None]
    assert [r[2] for r in got] == [0.85, 0.5, 0.5, 0.35, 0.35, 0.5, 0.5, 1.0]


def test_plain_number(spark):
    got = apply(spark, [100.0, 0.99, 131254290.00000001, 1e13, 1200.0, None], digest.plain_number,
                "double")
    assert got == ["100", "0.99", "131254290.00000001", "10000000000000", "1200", ""]


def test_dates(spark):
    got = apply(spark, ["Tue, 03 Oct 2023 10:20:30 GMT", "2023-10-03T10:20:30Z",
                        "3 Oct 2023 10:20:30 +0530", "soon"], dates.normalise_ts)
    assert got == ["2023-10-03T10:20:30.000Z", "2023-10-03T10:20:30.000Z",
                   "2023-10-03T04:50:30.000Z", "soon"]
    assert apply(spark, ["2024-02-03", "2024-13-01", "2024/02/03", None],
                 lambda c: F.date_format(dates.iso_date_or(c, F.lit(TS)), "yyyy-MM-dd")) == [
        "2024-02-03", "2024-01-01", "2024-01-01", "2024-01-01"]


def test_relative_age_and_recency(spark):
    now = dt.datetime(2024, 1, 10)
    gaps = [dt.timedelta(seconds=20), dt.timedelta(minutes=5), dt.timedelta(minutes=59, seconds=40),
            dt.timedelta(hours=5), dt.timedelta(hours=23, minutes=40), dt.timedelta(days=4)]
    got = apply(spark, [now - g for g in gaps],
                lambda c: dates.relative_age(c, F.lit(now)), "timestamp")
    assert got == ["just now", "5 min ago", "1 hour ago", "5 hours ago", "1 day ago", "4 days ago"]
    score = apply(spark, [now, now - dt.timedelta(days=45), now - dt.timedelta(days=99),
                          now + dt.timedelta(days=3), None],
                  lambda c: dates.recency_score(c, F.lit(now), 90), "timestamp")
    assert score == [1.0, 0.5, 0.0, 1.0, 0.5]


def test_model_json(spark):
    cases = ['{"is_fmcg_deal": true, "confidence": 0.8}',
             'Sure: {"is_fmcg_deal": "true", "confidence": "0.8"} ok',
             '{"is_fmcg_deal": 1, "confidence": 7, "deal_type": "Rumour"}', '{"is_fmcg_deal": tr']
    got = apply(spark, cases, lambda c: deals.coerce_verdict(model_json.parse_model_json(c)))
    assert [(g["is_deal"], g["confidence"], g["verdict_type"]) for g in got[:3]] == [
        (True, 0.8, None), (False, 0.5, None), (False, 0.5, None)]
    assert apply(spark, cases, lambda c: model_json.parse_model_json(c).isNull()) == [
        False, False, False, True]


def test_coerce_deals(spark):
    answers = [
        ("a", 'ok {"acquirer": " ", "target": "Corvane", "deal_value": 5, "currency": "EUR", '
              '"stake_pct": 140, "region": "", "announced_date": "2024-02-31x"} done'),
        ("b", '{"acquirer": "X", "target": "Y", "deal_type": "JV", "deal_value": "1,200", '
              '"currency": "INR_CRORE", "stake_pct": "51", "category": "Food"}'),
        ("c", '{"target": "cut o'), ("d", None),
    ]
    df = spark.createDataFrame(
        [(i, a, "Stake", 0.7, TS, n) for n, (i, a) in enumerate(answers)],
        "id string, answer string, verdict_type string, confidence double, "
        "published_at timestamp, feed_pos bigint")
    got = {r["deal_id"]: r for r in deals.coerce_deals(df).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a["acquirer"], a["deal_type"], a["deal_value"], a["currency"], a["stake_pct"],
            a["category"], a["region"], a["announced_date"]) == (
        "Undisclosed", "Stake", None, None, None, "Other", "India", TS)
    assert (b["deal_type"], b["deal_value"], b["currency"], b["stake_pct"], b["category"]) == (
        "JV", 1200.0, "INR_CRORE", 51.0, "Food")


@pytest.mark.parametrize("tier,outlets,score,badge", [
    (1, 1, 0.75, "High"), (1, 3, 0.99, "High"), (1, 4, 1.0, "High"), (1, 17, 1.0, "High"),
    (2, 1, 0.5, "Med"), (2, 3, 0.74, "Med"), (2, 4, 0.75, "High"),
    (3, 1, 0.25, "Low"), (3, 3, 0.49, "Med"), (3, 9, 0.5, "Med"),
])
def test_credibility_table(spark, tier, outlets, score, badge):
    sources = spark.createDataFrame(
        [("d", f"s{i}", tier if i == 0 else 3) for i in range(outlets)],
        "deal_id string, source string, tier int")
    row = credibility.apply_credibility(
        spark.createDataFrame([("d",)], "deal_id string"), sources).first()
    assert (round(row["credibility_score"], 6), row["confidence"]) == (score, badge)


def test_deal_without_evidence_scores_lowest(spark):
    none = spark.createDataFrame([], "deal_id string, source string, tier int")
    row = credibility.apply_credibility(
        spark.createDataFrame([("d",)], "deal_id string"), none).first()
    assert (row["credibility_score"], row["n_sources"], row["confidence"]) == (0.25, 0, "Low")


def test_one_publisher_votes_once(spark):
    evidence = spark.createDataFrame(
        [("d", f"a{i}", "Mint", 1) for i in range(3)] + [("d", "b", "Blog", 3)],
        "deal_id string, article_id string, source string, source_tier int")
    assert credibility.deal_sources(evidence).count() == 2


def test_pre_filter_vocabulary(spark):
    cases = {
        "FMCG firm acquires stake in Hillside Spices": True,
        "Buys 100% stake in Oat Drift maker, says packaged food firm": True,
        "Acme Fund Purchases 12,045 Shares of Northwind Consumer Company": False,
        "Northwind stake lifted by Acme Fund": False,
        "Home health firm acquires personal care agency": False,
        "FMCG firm opens a plant": False,
        "Kitchen startup raises money": True,  # recall by design: 'itc' inside 'kitchen'
    }
    got = apply(spark, cases, lambda c: cascade.passes_pre_filter(c, F.lit("")))
    assert got == list(cases.values())


def test_publishable(spark):
    got = apply(spark, ["Undisclosed", "Beverages Major", "X", "Varun Beverages", "Corvane"],
                deals.is_publishable)
    assert got == [False, False, False, True, True]


def test_resolve_source(spark):
    df = spark.createDataFrame(
        [(1, "A - b - Mint ", None, "f"), (2, "A - Mint", "Blog", "f"), (3, "A", None, "f"),
         (4, "A - Mint", "", "f")], "i int, title string, source string, feed string")
    got = {r["i"]: (r["title"], r["source"]) for r in ingest.resolve_source(df).collect()}
    assert got == {1: ("A - b", "Mint"), 2: ("A", "Blog"), 3: ("A", "f"), 4: ("A", "")}


def test_blocklist_matches_raw_and_unified(spark):
    df = spark.createDataFrame([("www.MarketBeat ",), ("ET Bureau",), ("Mint",)], "source string")
    blocked = dims.blocklist_dim(spark, ["marketbeat", "the economic times"])
    out = ingest.drop_blocked(df, blocked, dims.alias_dim(spark))
    assert [r["source"] for r in out.collect()] == ["Mint"]


def test_accept_and_clean(spark):
    rows = [
        ("f", 1, "Deal one - ET Bureau", "https://a.com/x?utm_id=1", "2024-01-05T00:00:00Z"),
        ("f", 2, "Deal one again", "https://www.a.com/x", "Fri, 05 Jan 2024 00:00:00 GMT"),
        ("f", 3, "Old", "https://a.com/old", "2020-01-05T00:00:00Z"),
        ("f", 4, "Noise - MarketBeat", "https://a.com/n", "2024-01-05T00:00:00Z"),
        ("f", 5, None, "https://a.com/t", "2024-01-05T00:00:00Z"),
        ("f", 6, "Capped", "https://a.com/c", "2024-01-06T00:00:00Z"),
    ]
    items = spark.createDataFrame(
        rows, "feed string, feed_pos bigint, title string, link string, pubDate string"
    ).withColumns({c: F.lit(None).cast("string") for c in (
        "isoDate", "contentSnippet", "content", "source")})
    aliases = dims.alias_dim(spark)
    raw = ingest.accept_items(items, F.lit(dt.datetime(2024, 1, 10)), 30,
                              dims.blocklist_dim(spark), aliases, 2)
    assert {r["feed_pos"] for r in raw.collect()} == {1, 2}
    cleaned = clean.clean_articles(raw, aliases, dims.tier_dim(spark))
    got = clean.dedupe_by_url(cleaned).collect()
    assert [(r["url"], r["source"], r["source_tier"]) for r in got] == [
        ("https://a.com/x", "The Economic Times", 1)]


def test_query_grid_defaults(spark):
    terms = dims.WATCHLIST + dims.CATEGORY_TERMS
    df = spark.createDataFrame(list(enumerate(terms)), "term_pos bigint, term string")
    grid = ingest.query_grid(df)
    assert grid.count() == 86 and ingest.query_grid(df, limit=10_000).count() == 258
    first = grid.orderBy("grid_pos").first()
    assert first["name"] == "HUL acquires"
    assert first["url"].startswith("https://news.google.com/rss/search?q=HUL%20acquires&hl=en-IN")


def test_rank_and_groups(spark):
    rows = [(f"d{i:02d}", "Food" if i % 2 else "Beverage", 1.0 - (i // 2) / 100, i)
            for i in range(30)]
    df = spark.createDataFrame(rows, "deal_id string, category string, score double, feed_pos bigint")
    top = rank.rank_deals(df)
    assert [r["deal_id"] for r in top.orderBy("rank_pos").collect()] == [
        f"d{i:02d}" for i in range(12)]
    grouped = rank.group_by_category(top, dims.category_dim(spark))
    assert [(r["category"], r["item_pos"]) for r in grouped.orderBy(
        "category_pos", "item_pos").collect()] == [
        (c, i) for c in ("Food", "Beverage") for i in range(1, 7)]


def test_sort_keeps_unknown_values_last(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5.0, "USD_MILLION"), (3, 500.0, "INR_CRORE")],
                               "rank_pos int, deal_value double, currency string")
    for direction, want in (("asc", [2, 3, 1]), ("desc", [3, 2, 1])):
        out = rank.sort_table(df, "value", direction).orderBy("row_pos")
        assert [r["rank_pos"] for r in out.collect()] == want


def test_tldr_and_empty_digest(spark):
    df = spark.createDataFrame([(0, ["x"]), (2, [" a ", " "]), (2, []), (2, None)],
                               "n bigint, b array<string>")
    got = [r[0] for r in df.select(digest.tldr(F.col("n"), F.col("b"))).collect()]
    assert got == [["No qualifying FMCG deals in this window."], ["a"],
                   ["2 FMCG deals tracked this period."], ["2 FMCG deals tracked this period."]]


def test_control_separation(spark):
    ddl = "truth string, sim double"
    apart = calibrate.control_separation(spark.createDataFrame(
        [("SAME", 0.9), ("SAME", 0.8), ("DIFFERENT", 0.6), ("DIFFERENT", 0.2)], ddl)).first()
    assert (apart["verdict"], round(apart["width"], 6), round(apart["midpoint"], 6)) == (
        "SEPARABLE", 0.2, 0.7)
    mixed = calibrate.control_separation(spark.createDataFrame(
        [("SAME", 0.5), ("DIFFERENT", 0.667)], ddl)).first()
    assert (mixed["verdict"], round(mixed["width"], 6), mixed["midpoint"]) == (
        "OVERLAP", 0.167, None)


def test_funnel_of_nothing(spark):
    counts = spark.createDataFrame([], "stage string, n bigint")
    row = diagnostics.funnel(counts).first()
    assert tuple(row) == (0, 0, 0, 0, 0.0)
    assert {r["bar_pct"] for r in diagnostics.funnel_bars(diagnostics.funnel(counts)).collect()} == {
        1.0}


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 1.0])],
                               "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0.0 and abs(got[1] - 1) < 1e-12
    bad = spark.createDataFrame([([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="vector length mismatch"):
        bad.select(vectors.cosine(F.col("a"), F.col("b"))).collect()


def test_fatal_scoring_error_fails_the_job(spark):
    packed = batches.pack_batches(spark.range(5).withColumn("t", F.lit("x")), 2, [F.asc("id")])

    def fatal(rows):
        raise batches.FatalScoringError("quota")

    def flaky(rows):
        if rows[0]["n"] == 1 and len(rows) == 1:
            raise ValueError("one bad batch")
        return str(len(rows))

    with pytest.raises(Exception, match="quota"):
        batches.score_batches(packed, fatal, ["t"]).collect()
    got = {r["batch"]: r["response"] for r in batches.score_batches(packed, flaky, ["t"]).collect()}
    assert got == {0: "2", 1: "2", 2: None}


def test_embedder_contract(spark):
    df = spark.createDataFrame([("a", " "), ("b", None), ("c", "x")], "id string, text string")
    seen = batches.embed_column(df, lambda ts: [[float(t == "empty")] for t in ts], dim=1)
    assert {r["id"]: r["embedding"] for r in seen.collect()} == {"a": [1.0], "b": [1.0], "c": [0.0]}
    with pytest.raises(Exception, match="vectors must be 3 wide"):
        batches.embed_column(df, lambda ts: [[0.0] for _ in ts], dim=3).collect()
    with pytest.raises(Exception, match="got 0 vectors"):
        batches.embed_column(df, lambda ts: [], dim=1).collect()


def test_echo_matching_without_answers(spark):
    packed = batches.pack_batches(spark.range(3), 3, [F.asc("id")])
    responses = spark.createDataFrame(
        [(0, '{"v": [{"n": 2, "d": 0}, {"n": 2, "d": true}, {"n": 9, "d": 1}, {"d": 1}, '
             '{"n": "1", "d": 1}, {"n": 3, "d": "1"}]}')], "batch bigint, response string")
    out = batches.match_by_echo(packed, responses).select(
        "n", batches.screen_flag(F.col("answer")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in out} == {1: None, 2: True, 3: False}


def test_runs_of_white_space_become_one_space(spark):
    texts = ["a b", "a  b", "a\tb", " \n a   b　", "a ﻿ b c ", "", "   ", "a<br> <br>b &nbsp; c"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select(text.strip_html(F.col("s")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["a b", "a b", "a b", "a b", "a b c", "", "", "a b c"]


def test_texts_are_cleaned_after_copies_have_gone(spark):
    """Both copies of a page are told apart by their URL; only one of them has its texts cleaned."""
    rows = [("https://x.com/p?utm_source=a", "<b>T</b>", "S &amp; s", "X", 1), ("https://x.com/p", "<b>T</b>", "S &amp; s", "X", 2)]
    raw = spark.createDataFrame(rows, "url string, title string, snippet string, source string, feed_pos long").withColumn(
        "published_at", F.lit("2024-01-01").cast("timestamp"))
    told = clean.dedupe_by_url(clean.identify_articles(raw, dims.alias_dim(spark), dims.tier_dim(spark)))
    assert [(r["title"], r["feed_pos"]) for r in told.collect()] == [("<b>T</b>", 1)]
    assert [(r["title"], r["snippet"]) for r in clean.plain_texts(told).collect()] == [("T", "S & s")]
