"""Feeds, exports, snapshots, refresh and the whole run."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from newsfunnel import dims
from newsfunnel.operators import digest
from newsfunnel.session import cut_lineage, run_dir, shared_dir
from newsfunnel.sources import exports, feeds, snapshot
from newsfunnel.streaming import refresh

from checks import q_ingest, q_run, views as V

ITEM = """<?xml version="1.0"?><rss><channel><title>feed</title>
<item><title>A buys B - Mint</title><link>https://a.com/1</link>
<pubDate>Fri, 05 Jan 2024 00:00:00 GMT</pubDate><source url="https://mint.com">Mint</source>
<description>&lt;p&gt;text&lt;/p&gt;</description></item>
<item><title>C buys D</title><link>https://a.com/2</link></item></channel></rss>"""


def test_scan_reports_broken_feeds_and_keeps_the_rest(spark, tmp_path):
    (tmp_path / "good.xml").write_text(ITEM)
    (tmp_path / "broken.xml").write_text("<rss><channel><item><title>cut")
    scan = feeds.scan_feeds(spark, str(tmp_path))
    rows = {r["title"]: r for r in feeds.good_items(scan).collect()}
    assert set(rows) == {"A buys B - Mint", "C buys D"}
    first = rows["A buys B - Mint"]
    assert (first["feed"], first["source"], first["contentSnippet"]) == ("good", "Mint", "text")
    assert rows["C buys D"]["source"] is None
    expected = spark.createDataFrame([("good",), ("broken",), ("silent",)], "feed string")
    got = {r["feed"]: r["error"] for r in feeds.feed_failures(scan, expected).collect()}
    assert got == {"broken": "unreadable items: 1", "silent": "no items"}


def test_csv_matches_the_documented_form(spark, tmp_path):
    row = ["Harrowby", 'Zolvia, "BrightHull"', "M&A", "₹321 cr", "321", "INR_CRORE", "", "Personal care",
           "India", "2026-05-07", "High", "Mint; Inc42", 2, "1", "https://a.com/x"]
    ddl = ", ".join(f"`{c}` {'bigint' if c == 'Source count' else 'string'}"
                    for c in dims.EXPORT_COLUMNS)
    df = spark.createDataFrame([tuple(row)], ddl).coalesce(1)
    exports.write_csv(df, str(tmp_path / "out"))
    part = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv")
    lines = part.read_text().splitlines()
    assert lines[0] == ",".join(dims.EXPORT_COLUMNS)
    assert lines[1] == ('Harrowby,"Zolvia, ""BrightHull""",M&A,₹321 cr,321,INR_CRORE,,Personal care,'
                        "India,2026-05-07,High,Mint; Inc42,2,1,https://a.com/x")
    assert exports.export_path("/x/", F.lit(V.NOW), spark) == "/x/deals-2001-08-02"


def test_snapshot_guard_and_fallback(spark, tmp_path):
    deals = spark.createDataFrame([("d", 1)], "deal_id string, rank_pos int")
    live, seed = str(tmp_path / "live"), str(tmp_path / "seed")
    snapshot.write_snapshot({"deals": deals}, seed)
    assert snapshot.load_snapshot(spark, live, seed).source == "seed"
    assert snapshot.load_snapshot(spark, None, seed).source == "seed"
    snapshot.write_snapshot({"deals": deals.limit(0)}, live)  # nothing to lose yet
    snapshot.write_snapshot({"deals": deals}, live)
    assert snapshot.load_snapshot(spark, live, seed).source == "live"
    with pytest.raises(snapshot.EmptySnapshotError):
        snapshot.write_snapshot({"deals": deals.limit(0)}, live)
    assert snapshot.read_snapshot(spark, live)["deals"].count() == 1
    snapshot.write_snapshot({"deals": deals.limit(0)}, live, force=True)
    assert snapshot.read_snapshot(spark, live)["deals"].count() == 0


def test_lineage_is_cut_in_the_shared_folder(spark):
    folder = shared_dir(spark)
    stage = cut_lineage(spark.range(3))
    assert stage.count() == 3
    assert all(folder in f for f in stage.inputFiles())
    assert run_dir(spark, "x").startswith(folder)


def test_new_files_are_landed_once(spark, tmp_path):
    landing, store = tmp_path / "landing", str(tmp_path / "items")
    landing.mkdir()
    (landing / "one.xml").write_text(ITEM)
    args = (spark, str(landing), store, str(tmp_path / "checkpoint"))
    refresh.land_new_items(*args)
    refresh.land_new_items(*args)
    assert spark.read.parquet(store).count() == 2
    (landing / "two.xml").write_text(ITEM)
    refresh.land_new_items(*args)
    rows = spark.read.parquet(store).collect()
    assert len(rows) == 4 and len({r["feed_pos"] for r in rows}) == 4
    late = [r["feed_pos"] for r in rows if r["feed"] == "two"]
    assert min(late) > max(r["feed_pos"] for r in rows if r["feed"] == "one")


def test_refresh_uses_the_preset():
    opts = refresh.preset(q_run.options(dt.datetime(2024, 1, 1)))
    assert (opts.window_days, opts.per_feed_cap) == (21, 10)


def test_whole_run_keeps_its_invariants(spark, sf):
    run = q_run.whole_run(spark, sf)
    t = run.tables
    funnel = t["funnel"].first()
    assert funnel["ingested"] == 2 * V.table(spark, sf, "pages").count()
    assert funnel["ingested"] >= funnel["deduped"] >= funnel["relevant"] > 0
    deals = t["deals"].collect()
    assert 0 < len(deals) == funnel["selected"] <= dims.TOP_N
    for d in deals:
        assert (d["currency"] is None) == (d["deal_value"] is None)
        assert d["deal_id"] == d["cluster_id"]
    members = {}
    for r in t["membership"].collect():
        members.setdefault(r["cluster_id"], []).append(r["article_id"])
    known = {r["id"]: r["url"] for r in t["articles"].collect()}
    urls = {r["deal_id"]: r["primary_source_url"]
            for r in digest.sections_flat(t["sections"]).collect()}
    assert set(urls) == {d["deal_id"] for d in deals}
    for d in deals:  # deal -> cluster -> every member -> url
        assert d["deal_id"] in members[d["cluster_id"]]
        assert all(m in known for m in members[d["cluster_id"]])
        assert urls[d["deal_id"]] == known[d["deal_id"]]
        assert d["n_sources"] == len(d["sources"])
    header = t["header"].first()
    assert f"Method: {funnel['ingested']} articles" in header["methodology"]
    assert header["tldr"][0].startswith(f"{len(deals)} deals, led by")
    stats = run.diagnostics["relevance"].first()
    assert stats["input"] == funnel["deduped"] and stats["relevant"] == funnel["relevant"]
    clusters = t["story_membership"].select("cluster_id").distinct().count()
    assert clusters == funnel["deduped"]


def test_empty_run_is_a_valid_result(spark, sf):
    landed = q_ingest.landed_pages(spark, sf, "empty")
    opts = q_run.options(dt.datetime(2044, 1, 1))  # the window holds nothing
    from newsfunnel.plans.digest_run import run_digest

    run = run_digest(spark, feeds.scan_feeds(spark, landed), opts)
    assert tuple(run.tables["funnel"].first())[:4] == (0, 0, 0, 0)
    assert run.tables["header"].first()["tldr"] == ["No qualifying FMCG deals in this window."]
    assert run.tables["sections"].count() == 0


def test_no_local_checkpoint_in_the_code():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder in ("newsfunnel", "checks"):
        for base, _, files in os.walk(os.path.join(root, folder)):
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(base, f)) as handle:
                        code = handle.read()
                    assert "localCheckpoint" not in code and "crossJoin" not in code
