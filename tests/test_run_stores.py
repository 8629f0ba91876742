"""Stage store, ordinals, survivors, ledger, vectors, item store, retention."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from newsfunnel.functions import dates
from newsfunnel.operators import batches, clusters, components, merge, numbering, titles
from newsfunnel.session import (
    SHUFFLE_SETTING, StageStore, cut_lineage, drop_path, path_exists, run_dir, shared_dir, stage_store,
)
from newsfunnel.sources import feeds, snapshot
from newsfunnel.streaming import refresh

from checks import q_ingest, q_run, views as V
from tests.test_plans import plan


def test_a_store_is_deleted_with_its_last_holder(spark):
    store = StageStore(spark)
    with stage_store(store):
        table = cut_lineage(spark.range(5))
        inner = run_dir(spark, "x")
    assert inner.startswith(store.path) and not run_dir(spark, "x").startswith(store.path)
    store.hold()
    store.release()
    assert table.count() == 5
    store.release()
    assert not path_exists(spark, store.path)
    with pytest.raises(RuntimeError):
        store.hold()
    with pytest.raises(ValueError):
        drop_path(spark, "/somewhere/else")


def test_a_closed_run_leaves_nothing(spark, sf):
    with q_run.whole_run(spark, sf) as run:
        folder = run.stages.path
        assert run.tables["deals"].count() > 0 and path_exists(spark, folder)
        assert len(os.listdir(folder.removeprefix("file:"))) < 80  # superseded component rounds are gone
        scoring = {r["stage"]: r for r in run.diagnostics["scoring"].collect()}
        assert set(scoring) == {"screen", "confirm", "extract"} and not any(r["failed"] for r in scoring.values())
        assert {r["error"] for r in run.diagnostics["failures"].collect()} == {"no items"}  # the grid's feeds are silent
    assert not path_exists(spark, folder)


def test_a_failing_run_leaves_nothing(spark, sf):
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    opts = q_run.options(dt.datetime(2030, 1, 1))

    def fatal(rows):
        raise batches.FatalScoringError("no quota")

    opts.screen_fn = fatal
    from newsfunnel.plans.digest_run import run_digest

    items = feeds.scan_feeds(spark, q_ingest.landed_pages(spark, sf, "fatal"))
    with pytest.raises(Exception, match="no quota"):
        run_digest(spark, items, opts)
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert not [n for n in left if n.startswith("run-")]


def test_wide_rows_are_numbered_without_being_sorted(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.repeat(F.lit("x"), 50).alias("wide")).repartition(5)
    numbered = numbering.with_ordinal_joined(df, [F.desc("k")])
    assert sorted((r["k"], r["ordinal"]) for r in numbered.collect()) == [(k, 999 - k) for k in range(1000)]
    assert "rangepartitioning" not in plan(numbered).lower()
    total, rows = numbering.running_total(df, [F.asc("k")], "k", "before")
    assert rows == 1000 and all(r["before"] == r["k"] * (r["k"] - 1) // 2 for r in total.collect())


def test_scanned_items_are_never_sorted(spark, sf):
    text = plan(feeds.scan_feeds(spark, q_ingest.landed_pages(spark, sf, "plan")))
    items = text.split("BroadcastExchange")[0]  # what follows numbers the splits, one narrow row each
    assert "FileScan" in items and "Sort" not in items and " Exchange " not in items


def test_components_hash_whole_numbers(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y"), ("z", "z")], "a string, b string")
    got = {tuple(r) for r in components.connected_components(edges).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    numbers = spark.createDataFrame([(2, 1), (3, 2), (9, 8)], "a long, b long")
    text = plan(components._small_star(components._large_star(numbers.toDF("u", "v"))))
    assert "SortAggregate" not in text
    assert {tuple(r) for r in components.connected_components(numbers).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert components.connected_components(numbers.limit(0)).count() == 0


def test_survivors_are_found_on_narrow_rows(spark, sf):
    text = plan(clusters.pick_canonical(V.doc_articles_v(spark, sf).withColumn("c", F.col("feed_pos") % 7), "c"))
    assert "SortAggregate" not in text and "WindowGroupLimit" in text
    deals = V.deals_v(spark, sf)
    merged, _ = merge.merge_deals(deals, merge.same_deal_links(deals), *_stories(spark, deals))
    assert "SortAggregate" not in plan(merged)


def _stories(spark, deals):
    own = deals.select(F.col("deal_id").alias("article_id"), "cluster_id").distinct()
    return own, own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def test_the_ledger_keeps_answers_and_asks_again_what_failed(spark, tmp_path):
    calls, ledger = str(tmp_path / "calls"), str(tmp_path / "ledger")
    os.mkdir(calls)

    def scorer(fails):
        def score(rows):
            name = "-".join(str(r["t"]) for r in rows)
            with open(f"{calls}/{name}", "a") as f:
                f.write("x")
            if fails and rows[0]["t"] == 2:
                raise ValueError("busy")
            return name
        return score

    packed = spark.range(6).select((F.col("id") / 2).cast("long").alias("batch"), (F.col("id") % 2 + 1).cast("int").alias("n"),
                                   F.col("id").alias("t"))
    first = batches.score_batches(packed, scorer(True), ["t"], ledger=ledger, scorer="s").collect()
    assert {r["batch"]: (r["response"], r["error"]) for r in first} == {
        0: ("0-1", None), 1: (None, "ValueError: busy"), 2: ("4-5", None)}
    again = batches.score_batches(packed, scorer(False), ["t"], ledger=ledger, scorer="s")
    assert {r["batch"]: (r["response"], r["error"]) for r in again.collect()} == {
        0: ("0-1", None), 1: ("2-3", None), 2: ("4-5", None)}
    assert {n: os.path.getsize(f"{calls}/{n}") for n in os.listdir(calls)} == {"0-1": 1, "2-3": 2, "4-5": 1}
    counts = batches.failed_batches("s", spark.createDataFrame(first)).first()
    assert (counts["batches"], counts["failed"], counts["error"]) == (3, 1, "ValueError: busy")


def test_vectors_are_kept_by_text(spark, tmp_path):
    store, sent = str(tmp_path / "vectors"), str(tmp_path / "sent")

    def embed(texts):
        with open(sent, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([("1", "aa"), ("2", "aa"), ("3", " "), ("4", None)], "id string, text string")
    first = batches.embed_column(rows, embed, dim=1, store=store)
    assert {r["id"]: r["embedding"] for r in first.collect()} == {"1": [2.0], "2": [2.0], "3": [5.0], "4": [5.0]}
    more = rows.unionByName(spark.createDataFrame([("5", "bbb")], rows.schema))
    again = batches.embed_column(more, embed, dim=1, store=store)
    assert {r["id"]: r["embedding"][0] for r in again.collect()} == {"1": 2.0, "2": 2.0, "3": 5.0, "4": 5.0, "5": 3.0}
    assert sorted(open(sent).read().split()) == ["aa", "bbb", "empty", "empty"]


def test_a_refresh_reads_only_the_days_of_its_window(spark, sf, tmp_path):
    (tmp_path / "landing").mkdir()
    args = (spark, str(tmp_path / "landing"), str(tmp_path / "store"), str(tmp_path / "checkpoint"), str(tmp_path / "live"))
    opts = q_run.options(dt.datetime(2024, 3, 10))
    run = refresh.refresh(*args, opts)  # nothing has ever landed
    assert run.tables["funnel"].first()["ingested"] == 0 and run.tables["deals"].count() == 0
    items = "".join(
        f"<item><title>The sale of {d}</title><link>http://x.com/{i}</link><pubDate>{d}</pubDate></item>\n"
        for i, d in enumerate(["2024-03-05T10:00Z", "Mar 9, 2024 10:00:00", "2023/01/05", "soon"]))
    (tmp_path / "landing" / "one.xml").write_text(f"<rss><channel>\n{items}</channel></rss>")
    run = refresh.refresh(*args, opts)
    assert run.tables["funnel"].first()["ingested"] == 2
    stored = refresh.stored_items(spark, args[2])
    assert {str(r["day"]) for r in stored.select("day").collect()} == {"2024-03-05", "2024-03-09", "2023-01-05", "None"}
    text = plan(refresh.in_window(stored, refresh.preset(opts)))
    assert "PartitionFilters: [isnotnull(day" in text and "(day#" in text
    assert run.diagnostics["scoring"].count() == 3 and run.diagnostics["failures"].filter("feed = 'one'").count() == 0


def test_old_snapshots_go_and_open_readers_go_on(spark, tmp_path):
    path = str(tmp_path / "live")
    deals = spark.range(3).toDF("deal_id")
    versions = [snapshot.write_snapshot({"deals": deals}, path) for _ in range(3)]
    reader = snapshot.read_snapshot(spark, path)["deals"]
    versions.append(snapshot.write_snapshot({"deals": deals.limit(2)}, path, keep=2))
    assert reader.count() == 3 and snapshot.read_snapshot(spark, path)["deals"].count() == 2
    assert [v for _, v in snapshot.manifest(spark, path)] == versions[::-1]
    assert [path_exists(spark, f"{path}/{v}") for v in versions] == [False, False, True, True]
    with pytest.raises(ValueError):
        snapshot.write_snapshot({"deals": deals}, path, keep=0)


MORE_DATES = {
    "2024-03-05T10:00Z": "2024-03-05T10:00:00.000Z",
    "2024-03-05T10:00+02:00": "2024-03-05T08:00:00.000Z",
    "2024-03-05 10:00": "2024-03-05T10:00:00.000Z",
    "Mar 5, 2024 10:00:00": "2024-03-05T10:00:00.000Z",
    "March 5, 2024": "2024-03-05T00:00:00.000Z",
    "2024/03/05": "2024-03-05T00:00:00.000Z",
    "2024/3/5 10:00": "2024-03-05T10:00:00.000Z",
    "3/5/2024 10:00:00 PM": "2024-03-05T22:00:00.000Z",
    "Tue Mar 05 2024 10:00:00 GMT+0000": "2024-03-05T10:00:00.000Z",
    "Tue Mar 05 2024 10:00:00 GMT+0100 (Central European Standard Time)": "2024-03-05T09:00:00.000Z",
    "Tue, 05 Mar 2024 10:00:00 +01:00": "2024-03-05T09:00:00.000Z",
    "March": None, "2024/13/05": None, "5, 2024": None,
}


def test_more_spellings_of_dates(spark):
    df = spark.createDataFrame([(k,) for k in MORE_DATES], "c string")
    shown = F.date_format(dates.parse_feed_date(F.col("c")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    assert {r["c"]: r["d"] for r in df.select("c", shown.alias("d")).collect()} == MORE_DATES


def test_a_snapshot_computes_its_deals_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    deals = spark.range(0, 5, 1, 1).mapInPandas(rows, "id long")
    snapshot.write_snapshot({"funnel": spark.range(1), "deals": deals}, str(tmp_path / "s"))
    assert seen.value == 5
    with pytest.raises(snapshot.EmptySnapshotError):
        snapshot.write_snapshot({"deals": spark.range(0)}, str(tmp_path / "s"))
    assert len(os.listdir(tmp_path / "s")) == 2  # the version and its pointer; nothing of the refused one


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """Each stage's shuffles go when it is stored, not when the driver collects garbage."""
    before = shuffle_files(spark)
    stored = cut_lineage(spark.range(50_000).groupBy(F.xxhash64("id").alias("x")).count().repartition(3, "x"))
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert stored.count() == 50_000
    assert spark.conf.get(SHUFFLE_SETTING, None) is None


def test_large_tables_of_a_search_go_when_the_next_is_stored(spark):
    """Of claims, grams, rounds and their like nothing stays but what the results read."""
    store = StageStore(spark)
    with stage_store(store):
        deals = spark.createDataFrame(
            [(f"d{i}", "M&A", "Marico", f"Zolvia {i // 2}", 5.0, "INR", None, dt.datetime(2024, 1, 1)) for i in range(20)],
            "deal_id string, deal_type string, acquirer string, target string, deal_value double, currency string, "
            "stake_pct double, announced_date timestamp")
        links = merge.same_deal_links(deals)
        assert {k.split("-")[0] for k in os.listdir(store.path.removeprefix("file:"))} == {"links"}
        found = components.connected_components(links)
        assert {k.split("-")[0] for k in os.listdir(store.path.removeprefix("file:"))} == {"links", "names", "edges"}
        titles_ = spark.createDataFrame([(f"t{i}", f"one long title about a deal of number {i % 7}{i % 7}") for i in range(30)], "id string, title string")
        edges = titles.title_links(titles_)
        kept = {k.split("-")[0] for k in os.listdir(store.path.removeprefix("file:"))}
        assert kept == {"links", "names", "edges", "starred", "rest", "copies"}
    assert {r["component"] for r in found.collect()} and edges.count() >= 23
    store.release()
