"""Physical plans: what must and must not be in them."""

import datetime as dt

from pyspark.sql import functions as F

from newsfunnel import dims
from newsfunnel.operators import clean, ingest, merge, rank, titles
from newsfunnel.session import map_batches

from checks import q_deals, views as V


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cap_uses_a_group_limit_before_the_shuffle(spark, sf):
    events = V.table(spark, sf, "events").select("event_type", "event_id")
    assert "WindowGroupLimit" in plan(ingest.cap_per_feed(events, 5, "event_type", ("event_id",)))


def test_window_filter_reaches_the_scan(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    now = F.lit(dt.datetime(2024, 1, 31)).cast("timestamp_ntz")
    text = plan(ingest.filter_window(events, now, 21, "ts").select("event_id"))
    assert "GreaterThanOrEqual(ts" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_ranking_takes_ordered_rows_only(spark, sf):
    assert "TakeOrderedAndProject" in plan(rank.rank_deals(V.deals_scored_v(spark, sf)))


def test_lookups_are_broadcast_by_their_known_size(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("source"))
    text = plan(clean.tier_for(ingest.unify_source(df, dims.alias_dim(spark)), dims.tier_dim(spark)))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text


def test_no_cartesian_in_the_similarity_joins(spark, sf):
    for df in (merge.same_deal_links(V.deals_v(spark, sf)),
               titles.title_links(V.doc_articles_v(spark, sf))):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_url_dedup_limits_groups_on_narrow_rows(spark, sf, tmp_path):
    V.articles_v(spark, sf).write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    text = plan(clean.dedupe_by_url(df).select("id", "feed_pos"))
    assert "WindowGroupLimit" in text and "SortAggregate" not in text
    assert "snippet" not in text and "title" not in text  # unselected text is not read


def test_batches_for_python_are_bounded_by_bytes(spark):
    """Rows of a megabyte, as pairs of vector tiles are, do not go to a worker by dozens."""
    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("s"))

    def sizes(batches):
        for batch in batches:
            yield batch.assign(n=len(batch))[["n"]]

    assert map_batches(rows, sizes, "n int").agg(F.max("n")).first()[0] <= 8


def test_exports_join_the_order_tables_once(spark, sf):
    """Deals, articles and sources are stored; scores and lists of publishers start from there."""
    text = plan(q_deals.exported(spark, sf))
    assert "lineitem" not in text and "supplier" not in text
