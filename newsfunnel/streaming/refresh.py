"""Refresh: pick up newly landed feed files, then rebuild the digest with a tighter budget."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsfunnel import dims, schemas
from newsfunnel.functions import dates
from newsfunnel.operators import ingest
from newsfunnel.plans.digest_run import DigestOptions, DigestRun, run_digest
from newsfunnel.session import path_exists
from newsfunnel.sources import feeds, snapshot


DIAGNOSTICS = "diagnostics_"
BATCH_SPAN = 10**12  # more items than one micro-batch can hold
ITEM = f"feed string, {schemas.FEED_ITEM}, feed_pos bigint, published_at timestamp"
KEEP = 2  # snapshots that stay: the new one, and the one that readers may have open


def preset(opts: DigestOptions) -> DigestOptions:
    """The refresh budget: the same run, a narrower window and a lower per-feed cap."""
    return replace(
        opts, window_days=dims.REFRESH_PRESET["window_days"],
        per_feed_cap=dims.REFRESH_PRESET["per_feed_cap"],
        query_limit=dims.REFRESH_PRESET["query_limit"],
    )


def land_new_items(spark: SparkSession, feed_path: str, store: str, checkpoint: str) -> None:
    """Append the items of files that arrived since the last refresh, then stop.

    Each micro-batch owns one folder and overwrites it, so a repeated batch changes nothing.
    Arrival order goes on across batches: feed_pos is the batch number, then the place in it.
    Dates are read once, here; items lie in folders by day, so a window reads only its days.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        numbered = feeds.number_arrivals(batch)
        dated = numbered.withColumn("published_at", ingest.published_at()).withColumn(
            "feed_pos", F.lit(batch_id * BATCH_SPAN) + F.col("feed_pos"))
        dated.select(*schemas.names(ITEM), F.to_date("published_at").alias("day")) \
            .write.mode("overwrite").partitionBy("day").parquet(f"{store}/batch_id={batch_id}")

    query = (
        feeds.stream_feeds(spark, feed_path).writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def refresh(
    spark: SparkSession, feed_path: str, store: str, checkpoint: str, live: str,
    opts: DigestOptions, on_run: Callable[[DigestRun], None] | None = None,
) -> DigestRun:
    """Land new items, run the preset over the stored ones of its window and replace the live snapshot.
    An empty result is stored too: the window may hold nothing, and so may the store.

    The run returned rests on the snapshot, which also holds its diagnostics; its stage tables are
    deleted."""
    land_new_items(spark, feed_path, store, checkpoint)
    opts = preset(opts)
    items = stored_items(spark, store)
    window = in_window(items, opts).drop("batch_id", "day")
    # Silent and broken feeds are told by everything that ever came, on three narrow columns.
    scan = items.select("feed", "title", "_corrupt_record")
    with run_digest(spark, window, opts, scan) as run:
        tables = {**run.tables, **{f"{DIAGNOSTICS}{n}": t for n, t in run.diagnostics.items()}}
        snapshot.write_snapshot(tables, live, force=True, keep=KEEP)
        if on_run is not None:
            on_run(run)
    stored = snapshot.read_snapshot(spark, live)
    return DigestRun(
        {n: t for n, t in stored.items() if not n.startswith(DIAGNOSTICS)},
        {n.removeprefix(DIAGNOSTICS): t for n, t in stored.items() if n.startswith(DIAGNOSTICS)})


def stored_items(spark: SparkSession, store: str) -> DataFrame:
    """All landed items with batch_id and day; none if nothing has landed yet."""
    ddl = f"{ITEM}, batch_id bigint, day date"
    if not path_exists(spark, store):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(store)


def in_window(items: DataFrame, opts: DigestOptions) -> DataFrame:
    """Items of the days that the window touches, by their folders."""
    first = F.to_date(dates.cutoff(F.lit(opts.now), opts.window_days))
    return items.filter(F.col("day") >= first)
