"""Landed feed files: scanning, failure report, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsfunnel import schemas
from newsfunnel.functions import text
from newsfunnel.operators.numbering import running_total
from newsfunnel.session import broadcast_if_few, cut_lineage

RAW_ITEM = (
    "title string, link string, isoDate string, pubDate string, contentSnippet string, "
    "content string, description string, source string, _corrupt_record string"
)
READ_OPTIONS = {"rowTag": "item", "mode": "PERMISSIVE"}


def feed_name(path):
    """Feed of a landed file: the value of its feed=... folder, else the file name stem."""
    folder = F.regexp_extract(path, r"/feed=([^/]+)/", 1)
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.coalesce(F.try_url_decode(F.when(folder == "", stem).otherwise(folder)), folder)


def shape_items(raw: DataFrame) -> DataFrame:
    """(feed, path, block, FEED_ITEM columns) from the raw XML rows."""
    content = F.coalesce("content", "description")
    return raw.select(
        feed_name(F.col("_metadata.file_path")).alias("feed"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        "title", "link", "isoDate", "pubDate",
        F.coalesce("contentSnippet", text.strip_html(content)).alias("contentSnippet"),
        content.alias("content"), "source", "_corrupt_record",
    ).select("feed", "path", "block", *schemas.names(schemas.FEED_ITEM))


def scan_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Items of all landed RSS files below `path`. A broken file costs only its own items: it
    shows up as a row with nothing but _corrupt_record.

    feed_pos numbers the items by file path and place in the file, however the files are split
    and packed into tasks."""
    raw = (
        spark.read.format("xml").options(**READ_OPTIONS).option("recursiveFileLookup", "true")
        .schema(RAW_ITEM).load(path)
    )
    return number_arrivals(shape_items(raw))


def number_arrivals(read: DataFrame, name: str = "feed_pos") -> DataFrame:
    """Scanned items with their number from 0: files by path, splits by their first byte, then as read.

    Items are stored as they are read and never sorted: a split's items stand together in one task,
    so the number of the split's first item, from the counts of all splits, numbers them all."""
    placed = cut_lineage(
        read.withColumn("block", F.coalesce("block", F.lit(0).cast("long")))
        .withColumn("_at", F.monotonically_increasing_id()), "items")
    splits = placed.groupBy("path", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before, rows = running_total(splits, [F.asc("path"), F.asc("block")], "_n", "_before")
    return (
        placed.join(broadcast_if_few(before.drop("_n"), rows), ["path", "block"])
        .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("path", "block", "_at", "_first", "_before")
    )


def stream_feeds(spark: SparkSession, path: str) -> DataFrame:
    """The same items, not yet numbered, as a stream of newly landed files."""
    raw = (
        spark.readStream.format("xml").options(**READ_OPTIONS)
        .option("recursiveFileLookup", "true").schema(RAW_ITEM).load(path)
    )
    return shape_items(raw)


def is_broken():
    """An item nothing could be read from."""
    return F.col("title").isNull() & F.col("_corrupt_record").isNotNull()


def good_items(scan: DataFrame) -> DataFrame:
    return scan.filter(~is_broken())


def feed_failures(scan: DataFrame, expected: DataFrame) -> DataFrame:
    """(feed, error): expected feeds that were broken or brought nothing.

    `scan` needs feed, title and _corrupt_record, `expected` needs feed. Both kinds of failure are
    reported and neither stops the run.
    """
    per_feed = scan.groupBy("feed").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(is_broken()).alias("broken")
    )
    seen = expected.select("feed").distinct().join(per_feed, "feed", "full")
    error = F.when(F.col("items").isNull(), F.lit("no items")).when(
        F.col("broken") > 0,
        F.concat(F.lit("unreadable items: "), F.col("broken").cast("string")),
    )
    return seen.select("feed", error.alias("error")).filter("error is not null")


def write_feeds(items: DataFrame, path: str) -> None:
    """Land items (feed plus item columns) as RSS files, one folder per feed."""
    (
        items.write.format("xml").option("rowTag", "item").option("rootTag", "channel")
        .partitionBy("feed").mode("overwrite").save(path)
    )
