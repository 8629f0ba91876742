"""Feed dates, arrival order, snapshot pointer, echoed numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsfunnel.functions import dates
from newsfunnel.operators import batches, diagnostics, ingest
from newsfunnel.sources import feeds, snapshot

DATES = {
    "Tue, 05 Mar 2024 10:00:07 GMT": "2024-03-05T10:00:07.000Z",
    "Tue, 05 Mar 2024 10:00 GMT": "2024-03-05T10:00:00.000Z",
    "5 Mar 24 10:00:00 GMT": "2024-03-05T10:00:00.000Z",
    "5 Mar 97 1:05:00 +0100": "1997-03-05T00:05:00.000Z",
    "Tue, 5 March 2024 10:00:00 GMT": "2024-03-05T10:00:00.000Z",
    "Tuesday,  5 Mar 2024 10:00:00 +0530": "2024-03-05T04:30:00.000Z",
    "5 Mar 2024 10:00:00": "2024-03-05T10:00:00.000Z",
    "2024-03-05": "2024-03-05T00:00:00.000Z",
    "2024-03-05T10:00:00+02:00": "2024-03-05T08:00:00.000Z",
    " 2024-03-05 10:00:00.5 ": "2024-03-05T10:00:00.500Z",
    "12:30": None, "T10:00:00": None, "2024": None, "": None, "soon": None, "31 Foo 2024 10:00:00 GMT": None,
    "2024-13-05": None, "99": None,
}


def test_feed_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "c string")
    shown = F.date_format(dates.parse_feed_date(F.col("c")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    assert {r["c"]: r["d"] for r in df.select("c", shown.alias("d")).collect()} == DATES


def test_arrival_order_does_not_depend_on_splits(spark, tmp_path):
    for name in ("b", "a", "c"):
        items = "".join(f"<item><title>{name}{i}</title><link>http://x/{name}{i}</link></item>\n" for i in range(60))
        (tmp_path / f"{name}.xml").write_text(f"<rss><channel>\n{items}</channel></rss>")
    seen = set()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "2k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            scan = feeds.scan_feeds(spark, str(tmp_path))
            seen.add(tuple(r["title"] for r in ingest.cap_per_feed(scan, 7).orderBy("feed_pos").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen == {tuple(f"{n}{i}" for n in "abc" for i in range(7))}


def test_no_cap_keeps_all(spark):
    df = spark.range(100).select(F.lit("f").alias("feed"), F.col("id").alias("feed_pos"))
    assert ingest.cap_per_feed(df, None).count() == 100


def test_writer_that_dies_before_the_pointer_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    deals = spark.range(3).toDF("deal_id")
    path = str(tmp_path / "live")
    first = snapshot.write_snapshot({"deals": deals}, path)
    assert snapshot.write_snapshot({"deals": deals.limit(2)}, path) != first

    def dies(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(snapshot, "_pointer", dies)
    with pytest.raises(KeyboardInterrupt):
        snapshot.write_snapshot({"deals": deals.limit(1)}, path, force=True)
    monkeypatch.undo()
    assert snapshot.read_snapshot(spark, path)["deals"].count() == 2


def test_guard_fails_closed_when_storage_is_broken(spark, tmp_path):
    import shutil

    deals = spark.range(3).toDF("deal_id")
    path = str(tmp_path / "live")
    version = snapshot.write_snapshot({"deals": deals}, path)
    shutil.rmtree(f"{path}/{version}/deals")
    with pytest.raises(Exception) as error:
        snapshot.write_snapshot({"deals": deals.limit(0)}, path)
    assert not isinstance(error.value, snapshot.EmptySnapshotError)


def test_only_whole_numbers_echo_a_row(spark):
    packed = spark.createDataFrame([(0, 1), (0, 2)], "batch long, n int")
    answers = spark.createDataFrame([(0, '{"v": [{"n": 1.5, "d": 1}, {"n": 2.0, "d": 1}]}')], "batch long, response string")
    got = {r["n"]: r["a"] for r in batches.match_by_echo(packed, answers).select("n", F.to_json("answer").alias("a")).collect()}
    assert got[1] is None and got[2] is not None


def test_deal_without_a_cluster_rests_on_its_own_article(spark):
    deals = spark.createDataFrame([("a", "c"), ("b", "gone")], "deal_id string, cluster_id string")
    members = spark.createDataFrame([("x", "c")], "article_id string, cluster_id string")
    articles = spark.createDataFrame([("x", "u1"), ("b", "u2")], "id string, url string")
    got = {tuple(r) for r in diagnostics.audit_chain(deals, members, articles).collect()}
    assert got == {("a", "c", "x", "u1"), ("b", "gone", "b", "u2")}
