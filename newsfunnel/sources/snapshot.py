"""Snapshot store: a directory of tables, replaced as a whole.

Every write goes to a new version folder; a pointer line with the next number is then added and
never replaced. The highest number is the current version. So a reader sees the old version or
the new one, never a mixture and never nothing, and a writer that dies leaves the old one.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsfunnel.session import delete_tree, path_exists

TABLES = ("deals", "clusters", "membership", "articles", "funnel", "sections", "header")


class EmptySnapshotError(RuntimeError):
    """A run without deals must not replace a snapshot that has some."""


class LoadedSnapshot(NamedTuple):
    tables: dict[str, DataFrame]
    source: str  # 'live' or 'seed'


def _pointer(spark: SparkSession, path: str) -> tuple[int, str]:
    """(number, version) of the newest pointer line; one line per write."""
    line = spark.read.text(f"{path}/current").agg(F.max("value")).first()[0]
    number, _, version = line.partition(" ")
    return int(number), version


def _current(spark: SparkSession, path: str) -> str:
    return f"{path}/{_pointer(spark, path)[1]}"


def _is_missing(error: PySparkException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    root = _current(spark, path)
    names = [r[0] for r in spark.read.text(f"{root}/tables").collect()]  # a handful of names
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def _existing_deals(spark: SparkSession, path: str) -> int:
    """Only a snapshot that was never written counts as 0; any other failure is raised, so the
    guard never opens because storage is unwell."""
    try:
        _pointer(spark, path)
    except PySparkException as error:
        if _is_missing(error):
            return 0
        raise
    return read_snapshot(spark, path)["deals"].count()


def write_snapshot(
    tables: dict[str, DataFrame], path: str, force: bool = False, keep: int | None = None,
) -> str:
    """Write `tables` (must hold 'deals') as the current snapshot of `path`.

    Refuses to replace a snapshot that has deals by one that has none, unless forced: an empty
    run is far more often broken than true. With `keep`, versions older than the `keep` newest are
    deleted at the end.
    """
    if keep is not None and keep < 1:
        raise ValueError("at least the new version is kept")
    spark = tables["deals"].sparkSession
    version = f"v-{uuid.uuid4().hex}"
    # Deals come first and are looked at where they are stored, so that they are computed once.
    for name, table in sorted(tables.items(), key=lambda t: t[0] != "deals"):
        table.write.mode("error").parquet(f"{path}/{version}/{name}")
        if name == "deals" and not force and spark.read.schema(table.schema).parquet(f"{path}/{version}/deals").isEmpty():
            existing = _existing_deals(spark, path)
            if existing:
                delete_tree(spark, f"{path}/{version}")
                raise EmptySnapshotError(f"run has no deals, current snapshot has {existing}")
    names = spark.createDataFrame([(n,) for n in tables], "value string")
    names.coalesce(1).write.mode("error").text(f"{path}/{version}/tables")
    try:
        number = _pointer(spark, path)[0] + 1
    except PySparkException as error:
        if not _is_missing(error):
            raise
        number = 1
    pointer = spark.createDataFrame([(f"{number:020d} {version}",)], "value string")
    pointer.coalesce(1).write.mode("append").text(f"{path}/current")
    if keep is not None:
        retain(spark, path, keep)
    return version


def manifest(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of every snapshot ever written to `path`, newest first; one line each."""
    lines = [r["value"].partition(" ") for r in spark.read.text(f"{path}/current").collect()]
    return sorted(((int(number), version) for number, _, version in lines), reverse=True)


def retain(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Delete the versions before the `keep` newest; readers of those that stay are not disturbed. A
    version a writer has not pointed to yet is not touched. Returns what was deleted."""
    gone = []
    for _, version in manifest(spark, path)[keep:]:
        if path_exists(spark, f"{path}/{version}"):
            delete_tree(spark, f"{path}/{version}")
            gone.append(version)
    return gone


def load_snapshot(spark: SparkSession, live: str | None, seed: str) -> LoadedSnapshot:
    """The live snapshot, or the seed when the live one is missing or unreadable."""
    if live:
        try:
            return LoadedSnapshot(read_snapshot(spark, live), "live")
        except PySparkException:
            pass
    return LoadedSnapshot(read_snapshot(spark, seed), "seed")


def snapshot_row(
    header: DataFrame, funnel: DataFrame, deals: DataFrame, sections: DataFrame
) -> DataFrame:
    """The digest as one nested row: header, funnel, selected deals in rank order, sections.

    All of it is bounded by the number of selected deals. The evidence is not (one story may
    have very many articles) and is exported as rows beside it.
    """

    def listed(df: DataFrame, name: str, order: str) -> DataFrame:
        cols = [order, *[c for c in df.columns if c != order]]
        return df.agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))

    row = header.withColumn("_one", F.lit(1))
    for part in (
        funnel.select(F.struct(*funnel.columns).alias("funnel")),
        listed(deals, "deals", "rank_pos"),
        listed(sections, "sections", "category_pos"),
    ):  # each side is exactly one row
        row = row.join(F.broadcast(part.withColumn("_one", F.lit(1))), "_one")
    return row.drop("_one")


def evidence(
    deals: DataFrame, membership: DataFrame, articles: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(membership, articles) pruned to what the selected deals rest on."""
    wanted = F.broadcast(deals.select("cluster_id").distinct())  # one id per selected deal
    kept = membership.join(wanted, "cluster_id", "left_semi")
    ids = kept.select(F.col("article_id").alias("id")).distinct()
    return kept, articles.join(ids, "id", "left_semi")
