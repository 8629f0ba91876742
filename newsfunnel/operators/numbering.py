"""Global row numbers without a single-task window and without sorting whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsfunnel.session import broadcast_if_few, cut_lineage, write_stage

_LOCAL_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def _before(sizes: DataFrame) -> DataFrame:
    """(_part, _offset): what stands before each partition. One row per partition, not per row."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))


def _sorted(df: DataFrame, order: list[Column], columns: list[str]) -> tuple[DataFrame, int]:
    """`columns` of `df` sorted and stored with _part and _local, their place, and the number of rows.
    Range bounds come from a sample and must not change between counting and numbering."""
    rows = df.orderBy(*order).select(*columns).withColumn("_at", F.monotonically_increasing_id())
    placed, _, seen = write_stage(rows, "sorted", n=F.count(F.lit(1)))
    return placed.withColumns({
        "_part": F.shiftright("_at", _LOCAL_BITS),
        "_local": F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)),
    }).drop("_at"), seen["n"]


def with_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Number all rows 0, 1, 2, ... in `order`, which must be total. Rows are range-partitioned and
    sorted, so each task numbers only its own range; use it for narrow rows."""
    placed, _ = _sorted(df, order, df.columns)
    offsets = _before(placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")))
    return placed.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_offset") + F.col("_local")).drop("_part", "_local", "_offset")


def with_ordinal_joined(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """The same numbers for wide rows. They are stored where they are; only the columns of `order` are
    sorted, and the numbers are joined to the rows by their place."""
    placed = cut_lineage(df.withColumn("_mid", F.monotonically_increasing_id()), "unsorted")
    keys, rows = _sorted(placed, order, ["_mid"])
    offsets = _before(keys.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")))
    numbers = keys.join(F.broadcast(offsets), "_part").select(
        "_mid", (F.col("_offset") + F.col("_local")).alias(name))
    return placed.join(broadcast_if_few(numbers, rows), "_mid").drop("_mid")


def running_total(df: DataFrame, order: list[Column], amount: str, name: str) -> tuple[DataFrame, int]:
    """(`df` with the sum of `amount` over all rows before each in `order`, number of rows)."""
    placed, rows = _sorted(df, order, df.columns)
    offsets = _before(placed.groupBy("_part").agg(F.sum(amount).alias("_n")))
    earlier = Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(amount).over(earlier), F.lit(0))
    return placed.withColumn("_sum", local).join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_offset") + F.col("_sum")).drop("_part", "_local", "_offset", "_sum"), rows
