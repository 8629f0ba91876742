"""Tabular and nested exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsfunnel import dims

# RFC 4180: quotes are doubled. The default escape character would be a backslash.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def write_csv(rows: DataFrame, path: str) -> None:
    writer = rows.write.mode("overwrite").options(**CSV_OPTIONS)
    writer.option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in dims.EXPORT_COLUMNS)
    return (
        spark.read.options(**CSV_OPTIONS).option("multiLine", "true").schema(schema).csv(path)
        .na.fill("")
    )


def export_path(base: str, generated_at: Column, spark: SparkSession, prefix: str = "deals"):
    """<base>/<prefix>-YYYY-MM-DD: an export is named by its snapshot."""
    day = spark.range(1).select(F.date_format(generated_at, "yyyy-MM-dd")).first()[0]
    return f"{base.rstrip('/')}/{prefix}-{day}"


def write_json(parts: dict[str, DataFrame], path: str) -> None:
    """The snapshot as JSON documents, one folder per part. Absent facts stay absent."""
    for name, part in parts.items():
        part.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{path}/{name}")
