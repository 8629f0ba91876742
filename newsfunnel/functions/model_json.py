"""Answers of text models: JSON that may be wrapped in prose or cut off."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_model_json(c: Column) -> Column:
    """VARIANT of the text, or of its outermost {...}; NULL marks an unusable answer."""
    return F.coalesce(
        F.try_parse_json(c),
        F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0)),
    )


def parsed_fields(c: Column, fields: list[str]) -> Column:
    """Array with one struct of the named fields as text, or empty for an unusable answer.

    Same salvage rule as `parse_model_json`, read in one pass per attempt. Explode it: a
    generator is evaluated once, where a filter on the parsed value would parse again.
    """
    schema = ", ".join(f"{f} string" for f in fields) + ", _bad string"
    options = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}

    def read(text: Column) -> Column:
        return F.from_json(text, schema, options)

    retried = F.transform(
        F.array(read(c)),
        lambda s: F.when(s["_bad"].isNull(), s).otherwise(
            read(F.regexp_extract(c, r"(?s)\{.*\}", 0))),
    )
    return F.filter(retried, lambda s: s.isNotNull() & s["_bad"].isNull())


def text_at(v: Column, path: str) -> Column:
    """A field that must be a JSON string; any other JSON type counts as absent."""
    is_text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    return F.when(is_text, F.try_variant_get(v, path, "string"))


def scalar_at(v: Column, path: str) -> Column:
    """A field as text, whatever its scalar type."""
    return F.try_variant_get(v, path, "string")


def number_at(v: Column, path: str) -> Column:
    """A field that must be a JSON number; numbers in quotes count as absent."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.isin("STRING", "BOOLEAN"), F.lit(None).cast("double")).otherwise(
        F.try_variant_get(v, path, "double")
    )


def strictly_true(v: Column, path: str) -> Column:
    """True only for a JSON `true`; the text \"true\" or the number 1 is not enough."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(False)
    )
