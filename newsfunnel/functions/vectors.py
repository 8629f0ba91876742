"""Vector expressions for joined pairs; bulk similarity is in operators.cosine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector, an error for vectors of unequal width."""
    scale = norm(a) * norm(b)
    value = F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("vector length mismatch")).cast("double")
    )
