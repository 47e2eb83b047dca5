"""Vector similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null arrays and unequal lengths are refused at run time."""
    same = F.size(a) == F.size(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.when(same, total).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)
