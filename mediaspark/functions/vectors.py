"""Vector expressions on arrays; everything is computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaspark.functions.text import col


def as_double(vector: Column | str) -> Column:
    return col(vector).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def clamped_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of unit vectors, held in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b)))
