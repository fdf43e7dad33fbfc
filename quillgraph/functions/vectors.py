"""Vector expressions over arrays; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a norm is 0, null if a side is null."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0)))


def mean_of_arrays(arrays: Column) -> Column:
    """Element-wise mean of an array of equally long arrays."""
    total = F.aggregate(
        F.slice(arrays, 2, F.greatest(F.size(arrays) - 1, F.lit(0))), F.transform(arrays[0], lambda x: x.cast("double")),
        lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(arrays))
