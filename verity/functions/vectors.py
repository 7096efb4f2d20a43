"""Vector columns: packing and inner products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_matrix(rows: Column) -> Column:
    """Rows of numbers as one flat array."""
    return F.flatten(rows)


def unpack_matrix(flat: Column, tokens: Column, dim: int) -> Column:
    """A flat array as ``tokens`` rows of ``dim`` numbers."""
    cut = lambda i: F.slice(flat, i * dim + 1, F.lit(dim))
    return F.when(tokens > 0, F.transform(F.sequence(F.lit(0), tokens - 1), cut)).otherwise(F.array().cast("array<array<float>>"))


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
