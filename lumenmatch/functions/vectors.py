"""Vector columns: normalisation, dot product, component sums."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

VECTOR = "array<double>"


def dot(a: Column, b: Column) -> Column:
    """Dot product; equals the cosine for unit vectors. Terms are added in index order, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _fma(x: Column, y: Column, acc: Column) -> Column:
    product = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), x, y, acc).cast("double")
    return F.when(x.isNotNull() & y.isNotNull() & acc.isNotNull(), product)


def fused_dot(a: Column, b: Column) -> Column:
    """Dot product by fused multiply-adds in index order, one rounding per term, as the SQL engine computes it.

    Equal to ``dot`` up to rounding, and slower; for vectors that only rounding tells apart.
    """
    return F.aggregate(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(0.0), lambda acc, t: _fma(t["x"], t["y"], acc))


def l2_normalize(v: Column, squares: Column | None = None) -> Column:
    """Divide by the vector's own norm; NULL for a zero vector. ``squares``: its square, if rounded in another way."""
    if squares is None:
        squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    norm = F.sqrt(F.nullif(squares, F.lit(0.0)))
    # the one-element transform binds the norm once instead of once per component
    return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


def vector_sum(v: Column) -> Column:
    """Component-wise sum as an aggregate with map-side partials (one vector per task and key is shuffled)."""
    return vector_to_array(Summarizer.sum(array_to_vector(v)))


def mix(base: Column, weight: Column, other: Column) -> Column:
    """unit(base + weight * other), in every bit as in the SQL."""
    mixed = F.zip_with(base.cast(VECTOR), other.cast(VECTOR), lambda a, b: a + weight * b)
    return l2_normalize(mixed, fused_dot(mixed, mixed))
