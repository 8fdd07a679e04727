"""Column functions over numbers, vectors and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def logit_scale(x: Column, top: float = 5.0) -> Column:
    """top / (1 + exp(-x))."""
    return F.lit(top) / (1 + F.exp(-x))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """x on the range from low to high; null where the range is empty."""
    return F.when(high > low, (x - low) / (high - low))


def total(a: Column) -> Column:
    """The sum of an array; nulls in it make it null."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, compat: bool = False) -> Column:
    """Great-circle metres. ``compat`` takes degrees as if they were radians and the two axes in exchange."""
    if compat:
        a, b, c, d = lat1, lon1, lat2, lon2
    else:
        a, b, c, d = F.radians(lon1), F.radians(lat1), F.radians(lon2), F.radians(lat2)
    h = F.pow(F.sin((d - b) / 2), 2) + F.cos(b) * F.cos(d) * F.pow(F.sin((c - a) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bucket_of_ten(x: Column, width: int = 10) -> Column:
    """0 .. 9: the tenth that x falls in, all beyond the last in the last."""
    return F.greatest(F.lit(0), F.least(F.floor(x / width), F.lit(9))).cast("int")


def bucket_label(bucket: Column, width: int = 10) -> Column:
    return F.concat(F.lit("["), bucket * width, F.lit(","), (bucket + 1) * width, F.lit(")"))
