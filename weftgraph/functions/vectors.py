"""Vectors as arrays of double, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def scale(a: Column, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(by)
    return F.transform(a, lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def encode(a: Column, sep: str = ",") -> Column:
    return F.concat_ws(sep, F.transform(a, lambda x: x.cast("string")))


def decode(text: Column, sep: str = ",") -> Column:
    return F.transform(F.split(text, sep), lambda x: x.cast("double"))


def histogram_bucket(v: Column, low: float, high: float, n: int) -> Column:
    """0 below ``low``, 1 to ``n`` for equal widths, ``n`` from ``high`` on; null for null."""
    return F.least(F.width_bucket(v, F.lit(low), F.lit(high), F.lit(n)), F.lit(n))
