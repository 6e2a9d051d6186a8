"""Vector expressions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def carried(df: DataFrame, name: str) -> tuple[Column, str]:
    """A vector as it goes from task to task, and the type of its values: single ones stay so, which is half the bytes, others are doubles."""
    kind = "float" if dict(df.dtypes).get(name) == "array<float>" else "double"
    return F.col(name).cast(f"array<{kind}>"), kind


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v at length 1; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))


def scaled(v: Column, scale: Column) -> Column:
    """Components over their scales, as a fitted scaler says."""
    return F.zip_with(v, scale, lambda x, s: x / s)


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))
