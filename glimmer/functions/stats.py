"""Column expressions: order statistics and moments of packed arrays, with defined results for constant or empty input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Mean of an array, null where it is empty."""
    return F.try_divide(total(a), F.size(a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def hazen(a: Column, p: float) -> Column:
    """Percentile at midpoint positions (n p + 1/2, held to 1..n) between the sorted values."""
    s = F.array_sort(a)
    h = F.greatest(F.lit(1.0), F.least(F.size(a).cast("double"), F.size(a) * p + 0.5))
    low = F.get(s, F.floor(h).cast("int") - 1)
    return low + (h - F.floor(h)) * (F.coalesce(F.get(s, F.floor(h).cast("int")), low) - low)


def hazen_sql(a: str, p: float) -> str:
    h = f"greatest(1.0, least(len({a})::double, len({a}) * {p} + 0.5))"
    low = f"list_sort({a})[floor({h})::int]"
    return f"({low} + ({h} - floor({h})) * (coalesce(list_sort({a})[floor({h})::int + 1], {low}) - {low}))"


def correlation(a: Column, b: Column) -> Column:
    """Correlation of two arrays from five sums, none nested in another; null where one is constant."""
    n, x, y = F.size(a), total(a), total(b)
    spread = (n * dot(a, a) - x * x) * (n * dot(b, b) - y * y)
    return (n * dot(a, b) - x * y) / F.sqrt(F.when(spread > 0, spread))
