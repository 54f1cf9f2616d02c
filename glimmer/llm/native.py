"""Column expressions on words and word windows (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and 0x09-0x0D; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def windows(items: str, width: int) -> Column:
    """64-bit names of each ``width`` consecutive entries of the array column ``items`` (empty when it is shorter).

    ``items`` has to be a column, not an expression, so that entries are looked up and not computed again.
    """
    c = F.col(items)
    named = F.transform(c, lambda x, i: F.xxhash64(x, *(F.get(c, i + k) for k in range(1, width))))
    return F.when(F.size(c) >= width, F.slice(named, 1, F.greatest(F.size(c) - (width - 1), F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
