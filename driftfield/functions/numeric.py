"""Numbers that compare equal across engines: integer micro-units, and guards against NaN and infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def micro(x: Column) -> Column:
    """The value in whole millionths, half to even; null where it is null or not finite."""
    return F.when(finite(x), F.rint(x * F.lit(1e6)).cast("long"))


def exact_sum(x: Column) -> Column:
    """Sum of micro-units, in any order the same; null if an addend isn't finite, zero over no rows."""
    whole = F.sum(micro(x).cast("decimal(28,0)"))
    return F.when(F.count(F.when(~finite(x), 1)) == 0, F.coalesce(whole, F.lit(0)).cast("decimal(38,0)").cast("long"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rounded(x: Column) -> Column:
    """Six decimals as a double, half to even, without a negative zero; null where it is not finite."""
    return F.when(finite(x), F.rint(x * F.lit(1e6)) / F.lit(1e6) + F.lit(0.0))


def sort_key(x: Column) -> Column:
    """The rounded value for ordering: NaN counts as infinity, infinities stay."""
    inf = F.lit(float("inf"))
    return F.when(F.isnan(x), inf).when(F.abs(x) == inf, x).otherwise(F.rint(x * F.lit(1e6)) / F.lit(1e6))
