"""As-of brackets over ordered samples: the last sample up to a time and the one after, clamped at both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftfield.functions import quaternion as Q

ROT, SHIFT = ("qx", "qy", "qz", "qw"), ("tx", "ty", "tz")


def bracketed(samples: DataFrame, key: str, t: Column) -> DataFrame:
    """One row a key: its sample at or before the clamped ``t``, with the next sample's columns as ``n_*`` (null at the end).

    Two aggregations with map-side combine instead of a sort: the greatest sample not after ``t`` and the least one after.
    """
    cols = [c for c in samples.columns if c != key]
    s = F.struct("t", *[c for c in cols if c != "t"])
    got = samples.groupBy(key).agg(F.max(F.when(F.col("t") <= t, s)).alias("b"), F.min(F.when(F.col("t") > t, s)).alias("n"))
    first = F.col("b").isNull()  # before the first sample: it stands alone
    b = F.when(first, F.col("n")).otherwise(F.col("b"))
    return got.select(key, *[b[c].alias(c) for c in cols], *[F.when(~first, F.col("n")[c]).alias(f"n_{c}") for c in cols])


def pose_at(samples: DataFrame, key: str, t: float) -> DataFrame:
    """(key, rotation, shift) at ``t``: linear between samples, by shortest arc; ``step`` holds the earlier sample."""
    at = F.lit(float(t))
    r = bracketed(samples, key, at)
    alone = F.col("n_t").isNull() | (F.col("interpolation") == "step")
    r = r.withColumns({"__alone": alone, "__u": F.when(alone, F.lit(0.0)).otherwise((at - F.col("t")) / (F.col("n_t") - F.col("t"))), **{f"n_{c}": F.coalesce(f"n_{c}", c) for c in ROT + SHIFT}})
    a, b = [f"__a{c}" for c in ROT], [f"__b{c}" for c in ROT]
    r = Q.with_normalized(Q.with_normalized(r, list(ROT), a), [f"n_{c}" for c in ROT], b)
    r = Q.with_slerp(r, a, b, "__u", [f"__r{c}" for c in ROT])
    turned = [F.when(F.col("__alone"), F.col(x)).otherwise(F.col(f"__r{c}")).alias(c) for x, c in zip(a, ROT)]
    return r.select(key, *turned, *[(F.col(c) + F.col("__u") * (F.col(f"n_{c}") - F.col(c))).alias(c) for c in SHIFT])


def with_next(samples: DataFrame, key: str, order: str = "t") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return samples.withColumns({"t_prev": F.lag(order).over(w), "t_next": F.lead(order).over(w)})
