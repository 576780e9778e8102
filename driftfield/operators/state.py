"""What exists at a time: the instant query, its filters, and objects' motion on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftfield.functions import quaternion as Q
from driftfield.functions import temporal
from driftfield.operators.asof import pose_at


def weighted(g: DataFrame, t: Column) -> DataFrame:
    return g.withColumn("marginal", temporal.marginal(t, F.col("mu_t"), F.col("sigma_t")))


def live(g: DataFrame, t: float, cutoff: float = temporal.CUTOFF) -> DataFrame:
    """Elements visible at ``t`` with their ``marginal``; rest positions stay as they are.

    The window is a plain comparison of columns, so scans of sorted or partitioned tables prune by it.
    """
    at = F.lit(float(t))
    g = weighted(g.where((F.col("win_lo") <= at) & (at < F.col("win_hi"))), at)
    return g.where((F.col("marginal") >= cutoff) & ~F.isnan("marginal"))


def moved(g: DataFrame, t: Column) -> DataFrame:
    """Centres at ``t`` and opacities."""
    centre = {f"c{x}": F.col(f"p{x}") + F.col(f"v{x}") * (t - F.col("mu_t")) for x in "xyz"}
    return g.withColumns({**centre, "opacity": F.col("a") * F.col("marginal")})


def state_at(g: DataFrame, t: float, cutoff: float = temporal.CUTOFF) -> DataFrame:
    return moved(live(g, t, cutoff), F.lit(float(t)))


def state_at_many(g: DataFrame, probes: DataFrame, cutoff: float = temporal.CUTOFF, bucket: float = 3.0) -> DataFrame:
    """The state at every ``t`` of ``probes``: an equi-join on time buckets that a window spans, then the exact window.

    A window of many buckets is dealt to each; no pair of an element and a probe outside its buckets is looked at.
    """
    spans = g.withColumn("__b", F.explode(F.sequence(F.floor(F.col("win_lo") / bucket).cast("long"), F.greatest(F.floor(F.col("win_lo") / bucket), F.ceil(F.col("win_hi") / bucket) - 1).cast("long"))))
    at = probes.select("t", F.floor(F.col("t") / bucket).cast("long").alias("__b"))
    inside = weighted(spans.join(at, "__b").where("win_lo <= t AND t < win_hi"), F.col("t")).drop("__b")
    return moved(inside.where((F.col("marginal") >= cutoff) & ~F.isnan("marginal")), F.col("t"))


def with_tracks(state: DataFrame, samples: DataFrame, t: float) -> DataFrame:
    """Centres and orientations carried along by the pose of each element's object at ``t``; no track leaves them alone.

    One pose an object: the poses are few, and are joined as a dimension.
    """
    poses = pose_at(samples, "object_id", t).select("object_id", *[F.col(c).alias(f"r_{c}") for c in ("qx", "qy", "qz", "qw", "tx", "ty", "tz")])
    j = state.join(poses, "object_id", "left")
    q, shift = tuple(F.col(f"r_q{x}") for x in "xyzw"), tuple(F.col(f"r_t{x}") for x in "xyz")
    there = F.col("r_qw").isNotNull()
    centre = Q.applied(q, shift, tuple(F.col(f"c{x}") for x in "xyz"))
    turned = q if "qw" not in state.columns else Q.multiply(q, tuple(F.col(f"q{x}") for x in "xyzw"))
    made = {f"c{x}": F.when(there, c).otherwise(F.col(f"c{x}")) for x, c in zip("xyz", centre)}
    made |= {f"o{x}": F.when(there, c).otherwise(F.col(f"q{x}") if "qw" in state.columns else F.lit(1.0 if x == "w" else 0.0)) for x, c in zip("xyzw", turned)}
    return j.withColumns(made).drop(*[c for c in j.columns if c.startswith("r_")])


def gathered(g: DataFrame, ids: DataFrame, key: str = "gaussian_id") -> DataFrame:
    """Only the elements named in ``ids``."""
    return g.join(ids.select(key), key, "left_semi")
