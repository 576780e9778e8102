"""Keyframes and deltas: composing a population from changes, and the changes between two populations.

Integer differences telescope, so the state at one step is a grouped sum and a last operation: no iteration, no
densified history, and map-side combine throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gop(step: str, cadence: int):
    """Step of the keyframe that a step depends on."""
    return (F.floor(F.col(step) / cadence) * cadence).cast("long")


def is_keyframe(step: str, cadence: int, forced: tuple[int, ...] = ()):
    """The first step, forced ones, and every ``cadence``-th."""
    return (F.col(step) % cadence == 0) | F.col(step).isin(*forced)


def filled(steps: DataFrame, last_step: int, gone_id_mod: int = 10, gone_after: int = 15) -> DataFrame:
    """(gaussian_id, step, b_x) at each step from an element's first one: its last known bin; some ids go for good."""
    w = Window.partitionBy("gaussian_id").orderBy("step")
    s = steps.withColumn("upto", F.coalesce(F.lead("step").over(w) - 1, F.lit(last_step).cast("long"))).where(F.col("step") <= last_step)
    each = s.select("gaussian_id", F.explode(F.sequence("step", F.least("upto", F.lit(last_step).cast("long")))).alias("step"), "b_x")
    return each.where((F.col("gaussian_id") % gone_id_mod != 0) | (F.col("step") <= gone_after))


def diffed(states: DataFrame, cadence: int, last_step: int) -> DataFrame:
    """Changes (gop, step, gaussian_id, op, b_x): all rows at keyframes (k), else births (b), updates by difference (u), deaths (d)."""
    w = Window.partitionBy("gaussian_id").orderBy("step")
    s = states.withColumns({"prev_step": F.lag("step").over(w), "prev": F.lag("b_x").over(w), "next_step": F.lead("step").over(w)})
    came = F.col("prev_step").isNull() | (F.col("prev_step") != F.col("step") - 1)
    op = F.when(F.col("step") % cadence == 0, "k").when(came, "b").when(F.col("b_x") != F.col("prev"), "u")
    s = s.withColumn("op", op)
    stay = s.where("op IS NOT NULL").select(gop("step", cadence).alias("gop"), "step", "gaussian_id", "op", F.when(F.col("op") == "u", F.col("b_x") - F.col("prev")).otherwise(F.col("b_x")).alias("b_x"))
    left = s.where((F.col("step") < last_step) & (F.col("next_step").isNull() | (F.col("next_step") != F.col("step") + 1)))
    deaths = left.select((F.col("step") + 1).alias("step"), "gaussian_id").where(F.col("step") % cadence != 0)
    return stay.unionByName(deaths.select(gop("step", cadence).alias("gop"), "step", "gaussian_id", F.lit("d").alias("op"), F.lit(None).cast("long").alias("b_x")))


def composed_at(changes: DataFrame, step: int, cadence: int) -> DataFrame:
    """The population at a step, from its keyframe and the deltas up to it."""
    key = step // cadence * cadence
    c = changes.where((F.col("gop") == key) & (F.col("step") <= step))
    return c.groupBy("gaussian_id").agg(F.sum("b_x").alias("b_x"), F.max_by("op", "step").alias("last")).where("last <> 'd'").select("gaussian_id", "b_x")


def composed(changes: DataFrame) -> DataFrame:
    """Every touched row's running bin: a window within (group of pictures, element)."""
    w = Window.partitionBy("gop", "gaussian_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("value", F.sum("b_x").over(w))


def delta_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """(gaussian_id, op, b_x): births, deaths, and updates by difference; unchanged rows are left out."""
    j = old.select("gaussian_id", F.col("b_x").alias("x")).join(new.select("gaussian_id", F.col("b_x").alias("y")), "gaussian_id", "full_outer")
    op = F.when(F.col("x").isNull(), "b").when(F.col("y").isNull(), "d").when(F.col("x") != F.col("y"), "u")
    return j.select("gaussian_id", op.alias("op"), F.when(op == "u", F.col("y") - F.col("x")).otherwise(F.col("y")).alias("b_x")).where("op IS NOT NULL")


def applied(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The population after a delta: deaths leave, updates add, births come."""
    d = delta.select("gaussian_id", "op", F.col("b_x").alias("d_x"))
    j = state.join(d, "gaussian_id", "full_outer").where("op IS NULL OR op <> 'd'")
    return j.select("gaussian_id", F.when(F.col("op") == "b", F.col("d_x")).otherwise(F.col("b_x") + F.coalesce("d_x", F.lit(0))).alias("b_x"))


def births(states: DataFrame) -> DataFrame:
    """How often each element came: present now and not at the step before. Over one birth is a reused id."""
    w = Window.partitionBy("gaussian_id").orderBy("step")
    came = states.withColumn("prev", F.lag("step").over(w)).where(F.col("prev").isNull() | (F.col("prev") < F.col("step") - 1))
    return came.groupBy("gaussian_id").agg(F.count("*").alias("births"), F.min("step").alias("first_step"))
