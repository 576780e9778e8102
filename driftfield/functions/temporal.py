"""When and how visible: marginals, supports, motion, looping clocks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default threshold of visibility and the least width of a marginal.
CUTOFF, LEAST_SIGMA = 0.05, 1e-30


def support_half(cutoff: float = CUTOFF) -> float:
    """Half-width, in sigmas, of the interval in which a marginal reaches ``cutoff``."""
    if not 0.0 < cutoff <= 1.0:
        raise ValueError(f"a cutoff must be in (0, 1], not {cutoff}")
    return math.sqrt(-2.0 * math.log(cutoff))


def marginal(t: Column, mu: Column, sigma: Column) -> Column:
    """One where sigma is not finite (never fades), else the bell curve's value."""
    z = (t - mu) / F.greatest(sigma, F.lit(LEAST_SIGMA))
    return F.when(F.isnan(sigma) | (sigma == F.lit(float("inf"))), F.lit(1.0)).otherwise(F.exp(F.lit(-0.5) * z * z))


def visible(t: Column, low: Column, high: Column, weight: Column, cutoff: float = CUTOFF) -> Column:
    """Inside the half-open window and not below the cutoff; a NaN weight is not visible."""
    return (low <= t) & (t < high) & (weight >= F.lit(cutoff)) & ~F.isnan(weight)


def support(mu: Column, sigma: Column, low: Column, high: Column, cutoff: float = CUTOFF) -> tuple[Column, Column]:
    """The interval in which an element can be visible, clipped to its window."""
    inf = F.lit(float("inf"))
    half = F.when(F.isnan(sigma) | (sigma == inf), inf).otherwise(F.lit(support_half(cutoff)) * sigma)
    return F.greatest(mu - half, low), F.least(mu + half, high)


def looping_time(t: Column, start: Column, duration: Column) -> Column:
    """Time since ``start`` within a loop of ``duration``; zero up to the start."""
    return F.when(t <= start, F.lit(0.0)).otherwise(F.pmod(F.pmod(t, duration) - F.pmod(start, duration), duration))


def local_time(t: Column, start: Column, duration: Column, loop: Column) -> Column:
    once = F.least(F.greatest(F.lit(0.0), t - start), F.greatest(duration, F.lit(0.0)))
    return F.when(loop & (duration > 0), looping_time(t, start, F.when(duration > 0, duration))).otherwise(once)


def active(t: Column, start: Column, duration: Column, loop: Column) -> Column:
    return (t >= start) & (loop | (t - start < duration))
