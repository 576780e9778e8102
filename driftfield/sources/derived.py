"""Scene relations derived from the star-schema tables by pure selects.

The scene clock counts days of ``events.ts`` since 2024-01-01. All arithmetic is on doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DURATION, WINDOW_DAYS, EPOCH_US, DAY_US = 30.0, 3.0, 1704067200000000, 86400000000.0
STEP_EPOCH_US, STEP_DAYS = 788918400000000, 100


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One element an event: rest position, velocity, opacity, birth time and width, window, object."""
    e = read(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    d = (micros(F.col("ts")) - F.lit(EPOCH_US)).cast("double")
    over = lambda x, n: x.cast("double") / F.lit(float(n))
    low = F.lit(WINDOW_DAYS) * F.floor(d / F.lit(DAY_US * WINDOW_DAYS)).cast("double")
    return e.select(
        i.alias("gaussian_id"), (F.col("value") / F.lit(100.0)).alias("px"), over(u % 50, 10).alias("py"), over(i % 97, 10).alias("pz"),
        over(i % 7 - 3, 10).alias("vx"), over(i % 5 - 2, 10).alias("vy"), over(i % 3 - 1, 10).alias("vz"), (F.lit(0.05) + F.lit(0.95) * over(i % 20, 19)).alias("a"),
        (d / F.lit(DAY_US)).alias("mu_t"), F.when(F.col("event_type") == "error", F.lit(float("inf"))).otherwise(F.lit(0.01) + over(u % 50, 100)).alias("sigma_t"),
        low.alias("win_lo"), (low + F.lit(WINDOW_DAYS)).alias("win_hi"), (u % 8).alias("object_id"),
    )


def values(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def yaw(degrees: float) -> tuple[float, float, float, float]:
    half = math.radians(degrees) / 2
    return 0.0, 0.0, math.sin(half), math.cos(half)


#: Object -> (interpolation, yaw in degrees and shift at times 0, 10, 20, 30); object 5 has one sample.
TRACKS = {1: ("linear", (0, 40, 40, 170), (0, 1, 2, 2)), 2: ("linear", (0, 1, -1, 0), (0, 0, 5, 5)), 3: ("linear", (0, 120, 240, 360), (1, -1, 1, -1)), 4: ("step", (0, 90, 180, 270), (0, 2, 4, 6)), 5: ("linear", (30,), (7,))}


def track_rows() -> list[tuple]:
    return [(o, how, i, 10.0 * i, *yaw(y), float(s), s / 2.0, 0.0) for o, (how, yaws, shifts) in TRACKS.items() for i, (y, s) in enumerate(zip(yaws, shifts))]


TRACK_DDL = "object_id long, interpolation string, i int, t double, qx double, qy double, qz double, qw double, tx double, ty double, tz double"


def track_samples(spark: SparkSession) -> DataFrame:
    return values(spark, track_rows(), TRACK_DDL)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gaussian_id, step, b_x): orders as integer bins of a customer at steps of 100 days; unique by id and step."""
    o = read(spark, sf_dir, "orders")
    step = F.floor((micros(F.col("o_orderdate")) - F.lit(STEP_EPOCH_US)) / F.lit(STEP_DAYS * DAY_US)).cast("long")
    return o.groupBy(F.col("o_custkey").alias("gaussian_id"), step.alias("step")).agg(F.sum(F.floor("o_totalprice")).cast("long").alias("b_x"))
