"""The interval index: windows as a dimension, chunks that cover a time, what a seek costs, whether chunks tile the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(g: DataFrame) -> DataFrame:
    """Distinct windows numbered in order. There are few: the pairs are aggregated before they are numbered."""
    pairs = g.groupBy("win_lo", "win_hi").agg(F.count("*").alias("n"))
    return pairs.select((F.row_number().over(Window.orderBy("win_lo", "win_hi")) - 1).alias("idx"), F.col("win_lo").alias("lo"), F.col("win_hi").alias("hi"), "n")


def windows_by_first(g: DataFrame, ordinal: str) -> DataFrame:
    """The same, numbered in the order in which they are first seen."""
    pairs = g.groupBy("win_lo", "win_hi").agg(F.min(ordinal).alias("first"))
    return pairs.select((F.row_number().over(Window.orderBy("first")) - 1).alias("idx"), F.col("win_lo").alias("lo"), F.col("win_hi").alias("hi"), "first")


def chunk_index(g: DataFrame, duration: float, bytes_each: int = 64) -> DataFrame:
    """A chunk for every window and one, chunk 0, for the elements that never fade."""
    never = F.col("sigma_t") == F.lit(float("inf"))
    root = g.where(never).agg(F.count("*").alias("gaussian_count")).select(F.lit(0).cast("long").alias("chunk_id"), F.lit(0.0).alias("t0"), F.lit(float(duration)).alias("t1"), "gaussian_count")
    each = windows(g.where(~never)).select((F.col("idx") + 1).cast("long").alias("chunk_id"), F.col("lo").alias("t0"), F.col("hi").alias("t1"), F.col("n").alias("gaussian_count"))
    return root.unionByName(each).withColumn("chunk_length", F.col("gaussian_count") * bytes_each)


def covers(t: Column) -> Column:
    return (F.col("t0") <= t) & (t < F.col("t1"))


def overlaps(a: Column, b: Column) -> Column:
    return (F.col("t0") < b) & (a < F.col("t1"))


def untiled(chunks: DataFrame, duration: float, by: str | None = None) -> DataFrame:
    """Rows (t0, t1, fault) where chunks leave a gap, overlap, or don't begin at 0 or end at the duration."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy("t0", "t1")
    c = chunks.withColumns({"before": F.lag("t1").over(w), "after": F.lead("t0").over(w)})
    fault = F.when(F.col("before").isNull() & (F.col("t0") != 0), "starts-late").when(F.col("before") < F.col("t0"), "gap").when(F.col("before") > F.col("t0"), "overlap").when(F.col("after").isNull() & (F.col("t1") != F.lit(float(duration))), "ends-off")
    return c.select("t0", "t1", fault.alias("fault")).where("fault IS NOT NULL")
