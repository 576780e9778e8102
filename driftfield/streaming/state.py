"""Streams of scene changes: framing of appended files, and the population kept up to date change by change.

Structured Streaming supplies progress and recovery. Nothing here waits for late data: a scene's clock is ordered, and
changes of one element arrive in step order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftfield.functions import temporal

CHANGE = "gop long, step long, gaussian_id long, op string, b_x long"
STATE = "gaussian_id long, step long, b_x long, live boolean, fault string"


def changes(spark: SparkSession, path: str) -> DataFrame:
    """Changes as they arrive as Parquet files in a folder, a few files a batch."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 8).parquet(path)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    value, live, seen = state.get if state.exists else (0, False, False)
    rows = []
    for pdf in frames:
        for r in pdf.sort_values("step").itertuples(index=False):
            fault = None
            if r.op == "k" or r.op == "b":
                fault = "gaussian-id-reused" if r.op == "b" and seen else None
                value, live, seen = int(r.b_x), True, True
            elif not live:
                fault = "unknown-id"
            elif r.op == "u":
                value += int(r.b_x)
            else:
                live = False
            rows.append((key[0], r.step, value if live else None, live, fault))
    state.update((value, live, seen))
    yield pd.DataFrame({n: pd.array([r[i] for r in rows], dtype=t) for i, (n, t) in enumerate((("gaussian_id", "Int64"), ("step", "Int64"), ("b_x", "Int64"), ("live", "boolean"), ("fault", "string")))})


def population(stream: DataFrame) -> DataFrame:
    """Every change as the state that it leads to; three numbers are kept for an element. Changes that don't fit are named."""
    return stream.groupBy("gaussian_id").applyInPandasWithState(_advance, STATE, "value long, live boolean, seen boolean", "append", GroupStateTimeout.NoTimeout)


def live_counts(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Elements born in each time window of an event stream with a ``ts``; late rows are let in up to a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"))


def visible_now(stream: DataFrame, t: float, cutoff: float = temporal.CUTOFF) -> DataFrame:
    """The instant query over arriving elements: a stateless filter."""
    at = F.lit(float(t))
    weighted = stream.withColumn("marginal", temporal.marginal(at, F.col("mu_t"), F.col("sigma_t")))
    return weighted.where(temporal.visible(at, F.col("win_lo"), F.col("win_hi"), F.col("marginal"), cutoff))
