"""Reference chains among chunks: each delta names an earlier chunk, keyframes end a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.operators.rules import faults, report
from driftfield.sources.storage import cut


def walked(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """``chunks`` (offset, kind, reference) with ``keyframe`` (null if the chain ends nowhere) and ``depth``.

    Pointers double each round, so a chain of n chunks takes log n joins; keyframes (kind 0) point to themselves. Rounds
    end when no pointer moves, or beyond ``most`` links: by default as many as there are chunks, which only cycles reach.
    """
    at = F.when(F.col("kind") == 0, F.col("offset")).otherwise(F.col("reference"))
    p = chunks.select("offset", at.alias("to"), F.when(F.col("kind") == 0, 0).otherwise(1).cast("long").alias("steps"))
    span, most = 1, chunks.count() if most is None else most
    while span < most:
        nxt = p.select(F.col("offset").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        p = p.join(nxt, "to", "left").select("offset", F.col("to2").alias("to"), (F.col("steps") + F.col("steps2")).alias("steps"), (~F.col("to").eqNullSafe(F.col("to2"))).alias("moved"))
        p = cut(p)  # or the plan would double each round
        if p.where("moved").isEmpty():
            break
        p, span = p.drop("moved"), 2 * span
    key = chunks.where("kind = 0").select(F.col("offset").alias("to"), F.lit(True).alias("is_key"))
    ends = p.join(key, "to", "left").select("offset", F.when(F.col("is_key"), F.col("to")).alias("keyframe"), F.when(F.col("is_key"), F.col("steps")).alias("depth"))
    return chunks.join(ends, "offset", "left")


def chain_faults(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """Forward and broken references, chains without a keyframe, and declared depths that aren't the walked ones."""
    known = chunks.select(F.col("offset").alias("__o"))
    delta = chunks.where("kind = 1")
    broken = delta.join(known, F.col("reference") == F.col("__o"), "left_anti")
    ended = walked(chunks.where("kind = 0 OR reference < offset"), most).where("kind = 1")
    return report(
        faults(delta, "forward-reference", "offset", "reference >= offset"),
        faults(broken, "broken-reference", "offset"),
        faults(ended, "chain-without-keyframe", "offset", "keyframe IS NULL"),
        faults(ended, "depth-mismatch", "offset", "keyframe IS NOT NULL AND declared_depth <> depth"),
    )


def mismatched(index: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) where an index and the records that it describes differ; rows that only one side has differ in ``key``."""
    j = index.select(key, *[F.col(f).alias(f"i_{f}") for f in fields], F.lit(True).alias("i_there")).join(found.select(key, *[F.col(f).alias(f"f_{f}") for f in fields], F.lit(True).alias("f_there")), key, "full_outer")
    both = F.col("i_there").isNotNull() & F.col("f_there").isNotNull()
    bad = F.array_compact(F.array(F.when(~both, F.lit(key)), *[F.when(both & ~F.col(f"i_{f}").eqNullSafe(F.col(f"f_{f}")), F.lit(f)) for f in fields]))
    return j.select(key, F.explode(bad).alias("field"))
