"""Which chunk each element goes to: the deepest node of a temporal interval tree that holds its whole support.

Below each window of the clock a binary tree halves the time. An element's deepest node is an expression of its own row;
a node that fewer elements reach than a chunk should have is folded into its parent. Only the counts of distinct deepest
nodes are looked at for that, which the tree's depth bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftfield.sources.storage import cut


def deepest(lo: Column, hi: Column, tops: list[float], most_depth: int) -> Column:
    """Struct of ``top`` (-1: none holds it), ``depth`` and ``place`` (turns as bits, right is one) of the deepest node."""
    pairs = list(zip(tops, tops[1:]))
    inside = F.array(*[F.struct(F.lit(i).alias("top"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(pairs)])
    first = F.get(F.filter(inside, lambda x: (lo >= x["a"]) & (hi <= x["b"])), F.lit(0))

    def turn(at, _):
        mid = (at["a"] + at["b"]) * F.lit(0.5)
        left, right = hi <= mid, lo >= mid
        go = (left | right) & ~at["done"]
        bit = F.when(left, 0).otherwise(1)
        return F.struct(F.when(go & ~left, mid).otherwise(at["a"]).alias("a"), F.when(go & left, mid).otherwise(at["b"]).alias("b"), (at["depth"] + F.when(go, 1).otherwise(0)).alias("depth"), F.when(go, at["place"] * 2 + bit).otherwise(at["place"]).alias("place"), (~go).alias("done"))

    start = F.struct(first["a"].alias("a"), first["b"].alias("b"), F.lit(0).alias("depth"), F.lit(0).alias("place"), F.lit(False).alias("done"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(most_depth)), start, turn) if most_depth else start
    return F.when(first.isNotNull(), F.struct(first["top"].alias("top"), walk["depth"].alias("depth"), walk["place"].alias("place"))).otherwise(F.struct(F.lit(-1).alias("top"), F.lit(0).alias("depth"), F.lit(0).alias("place")))


def planned(g: DataFrame, lo: Column, hi: Column, tops: list[float], most_depth: int = 4, least: int = 64) -> DataFrame:
    """``g`` with ``t0``, ``t1`` and ``level`` of its chunk. ``tops`` are the bounds of the windows, ascending; an element
    that none holds goes to the whole clock's chunk. Null supports are held by none; an empty table stays empty."""
    g = g.withColumn("__node", deepest(lo, hi, tops, most_depth))
    # A row a node. Cut off, or conditions on nodes would be pushed below the supports, each as one expression of all that they are made of.
    leaves = cut(g.groupBy("__node").agg(F.count("*").alias("n"))).select("__node", "__node.*", "n")
    above = leaves.select("__node", "top", "depth", "place", "n", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("d")).withColumn("p", F.expr("shiftright(place, depth - d)"))
    pools = above.groupBy("top", "d", "p").agg(F.sum("n").alias("pool"))
    # The first node on the way down that too few reach ends the way.
    stop = above.join(pools, ["top", "d", "p"]).groupBy("__node").agg(F.min(F.when((F.col("d") > 0) & (F.col("pool") < least), F.col("d"))).alias("stop"), F.first("depth").alias("depth"), F.first("place").alias("place"), F.first("top").alias("top"))
    at = F.least(F.coalesce(F.col("stop") - 1, F.col("depth")), F.col("depth"))
    ends = stop.select(F.col("__node").alias("__n"), "top", at.cast("int").alias("level"), "place", "depth")
    bounds = F.array(*[F.lit(float(x)) for x in tops])

    def halved(s, d):
        mid = (s["a"] + s["b"]) * F.lit(0.5)
        right = F.call_function("getbit", F.col("place").cast("long"), (F.col("depth") - d).cast("int")) == 1
        return F.struct(F.when(right, mid).otherwise(s["a"]).alias("a"), F.when(right, s["b"]).otherwise(mid).alias("b"))

    def half(side: str) -> Column:
        start = F.struct(F.get(bounds, F.col("top")).alias("a"), F.get(bounds, F.col("top") + 1).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.col("level")), start, halved)[side]

    whole = F.col("top") < 0
    side = lambda k: F.when(whole, F.lit(float(tops[0] if k == "a" else tops[-1]))).when(F.col("level") == 0, F.get(bounds, F.col("top") + (0 if k == "a" else 1))).otherwise(half(k))
    ends = ends.select("__n", side("a").alias("t0"), side("b").alias("t1"), "level")
    # At most 2 ** (depth + 1) rows a window.
    return g.join(F.broadcast(ends) if len(tops) << (most_depth + 1) <= 100_000 else ends, F.col("__node") == F.col("__n")).drop("__node", "__n")
