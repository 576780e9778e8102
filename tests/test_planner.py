import random

import pytest
from pyspark.sql import functions as F

from driftfield.operators.planner import planned


def plan(rows, tops, most_depth, least):
    """The same by walking the tree down from each window."""
    out = {}

    def down(a, b, level, pool):
        if level < most_depth and pool:
            mid = (a + b) * 0.5
            left = [r for r in pool if r[2] <= mid]
            right = [r for r in pool if r[1] >= mid and r not in left]
            for x, y, part in ((a, mid, left), (mid, b, right)):
                if len(part) >= least:
                    down(x, y, level + 1, part)
                    pool = [r for r in pool if r not in part]
        for r in pool:
            out[r[0]] = (a, b, level)

    seen = set()
    for a, b in zip(tops, tops[1:]):
        pool = [r for r in rows if r[1] >= a and r[2] <= b and r[0] not in seen]
        seen |= {r[0] for r in pool}
        down(a, b, 0, pool)
    return out | {r[0]: (tops[0], tops[-1], 0) for r in rows if r[0] not in seen}


@pytest.mark.parametrize("most_depth, least", [(0, 1), (1, 5), (3, 8), (5, 1), (4, 40)])
def test_plans_equal_the_walk_down(spark, most_depth, least):
    rng = random.Random(most_depth * 10 + least)
    rows = [(i, lo, lo + rng.choice([0.0, 0.1, 0.7, 2.0, 5.0])) for i in range(200) for lo in [rng.randint(0, 240) / 8]]
    tops = [0.0, 3.0, 10.0, 30.0]
    df = spark.createDataFrame(rows, "id long, lo double, hi double")
    got = {r["id"]: (r["t0"], r["t1"], r["level"]) for r in planned(df, F.col("lo"), F.col("hi"), tops, most_depth, least).collect()}
    assert got == plan(rows, tops, most_depth, least)
    assert planned(df.where("false"), F.col("lo"), F.col("hi"), tops).count() == 0
