import math

import pytest
from pyspark.sql import functions as F

from driftfield.functions import quantization as D
from driftfield.functions import quaternion as Q
from driftfield.functions import temporal
from driftfield.functions.numeric import exact_sum, micro
from driftfield.operators import changes, index


def test_micro_rounds_half_to_even_and_drops_what_is_not_finite(spark):
    df = spark.createDataFrame([(0.0000005,), (0.0000015,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(micro(F.col("x"))).collect()] == [0, 2, None, None, None]


def test_exact_sum_is_null_with_an_infinite_addend_and_zero_over_nothing(spark):
    df = spark.createDataFrame([(1.5, 1.0), (2.5, float("inf"))], "x double, y double")
    assert tuple(df.agg(exact_sum(F.col("x")), exact_sum(F.col("y"))).first()) == (4_000_000, None)
    assert df.where("false").agg(exact_sum(F.col("x"))).first()[0] == 0


@pytest.mark.parametrize("cutoff", [0.0, -1.0, 1.5, float("nan")])
def test_bad_cutoffs_are_refused(cutoff):
    with pytest.raises(ValueError):
        temporal.support_half(cutoff)


def test_looping_time(spark):
    got = spark.range(1).select(*[temporal.looping_time(F.lit(t), F.lit(2.0), F.lit(4.0)) for t in (1.0, 2.0, 5.0, 6.5, 13.0)]).first()
    assert list(got) == [0.0, 0.0, 3.0, 0.5, 3.0]


def test_slerp_goes_the_short_way(spark):
    half = math.sqrt(0.5)
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 0.0, 0.0, -half, -half, 0.5)], "a0 double, a1 double, a2 double, a3 double, b0 double, b1 double, b2 double, b3 double, u double")
    r = Q.with_slerp(df, ["a0", "a1", "a2", "a3"], ["b0", "b1", "b2", "b3"], "u", ["q0", "q1", "q2", "q3"]).first()
    assert math.isclose(r["q2"], math.sin(math.pi / 8)) and math.isclose(r["q3"], math.cos(math.pi / 8))


def test_zero_quaternion_is_the_identity(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    assert tuple(Q.with_normalized(df, list("abcd"), list("wxyz")).select(*"wxyz").first()) == (0.0, 0.0, 0.0, 1.0)


@pytest.mark.parametrize("bits", [2, 9])
def test_bad_bit_depths_are_refused(bits):
    with pytest.raises(ValueError):
        D.sh_step(bits)


def test_coarse_codes_stay_in_a_byte(spark):
    assert spark.range(1).select(D.coarsen_sh(F.lit(255).cast("long"), 3)).first()[0] == 255


def test_tiling_of_an_exact_cover_has_no_faults(spark):
    assert index.untiled(spark.createDataFrame([(0.0, 1.0), (1.0, 2.5)], "t0 double, t1 double"), 2.5).count() == 0


def test_composition_equals_a_fold(spark):
    import random

    rng, rows = random.Random(3), []
    for i in range(20):
        born, dead, x = rng.randint(0, 5), rng.randint(6, 13), 0
        for step in range(born, dead):
            x += rng.choice([0, 0, 1, -3])
            rows.append((i, step, x))
    states = spark.createDataFrame(rows, "gaussian_id long, step long, b_x long")
    diff = changes.diffed(states, 4, 12).cache()
    for step in range(12):
        got = {r["gaussian_id"]: r["b_x"] for r in changes.composed_at(diff, step, 4).collect()}
        assert got == {i: x for i, s, x in rows if s == step}
