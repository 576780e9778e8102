"""Quaternions (x, y, z, w) as tuples of columns: everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Quat = tuple[Column, Column, Column, Column]
Vec = tuple[Column, Column, Column]
#: Fixed value: cosine above which interpolation goes along the chord.
NEAR_PARALLEL = 0.9995


def _total(values) -> Column:
    first, *rest = values
    for x in rest:
        first = first + x
    return first


def normalized(q: Quat) -> Quat:
    """Unit length, scaled by the largest component first so that squares can't overflow; no direction gives the identity."""
    scale = F.greatest(*[F.abs(x) for x in q])
    some = (scale > 0) & (scale != F.lit(float("inf"))) & ~F.isnan(scale)
    safe = F.when(some, scale).otherwise(F.lit(1.0))
    small = [x / safe for x in q]
    length = F.sqrt(_total([x * x for x in small]))
    unit = F.when(some, length).otherwise(F.lit(1.0))
    return tuple(F.when(some, x / unit).otherwise(F.lit(1.0 if i == 3 else 0.0)) for i, x in enumerate(small))


def multiply(a: Quat, b: Quat) -> Quat:
    (ax, ay, az, aw), (bx, by, bz, bw) = a, b
    return (aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def with_normalized(df: DataFrame, names: list[str], made: list[str]) -> DataFrame:
    """``df`` with unit quaternions, in steps: an expression that is used often is a column, not a repeated tree."""
    df = df.withColumn("__scale", F.greatest(*[F.abs(n) for n in names]))
    some = (F.col("__scale") > 0) & (F.col("__scale") != F.lit(float("inf"))) & ~F.isnan("__scale")
    df = df.withColumns({f"__s{i}": F.when(some, F.col(n) / F.col("__scale")) for i, n in enumerate(names)})
    df = df.withColumn("__length", F.sqrt(_total([F.col(f"__s{i}") * F.col(f"__s{i}") for i in range(4)])))
    df = df.withColumns({m: F.coalesce(F.col(f"__s{i}") / F.col("__length"), F.lit(1.0 if i == 3 else 0.0)) for i, m in enumerate(made)})
    return df.drop("__scale", "__length", *[f"__s{i}" for i in range(4)])


def with_slerp(df: DataFrame, a: list[str], b: list[str], u: str, made: list[str]) -> DataFrame:
    """``df`` with the quaternion ``u`` of the way from ``a`` to ``b`` (unit ones) on the shortest arc; nearly parallel ones along the chord."""
    df = df.withColumn("__dot", _total([F.col(x) * F.col(y) for x, y in zip(a, b)]))
    df = df.withColumns({"__sign": F.when(F.col("__dot") < 0, F.lit(-1.0)).otherwise(F.lit(1.0)), "__cos": F.abs("__dot")})
    df = df.withColumn("__theta", F.acos(F.least("__cos", F.lit(1.0))))
    wide, t = F.col("__cos") <= NEAR_PARALLEL, F.col("__theta")
    df = df.withColumns({"__wa": F.when(wide, F.sin((1 - F.col(u)) * t) / F.sin(t)), "__wb": F.when(wide, F.sin(F.col(u) * t) / F.sin(t) * F.col("__sign"))})
    chord = [f"__c{i}" for i in range(4)]
    df = df.withColumns({c: F.col(x) + F.col(u) * (F.col(y) * F.col("__sign") - F.col(x)) for c, x, y in zip(chord, a, b)})
    df = with_normalized(df, chord, chord)
    df = df.withColumns({m: F.coalesce(F.col("__wa") * F.col(x) + F.col("__wb") * F.col(y), F.col(c)) for m, x, y, c in zip(made, a, b, chord)})
    return df.drop("__dot", "__sign", "__cos", "__theta", "__wa", "__wb", *chord)


def matrix(q: Quat) -> tuple[Vec, Vec, Vec]:
    """Rows of the rotation matrix of a unit quaternion."""
    x, y, z, w = q
    return (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)), (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)), (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y))


def rotated(q: Quat, v: Vec) -> Vec:
    return tuple(_total([m * x for m, x in zip(row, v)]) for row in matrix(q))


def applied(q: Quat, shift: Vec, v: Vec) -> Vec:
    """A pose applied to a point."""
    return tuple(x + s for x, s in zip(rotated(q, v), shift))


def composed(outer: tuple[Quat, Vec], inner: tuple[Quat, Vec]) -> tuple[Quat, Vec]:
    """The pose that applies ``inner`` and then ``outer``."""
    return multiply(outer[0], inner[0]), applied(*outer, inner[1])


def smallest_three(q: Quat, step: float) -> tuple[Column, Vec]:
    """Place of the largest component (the first of equals) and the bins of the others, its sign made positive."""
    q = normalized(q)
    sizes = F.array(*[F.abs(x) for x in q])
    at = (F.array_position(sizes, F.array_max(sizes)) - 1).cast("long")
    parts = F.array(*q)
    sign = F.when(F.get(parts, at.cast("int")) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    rest = [F.get(parts, F.when(at > i, F.lit(i)).otherwise(F.lit(i + 1))) * sign for i in range(3)]
    return at, tuple(F.rint(x / F.lit(step)).cast("long") for x in rest)


def from_smallest_three(at: Column, bins: Vec, step: float) -> Quat:
    rest = [F.least(F.greatest(b.cast("double") * F.lit(step), F.lit(-1.0)), F.lit(1.0)) for b in bins]
    left = F.sqrt(F.greatest(1 - _total([x * x for x in rest]), F.lit(0.0)))
    parts = [F.when(at == i, left).otherwise(rest[i] if i == 0 else F.when(at > i, rest[i] if i < 3 else rest[2]).otherwise(rest[i - 1])) for i in range(4)]
    norm = F.sqrt(_total([x * x for x in parts]))
    norm = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return tuple(x / norm for x in parts)
