"""Node transforms as columns: matrices from turns, scales and shifts, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftfield.functions.quaternion import Quat, Vec, matrix

Rows = tuple[Vec, Vec, Vec]


def node_matrix(turn: Quat, scale: Vec, shift: Vec) -> tuple[Rows, Vec]:
    """Rows of the upper three by three of a node's matrix (turn times scale), and its shift."""
    return tuple(tuple(m * s for m, s in zip(row, scale)) for row in matrix(turn)), shift


def nested(outer: tuple[Rows, Vec], inner: tuple[Rows, Vec]) -> tuple[Rows, Vec]:
    """The transform that applies ``inner`` and then ``outer``."""
    (a, p), (b, q) = outer, inner
    dot = lambda row, column: row[0] * column[0] + row[1] * column[1] + row[2] * column[2]
    return tuple(tuple(dot(row, [b[k][j] for k in range(3)]) for j in range(3)) for row in a), tuple(dot(row, q) + s for row, s in zip(a, p))


def decomposed(m: Rows) -> tuple[Rows, Column, Column]:
    """Rotation, uniform scale, and the fault that keeps a matrix from being just those two (null if none does)."""
    lengths = [F.sqrt(m[0][j] * m[0][j] + m[1][j] * m[1][j] + m[2][j] * m[2][j]) for j in range(3)]
    r = tuple(tuple(F.try_divide(x, lengths[j]) for j, x in enumerate(row)) for row in m)
    dot = lambda i, j: r[0][i] * r[0][j] + r[1][i] * r[1][j] + r[2][i] * r[2][j]
    determinant = r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])
    apart = F.greatest(*[F.abs(x - lengths[0]) for x in lengths[1:]]) > F.lit(1e-8) + F.lit(1e-4) * lengths[0]
    sheared = F.greatest(F.abs(dot(0, 1)), F.abs(dot(0, 2)), F.abs(dot(1, 2))) > 1e-4
    degenerate = (F.least(*lengths) <= 0) | F.isnan(lengths[0] + lengths[1] + lengths[2])
    fault = F.when(degenerate, "degenerate-transform").when(apart, "non-uniform-scale").when(sheared, "sheared-transform").when(determinant < 0, "mirroring-transform")
    return r, lengths[0], fault


def quaternion_of(r: Rows) -> Quat:
    """The unit quaternion of a rotation matrix, from the largest of the trace and the diagonal."""
    trace = r[0][0] + r[1][1] + r[2][2]
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    s = F.lit(2.0) * root(trace + 1.0)
    ways = [(F.try_divide(r[2][1] - r[1][2], s), F.try_divide(r[0][2] - r[2][0], s), F.try_divide(r[1][0] - r[0][1], s), s / F.lit(4.0))]
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        t = F.lit(2.0) * root(1.0 + r[i][i] - r[j][j] - r[k][k])
        parts = {i: t / F.lit(4.0), j: F.try_divide(r[j][i] + r[i][j], t), k: F.try_divide(r[k][i] + r[i][k], t)}
        ways.append((parts[0], parts[1], parts[2], F.try_divide(r[k][j] - r[j][k], t)))
    which = F.when(trace > 0, 0).when((r[0][0] >= r[1][1]) & (r[0][0] >= r[2][2]), 1).when(r[1][1] >= r[2][2], 2).otherwise(3)
    return tuple(F.when(which == 0, ways[0][c]).when(which == 1, ways[1][c]).when(which == 2, ways[2][c]).otherwise(ways[3][c]) for c in range(4))
