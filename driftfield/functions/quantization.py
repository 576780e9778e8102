"""Bins and grids: every attribute's bins, their pitches, and what the bins stand for."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftfield.functions.numeric import clamp
from driftfield.functions.temporal import support_half

#: Fixed values of the scheme: reference lifetime and its classes, relative birth-time pitch, coefficient range.
LIFE_REF, LIFE_CLASSES, LIFE_HALF = 0.5, (-4, 2), (0.02, 2.0)
MU_REL, MU_CLASSES = 0.05, (-10, 0)
SH_LOW, SH_HIGH = -4.0, 4.0
#: Error bounds by profile. The position's is a share of the median scale, colours' are in 255ths.
PROFILES = {
    "fine": {"pos": 0.02, "scale_rel": 0.005, "rot": 0.0005, "rgb": 0.5, "alpha": 0.5, "time": 0.0005, "sigma_rel": 0.005, "sh": 0},
    "default": {"pos": 0.05, "scale_rel": 0.02, "rot": 0.002, "rgb": 1.0, "alpha": 1.0, "time": 0.002, "sigma_rel": 0.02, "sh": 0},
    "coarse": {"pos": 0.20, "scale_rel": 0.06, "rot": 0.006, "rgb": 3.0, "alpha": 3.0, "time": 0.008, "sigma_rel": 0.06, "sh": 1},
}


def quantize(x: Column, step: Column | float, origin: Column | float = 0.0) -> Column:
    """The nearest bin, ties to the even one."""
    step = F.lit(step) if isinstance(step, float) else step
    origin = F.lit(origin) if isinstance(origin, float) else origin
    return F.rint((x - origin) / step).cast("long")


def dequantize(b: Column, step: Column | float, origin: Column | float = 0.0) -> Column:
    step = F.lit(step) if isinstance(step, float) else step
    origin = F.lit(origin) if isinstance(origin, float) else origin
    return b.cast("double") * step + origin


def bounds(profile: str, median_scale: float) -> dict[str, float]:
    """Greatest deviations that a decoder may see."""
    p = PROFILES[profile]
    pos = p["pos"] * median_scale
    return {**p, "pos": pos, "rgb": p["rgb"] / 255.0, "alpha": p["alpha"] / 255.0, "motion": pos / LIFE_REF}


def steps(b: dict[str, float]) -> dict[str, float]:
    """Grid pitches: twice the bound, in the logarithm where the bound is relative."""
    out = {k: 2.0 * b[k] for k in ("pos", "rot", "rgb", "alpha", "motion", "time")}
    return out | {"scale_log": 2.0 * math.log1p(b["scale_rel"]), "sigma_log": 2.0 * math.log1p(b["sigma_rel"]), "sh": max(1, 2 * b["sh"] + 1)}


def life_class(sigma_bin: Column, sigma_log_step: float, never_fades: Column, window: Column, cutoff: float = 0.05) -> Column:
    """Precision class of a velocity: how many doublings of the reference lifetime cover the element's own."""
    half = F.when(never_fades, window).otherwise(F.lit(support_half(cutoff)) * F.exp(sigma_bin * F.lit(sigma_log_step)))
    return clamp(F.ceil(F.log2(clamp(half, *LIFE_HALF) / F.lit(LIFE_REF))).cast("long"), *LIFE_CLASSES).cast("long")


def motion_step(life: Column, step: float) -> Column:
    return F.lit(step) * F.pow(F.lit(2.0), -life.cast("double"))


def mu_step(sigma_bin: Column, sigma_log_step: float, never_fades: Column, step: float) -> Column:
    """Birth-time pitch: the reference pitch, halved until it is a small share of the element's own sigma."""
    target = F.when(never_fades, F.lit(step)).otherwise(F.least(F.lit(step), F.lit(MU_REL) * F.exp(sigma_bin * F.lit(sigma_log_step))))
    halvings = clamp(F.floor(F.log2(target / F.lit(step))).cast("double"), *map(float, MU_CLASSES))
    return F.lit(step) * F.pow(F.lit(2.0), halvings)


def colour_forward(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Green, and red and blue as differences to it; exact on integers."""
    return g, r - g, b - g


def colour_inverse(g: Column, dr: Column, db: Column) -> tuple[Column, Column, Column]:
    return dr + g, g, db + g


def sh_step(bits: int) -> int:
    """Pitch in code units of coefficients kept at so many bits."""
    if not 3 <= bits <= 8:
        raise ValueError(f"coefficients have 3 to 8 bits, not {bits}")
    return 1 << (8 - bits)


def sh_bound(bits: int) -> int:
    return sh_step(bits) // 2


def sh_bound_float(bits: int) -> float:
    return sh_bound(bits) * (SH_HIGH - SH_LOW) / 255.0


def coarsen_sh(code: Column, step: int) -> Column:
    """Codes moved to their bin's centre, kept within a byte."""
    return code if step <= 1 else clamp(F.floor(code / step).cast("long") * step + step // 2, 0, 255).cast("long")


def sh_coefficient(code: Column) -> Column:
    return code.cast("double") * F.lit((SH_HIGH - SH_LOW) / 255.0) + F.lit(SH_LOW)


def zigzag(x: Column) -> Column:
    """Signed to unsigned so that small magnitudes stay small."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-(u.bitwiseAND(F.lit(1).cast("long"))))


def to_signed32(x: Column) -> Column:
    """An unsigned 32-bit label as the signed number of the same bits."""
    return F.when(x >= 1 << 31, x - F.lit(1 << 32)).otherwise(x)


def to_unsigned32(x: Column) -> Column:
    return F.pmod(x, F.lit(1 << 32))


def _spread(x: Column) -> Column:
    """Bit i of a 21-bit number at place 3 i."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton_cell(x: Column, low: Column, high: Column) -> Column:
    span = F.when(high - low <= 0, F.lit(1.0)).otherwise(high - low)
    return F.rint(clamp((x - low) / span, 0.0, 1.0) * F.lit(float((1 << 21) - 1))).cast("long")


def morton_code(x: Column, y: Column, z: Column) -> Column:
    """Interleaved bits of three 21-bit cells."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def unorm(word: Column, shift: int, bits: int) -> Column:
    """A field of a packed word as a number from 0 to 1."""
    top = (1 << bits) - 1
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit(top).cast("long")).cast("double") / F.lit(float(top))
