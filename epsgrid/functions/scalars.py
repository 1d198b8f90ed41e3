"""Scalar expressions over point coordinates; all stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A cell is this much wider than eps, so that float32 rounding cannot put neighbours two cells apart.
CELL_SLACK = 1e-6


def check_eps(eps: float) -> float:
    if not (math.isfinite(eps) and eps >= 0):
        raise ValueError(f"eps must be finite and not negative, got {eps}")
    return float(eps)


def squared_radius(eps: float) -> Column:
    """eps * eps as float32 arithmetic has it."""
    r = F.lit(check_eps(eps)).cast("float")
    return r * r


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared Euclidean distance in the arguments' own type; no square root is taken anywhere."""
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def l1_norm(x: Column, y: Column) -> Column:
    return F.abs(x) + F.abs(y)


def cell(value: Column, width: float) -> Column:
    """Number of the grid cell of a coordinate; any sign, no origin and no bounds are needed."""
    return F.floor(value.cast("double") / F.lit(float(width))).cast("long")


def standardised(value: Column, mean: Column, deviation: Column) -> Column:
    """z-score with the population deviation; 0 where the deviation is 0."""
    return F.when(deviation == 0, F.lit(0.0)).otherwise((value - mean) / deviation)


def popcount(bits: Column) -> Column:
    return F.bit_count(bits)


def lowest_bit(bits: Column) -> Column:
    """Position of the lowest set bit counted from 1; 0 where there is none."""
    low = bits.bitwiseAND(-bits)
    return F.when(bits == 0, F.lit(0)).when(low < 0, F.lit(64)).otherwise(F.round(F.log2(low)).cast("int") + 1)


def clear_lowest_bit(bits: Column) -> Column:
    return bits.bitwiseAND(bits - 1)


def set_bits(bits: Column) -> Column:
    """Positions of the set bits from 0, ascending, in an array of bigint."""
    return F.filter(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), lambda i: F.call_function("getbit", bits, i.cast("int")) == 1)


def vector_text(name: str, values: Column) -> Column:
    """``name: a, b, c`` of an array."""
    return F.concat(F.lit(f"{name}: "), F.array_join(values.cast("array<string>"), ", "))


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with so many digits."""
    return F.format_string(f"%.{digits}f", value.cast("double"))
