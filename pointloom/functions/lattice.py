"""The exactly nested lattice: every index derives from the base index by integer floor division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def base_index(w: Column) -> Column:
    """floor(w / 5 cm) with the quotient rounded to single precision, as single-precision positions need it."""
    base = F.lit(C.BASE).cast("float").cast("double")
    return F.floor((w.cast("float").cast("double") / base).cast("float")).cast("bigint")


def floor_div(a: Column, b: Column | int) -> Column:
    """Integer division that rounds down, exact below 2 ** 50.  Each side is named once, as either may be a long
    expression that the optimiser puts in its place."""
    return F.floor(a / (F.lit(b) if isinstance(b, int) else b)).cast("bigint")


def by_level(level: Column, values: tuple) -> Column:
    """values[level]; for a null level the first, as filters on it may be evaluated before null levels are out."""
    return F.element_at(F.array(*map(F.lit, values)), F.coalesce(level, F.lit(0)) + 1)


def cell_index(w: Column, level: Column) -> Column:
    return F.when(level.isNotNull(), floor_div(base_index(w), by_level(level, C.DIVISOR)))


def level_of(distance: Column) -> Column:
    """Band of a distance; null beyond the last band and for NaN."""
    return F.when(F.isnan(distance), None).when(distance <= C.OUTER[0], 0).when(distance <= C.OUTER[1], 1).when(distance <= C.OUTER[2], 2).cast("int")


def z_floor(distance: Column) -> Column:
    return F.lit(C.Z_LOW) - F.lit(C.MAX_GRADE) * distance


def planar(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)
