"""Column expressions on boxes, extents, transforms and range images."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotated(q: tuple[Column, Column, Column, Column], p: tuple[Column, Column, Column], t: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """The point p turned by the unit quaternion q = (x, y, z, w) and moved by t."""
    x, y, z, w = q
    a, b, c = p
    rows = (
        (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )
    return tuple(r[0] * a + r[1] * b + r[2] * c + s for r, s in zip(rows, t, strict=True))


def pixel(x: Column, y: Column, z: Column, height: int = 64, width: int = 1024, up: float = 22.5, down: float = -22.5) -> tuple[Column, Column, Column]:
    """(row, column, range) in the range image; angles outside the field of view go to its edge rows."""
    r = F.sqrt(x * x + y * y + z * z)
    pitch = F.asin(F.least(F.greatest(z / r, F.lit(-1.0)), F.lit(1.0)))
    yaw = -F.atan2(y, x)
    span = math.radians(up) - math.radians(down)
    v = F.floor((1.0 - (pitch - math.radians(down)) / span) * height)
    u = F.floor(0.5 * (yaw / math.pi + 1.0) * width)
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("int")
    return clamp(v, height), clamp(u, width), r


def ramp(value: Column, at_least: float, at_full: float) -> Column:
    """0.5 at the class's edge to 1.0 well inside it."""
    return 0.5 + 0.5 * F.least(F.greatest((value - at_least) / (at_full - at_least), F.lit(0.0)), F.lit(1.0))


def extent_class(length: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(object class, confidence) of a box; the tests go from the tightest class to the widest."""
    long, short = F.greatest(length, width), F.least(length, width)
    slim = long / F.greatest(short, F.lit(1e-3))
    tall = height / F.greatest(long, F.lit(1e-3))
    sound = length.isNotNull() & width.isNotNull() & height.isNotNull() & ~F.isnan(long) & ~F.isnan(short) & ~F.isnan(height) & (F.abs(long) < math.inf) & (F.abs(short) < math.inf) & (F.abs(height) < math.inf) & (long > 0)
    # Bounds of each class in metres and ratios.
    ladder = [
        ((long <= 0.6) & (height >= 1.8) & (tall >= 3.0), 3, ramp(tall, 3.0, 8.0)),
        ((long >= 3.0) & (slim >= 3.0), 4, ramp(slim, 3.0, 10.0)),
        ((long <= 1.2) & height.between(0.9, 2.3) & (tall >= 1.1), 1, ramp(tall, 1.1, 4.0)),
        (long.between(1.8, 12.0) & short.between(1.1, 3.0) & height.between(0.5, 4.5), 2, ramp(F.least(long / 1.8, short / 1.1), 1.0, 2.5)),
        ((long >= 3.0) | (height >= 4.5), 5, F.lit(0.4)),
    ]
    kind, sure = F.when(~F.coalesce(sound, F.lit(False)), 0), F.when(~F.coalesce(sound, F.lit(False)), 0.0)
    for test, k, c in ladder:
        kind, sure = kind.when(test, k), sure.when(test, c)
    return kind.otherwise(0).cast("int"), sure.otherwise(0.0)


def box_class(x_lo: Column, y_lo: Column, z_lo: Column, x_hi: Column, y_hi: Column, z_hi: Column) -> tuple[Column, Column]:
    """(object class, confidence) of a box by its lower and upper bounds."""
    return extent_class(x_hi - x_lo, y_hi - y_lo, z_hi - z_lo)


def footprint_key(x: Column, y: Column, cell: float) -> Column:
    """The square of a footprint that a point lies in."""
    return F.struct(F.floor(x / cell).alias("kx"), F.floor(y / cell).alias("ky"))


def planar_speed(vx: Column, vy: Column) -> Column:
    return F.hypot(vx, vy)


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of boxes (centre x, centre y, size x, size y)."""
    side = lambda i: F.greatest(F.least(a[i] + a[i + 2] / 2, b[i] + b[i + 2] / 2) - F.greatest(a[i] - a[i + 2] / 2, b[i] - b[i + 2] / 2), F.lit(0.0))
    both = side(0) * side(1)
    union = a[2] * a[3] + b[2] * b[3] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def edge_shift(old: tuple[Column, ...], new: tuple[Column, ...]) -> Column:
    """How far a whole footprint (x low, x high, y low, y high) moved: both edges of an axis, the same way."""

    def axis(i: int) -> Column:
        low, high = new[i] - old[i], new[i + 1] - old[i + 1]
        return F.when(low * high > 0, F.least(F.abs(low), F.abs(high))).otherwise(0.0)

    return F.sqrt(axis(0) * axis(0) + axis(2) * axis(2))
