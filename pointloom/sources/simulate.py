"""Made-up scans, the same for the same seed: hashes stand in for random numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import rangeimage


def _noise(seed: int, *keys: Column) -> Column:
    """Uniform in [0, 1) by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 24)) / float(1 << 24)


def beams(spark: SparkSession, frames: int, beams: int = 64, columns: int = 1024, mount: float = 1.2, seed: int = 0) -> DataFrame:
    """Scans of flat ground below a sensor, with some canopy above: one return a beam and column within 0.3 to 100 m."""
    rows = spark.range(frames * beams * columns).select((F.floor(F.col("id") / (beams * columns)) + 1).cast("int").alias("frame_ts"), (F.col("id") % (beams * columns)).alias("seq"))
    pitch = F.radians(22.5 - (F.floor(F.col("seq") / columns) + 0.5) * 45.0 / beams)
    yaw = (F.col("seq") % columns + 0.5) / columns * 2 * math.pi - math.pi
    a, b = _noise(seed, F.col("frame_ts"), F.col("seq")), _noise(seed + 1, F.col("frame_ts"), F.col("seq"))
    down = mount / -F.sin(pitch)
    r = F.when(pitch < -0.005, down * (1 + 0.01 * (a - 0.5))).when(a < 0.2, 3 + 60 * b)
    out = rows.withColumn("range", r).where("range between 0.3 and 100")
    return out.select("frame_ts", "seq", (F.col("range") * F.cos(pitch) * F.cos(yaw)).alias("x"), (F.col("range") * F.cos(pitch) * F.sin(yaw)).alias("y"), (F.col("range") * F.sin(pitch)).alias("z"), F.when(pitch < -0.005, 0).otherwise(3).alias("label"))


def at_time(boxes: DataFrame, t: Column) -> DataFrame:
    """Boxes (name, cx, cy, vx, vy, sx, sy, h, label) moved by their velocity."""
    return boxes.withColumn("cx", F.col("cx") + F.col("vx") * t).withColumn("cy", F.col("cy") + F.col("vy") * t)


def scene(spark: SparkSession, boxes: DataFrame, frames: int, dt: float = 0.1, density: float = 400.0, seed: int = 0, occlusion: bool = True) -> DataFrame:
    """Returns from the faces of boxes that are turned to a sensor at the origin: density falls with the distance, rays
    above or below the field of view are lost, and nearer boxes hide farther ones of the same azimuth."""
    clock = spark.range(1, frames + 1).select(F.col("id").cast("int").alias("frame_ts"))
    placed = at_time(clock.crossJoin(boxes), (F.col("frame_ts") - 1) * dt)  # all pairs by design: every frame shows every box
    faces = placed.withColumn("side", F.explode(F.array(*map(F.lit, (-1, 1))))).withColumn("axis", F.explode(F.array(F.lit("x"), F.lit("y"))))
    half = F.when(F.col("axis") == "x", F.col("sx")).otherwise(F.col("sy")) / 2
    centre = F.when(F.col("axis") == "x", F.col("cx")).otherwise(F.col("cy"))
    wide = F.when(F.col("axis") == "x", F.col("sy")).otherwise(F.col("sx"))
    far = F.greatest(F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy")), F.lit(1.0))
    seen = faces.withColumn("plane", centre + half * F.col("side")).where("plane * side < 0")
    n = F.greatest(F.lit(10), F.floor(density * wide * F.col("h") / far)).cast("int")
    dots = seen.withColumn("k", F.explode(F.sequence(F.lit(1), n)))
    key = [F.col(c) for c in ("frame_ts", "name", "axis", "side", "k")]
    along = (_noise(seed, *key) - 0.5) * wide
    other = F.when(F.col("axis") == "x", F.col("cy")).otherwise(F.col("cx")) + along
    points = dots.select("frame_ts", "name", "label", F.when(F.col("axis") == "x", F.col("plane")).otherwise(other).alias("x"), F.when(F.col("axis") == "x", other).otherwise(F.col("plane")).alias("y"), (_noise(seed + 1, *key) * F.col("h")).alias("z"))
    level = F.abs(F.atan2("z", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))) <= math.radians(22.5)
    points = points.where(level)
    return rangeimage.horizon(points).drop("col", "dist", "nearest") if occlusion else points


# The terrain that scenes stand on.
TRACK, MEADOW = 3.0, 25.0
PUDDLES = ((42.0, -7.0, 5.0, 3.0), (95.0, 9.0, 4.0, 6.0))
WAVE, WAVE_X, WAVE_Y = 0.03, 0.35, 0.25
CURB = (4.0, 4.4, 0.25)


def terrain_label(x: Column, y: Column) -> Column:
    """Track, meadow, open ground, and puddles on any of them."""
    out = F.lit(False)
    for cx, cy, rx, ry in PUDDLES:
        a, b = (x - cx) / rx, (y - cy) / ry
        out = out | (a * a + b * b < 1.0)
    return F.when(out, C.WATER).when(F.abs(y) < TRACK, 1).when(F.abs(y) < MEADOW, 2).otherwise(0).cast("int")


def terrain_height(x: Column, y: Column, ground: float) -> Column:
    """Gentle waves, and a curb beside the track."""
    low, high, step = CURB
    return ground + WAVE * F.sin(WAVE_X * x) * F.cos(WAVE_Y * y) + F.when((y > low) & (y < high), step).otherwise(0.0)


# The scan of the regression drive.
BEAMS, DRIVE_UP, DRIVE_MOUNT, DRIVE_REACH, TREES, NEAR_TREES, FAR_TREES, ROUGHNESS = 64, 22.5, 1.2, 100.0, 0.35, 20.0, 70.0, 0.04


def lcg(seed: Column, k: int) -> Column:
    """A number from 0 to 1 for each seed, by k steps of a linear congruence modulo 2 ** 31."""
    x = F.pmod(seed, F.lit(1 << 31))
    for _ in range(k):
        x = F.pmod(x * 1_103_515_245 % (1 << 31) + 12_345, F.lit(1 << 31))
    return F.floor(x / 256) / float(1 << 23)


def drive_scan(spark: SparkSession, columns: int = 1024) -> DataFrame:
    """One scan (idx, x, y, z, label) of flat ground and a line of trees, as the regression drive sees it in every frame."""
    rows = spark.range(BEAMS * columns).select(F.col("id").alias("idx"), F.floor(F.col("id") / columns).alias("b"), (F.col("id") % columns).alias("c"))
    up = F.radians(-DRIVE_UP + 2 * DRIVE_UP * F.col("b") / (BEAMS - 1.0))
    az = 2.0 * math.pi * F.col("c") / columns
    ground = up < -0.01
    r = F.when(ground, DRIVE_MOUNT / F.tan(-up)).otherwise(NEAR_TREES + FAR_TREES * lcg(F.col("idx") + 7, 4))
    z = F.when(ground, -DRIVE_MOUNT + (lcg(F.col("idx"), 3) - 0.5) * ROUGHNESS).otherwise(r * F.tan(up))
    seen = rows.where(ground | (lcg(F.col("idx") + 3, 5) < TREES)).withColumn("r", r).where(F.col("r") <= DRIVE_REACH)
    return seen.select("idx", (F.col("r") * F.cos(az)).alias("x"), (F.col("r") * F.sin(az)).alias("y"), z.alias("z"), F.when(ground, 0).otherwise(3).alias("label"))


def drive(spark: SparkSession, frames: int, columns: int = 1024, step: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(points, poses) of a drive: the scan as seen from each place, a step further every frame."""
    at = spark.range(1, frames + 1).select(F.col("id").cast("int").alias("frame_ts"), ((F.col("id") - 1) * step).alias("robot_x"), F.lit(0.0).alias("robot_y"), F.lit(-DRIVE_MOUNT).alias("ground_z"))
    seen = at.select("frame_ts", "robot_x").crossJoin(drive_scan(spark, columns))  # all pairs by design: every frame sees the whole scan
    return seen.select("frame_ts", F.col("idx").alias("seq"), (F.col("x") + F.col("robot_x")).alias("x"), "y", "z", "label"), at
