"""Range images in long form: one row per pixel that has a return."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .clusters import by_frames

HEIGHT, WIDTH, UP, DOWN = 64, 1024, 22.5, -22.5


def project(points: DataFrame, height: int = HEIGHT, width: int = WIDTH, up: float = UP, down: float = DOWN) -> DataFrame:
    """Points (frame_ts, idx, x, y, z) with pixel (v, u) and range; points at the sensor drop out."""
    v, u, r = G.pixel(F.col("x"), F.col("y"), F.col("z"), height, width, up, down)
    return points.withColumn("range", r).where("range > 1e-6").withColumn("v", v).withColumn("u", u)


def z_buffer(projected: DataFrame, *more: str) -> DataFrame:
    """The nearest return of each pixel; of equal ranges the one with the greatest index.  more: further columns."""
    best = F.max_by(F.struct("idx", "range", "x", "y", "z", "label", *more), F.struct(-F.col("range"), F.col("idx"))).alias("w")
    return projected.groupBy("frame_ts", "v", "u").agg(best).select("frame_ts", "v", "u", "w.*")


def unproject(points: DataFrame, pixels: DataFrame, value: str, fill: int = 255) -> DataFrame:
    """The pixel's value for the point that won it, fill for all others."""
    own = pixels.select("frame_ts", "idx", F.col(value).alias("_v"))
    return points.join(own, ["frame_ts", "idx"], "left").withColumn(value, F.coalesce("_v", F.lit(fill))).drop("_v")


def knn_labels(projected: DataFrame, pixels: DataFrame, k: int = 5, window: int = 5, cutoff: float = 1.0, ignore: int = 255, value: str = "label") -> DataFrame:
    """A label for every point: the majority among the k pixels of its window that are nearest in range.

    Ties in range go by offset, ties in votes to the lower class; ignored labels have no vote; without votes the label
    of the own pixel counts.  The window ends at the image's edges.  Points and pixels of a frame meet in one shuffle;
    a task looks the window of all its points up at once.
    """
    half = window // 2
    steps = [(dv << 20) + du for dv in range(-half, half + 1) for du in range(-half, half + 1)]
    own = projected.select("frame_ts", F.lit(1).alias("point"), "idx", "range", "v", "u", F.lit(None).cast("int").alias("label"))
    image = pixels.where("range > 0").select("frame_ts", F.lit(0).alias("point"), "idx", "range", "v", "u", F.col(value).cast("int").alias("label"))

    def work(rows: pd.DataFrame, frame: np.ndarray) -> pd.DataFrame:
        key = (frame.astype(np.int64) << 40) + ((rows.v.to_numpy(np.int64) + half) << 20) + rows.u.to_numpy(np.int64) + half
        point = rows.point.to_numpy() == 1
        order = np.argsort(key[~point], kind="stable")
        there, reach, label = key[~point][order], rows.range.to_numpy(float)[~point][order], rows.label.to_numpy(float)[~point][order]
        mine, own_range = key[point], rows.range.to_numpy(float)[point]
        gap, seen = np.full((len(mine), len(steps)), np.inf), np.full((len(mine), len(steps)), -1.0)
        for j, step in enumerate(steps if len(there) else ()):
            at = np.searchsorted(there, mine + step)
            at[at == len(there)] = 0
            far = np.abs(reach[at] - own_range)
            fits = (there[at] == mine + step) & (far <= cutoff)
            gap[fits, j], seen[fits, j] = far[fits], label[at[fits]]
        near = np.argsort(gap, 1, kind="stable")[:, :k]
        votes = np.take_along_axis(seen, near, 1)
        valid = np.isfinite(np.take_along_axis(gap, near, 1)) & (votes != ignore)
        count = ((votes[:, :, None] == votes[:, None, :]) & valid[:, None, :]).sum(2)
        best = np.argmax(np.where(valid, count * 1000.0 - votes, -np.inf), 1)
        voted = votes[np.arange(len(votes)), best]
        middle = seen_at(there, label, mine, ignore)
        return pd.DataFrame({"frame_ts": rows.frame_ts[point], "idx": rows.idx[point], value: np.where(valid.any(1), voted, middle).astype(np.int32)})

    def seen_at(there: np.ndarray, label: np.ndarray, mine: np.ndarray, other: int) -> np.ndarray:
        if not len(there):
            return np.full(len(mine), float(other))
        at = np.minimum(np.searchsorted(there, mine), len(there) - 1)
        return np.where(there[at] == mine, label[at], float(other))

    return by_frames(own.unionByName(image), work, f"frame_ts int, idx long, {value} int", ["idx"])


def directions(spark: SparkSession, height: int = HEIGHT, width: int = WIDTH, up: float = UP, down: float = DOWN) -> DataFrame:
    """Unit direction of every pixel centre."""
    cells = spark.range(height * width).select((F.col("id") / width).cast("int").alias("v"), (F.col("id") % width).cast("int").alias("u"))
    pitch = math.radians(up) - (F.col("v") + 0.5) / height * (math.radians(up) - math.radians(down))
    yaw = -((F.col("u") + 0.5) / width * 2.0 - 1.0) * math.pi
    return cells.select("v", "u", (F.cos(pitch) * F.cos(yaw)).alias("dx"), (F.cos(pitch) * F.sin(yaw)).alias("dy"), F.sin(pitch).alias("dz"))


def quantised(pixels: DataFrame, step: float = 0.002, top: int = 65535) -> DataFrame:
    """Range in steps, cut at the top value, intensity in bytes of the frame's greatest where that is over 1.5, and
    both read back."""
    most = F.max("intensity").over(Window.partitionBy("frame_ts"))
    scaled = F.when(most > 1.5, F.col("intensity") / most).otherwise(F.col("intensity"))
    out = pixels.withColumn("intensity_q", F.rint(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))
    steps = F.rint(F.col("range") / step)
    return out.withColumn("saturated", steps > top).withColumn("range_q", F.least(F.greatest(steps, F.lit(0.0)), F.lit(float(top))).cast("int")).withColumn("range_back", F.col("range_q") * step).withColumn("intensity_back", F.col("intensity_q") / 255.0)


def roll_flip(pixels: DataFrame, roll: int, flip: bool, width: int = WIDTH) -> DataFrame:
    """Turns the image by roll columns and, if flip, mirrors it left to right with y."""
    out = pixels.withColumn("u", F.pmod(F.col("u") + roll, F.lit(width)).cast("int"))
    return out.withColumn("u", (width - 1 - F.col("u")).cast("int")).withColumn("y", -F.col("y")) if flip else out


def flipped(pixels: DataFrame, mean: float, std: float, width: int = WIDTH) -> DataFrame:
    """Mirrors an image whose y channel is normalised: y becomes what normalising the mirrored one gives."""
    return pixels.withColumn("u", (width - 1 - F.col("u")).cast("int")).withColumn("y", -F.col("y") - 2.0 * mean / max(std, 1e-6))


def dropped(pixels: DataFrame, channels: list[str], share: float = 0.05, seed: int = 0, drop: Column | None = None, ignore: int = 255) -> DataFrame:
    """Pixels without return: zero in every channel and ignored as label; a share of them by chance, or those named."""
    gone = F.rand(seed) < share if drop is None else drop
    return pixels.withColumn("_gone", gone).select(*(F.when(F.col("_gone"), ignore if c == "label" else 0).otherwise(F.col(c)).cast(dict(pixels.dtypes)[c]).alias(c) if c in (*channels, "label") else c for c in pixels.columns))


def mixed(one: DataFrame, two: DataFrame, bands: int = 4, height: int = HEIGHT, cuts: list[int] | None = None) -> DataFrame:
    """Rows of two images by turns: even bands from the one, odd ones from the other; bands of one height, or cut where
    told."""
    if cuts is None:
        band = F.floor(F.col("v") * bands / height) % 2
    else:
        band = F.lit(0)
        for c in cuts:
            band = band + (F.col("v") >= c).cast("int")
        band = band % 2
    return one.where(band == 0).unionByName(two.where(band == 1))


def mixed_points(one: DataFrame, two: DataFrame, split: float) -> DataFrame:
    """Points of two scans, those below an azimuth from the one and the others from the other."""
    return one.where(F.atan2("y", "x") < split).unionByName(two.where(F.atan2("y", "x") >= split))


def rotated_scaled(points: DataFrame, yaw: float, scale: float, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """Points turned about the upright axis, scaled, and moved by chance in every axis."""
    x, y, c, s = F.col("x"), F.col("y"), math.cos(yaw), math.sin(yaw)
    moved = {"x": (x * c - y * s) * scale, "y": (x * s + y * c) * scale, "z": F.col("z") * scale}
    return points.withColumns({k: v + F.randn(seed + i) * jitter if jitter else v for i, (k, v) in enumerate(moved.items())})


def horizon(points: DataFrame, columns: int = 1024, slack: float = 0.05) -> DataFrame:
    """Returns that no nearer one of their frame and azimuth column hides."""
    col = F.floor((F.atan2("y", "x") / (2 * math.pi) + 0.5) * columns)
    far = points.withColumn("col", F.pmod(col, F.lit(columns)).cast("int")).withColumn("dist", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    return far.withColumn("nearest", F.min("dist").over(Window.partitionBy("frame_ts", "col"))).where(F.col("dist") <= F.col("nearest") + slack)
