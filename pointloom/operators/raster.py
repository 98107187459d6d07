"""Cost grids and images of the map around the robot."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import lattice as L


def stale(frame: int) -> Column:
    return F.lit(frame) - F.col("last_update_ts") > C.STALE_FRAMES


def cost(frame: int) -> Column:
    """0 to 100, or null for a cell that has faded to unknown."""
    sure = F.least(F.col("hit_count") / C.FULL_HITS, F.lit(1.0))
    score = F.when(sure > 0, F.col("traversability") / sure).otherwise(0.0)
    return (
        F.when(F.col("obstacle_flag").isin(C.LETHAL, C.NEGATIVE), 100)
        .when(F.col("hit_count") == 0, 0)
        .when(stale(frame) & (F.col("traversability") < C.FADED), None)
        .when(F.col("semantic_label").isin(4, 5), 100)
        .otherwise(F.round(99.0 * (1.0 - F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))), 0))
        .cast("int")
    )


def footprint(cells: DataFrame, robot_x: float, robot_y: float, size: float = 100.0, res: float = 0.2) -> DataFrame:
    """Each cell once for every pixel (px, py) of the window that it covers; cells outside are dropped first."""
    n = max(1, round(size / res))
    ox, oy = math.floor((robot_x - size / 2) / res) * res, math.floor((robot_y - size / 2) / res) * res
    cs = L.by_level(F.col("level"), C.CELL)
    out = cells
    for p, i, o in (("x", "ix", ox), ("y", "iy", oy)):
        out = out.withColumn(f"_{p}0", F.floor((F.col(i) * cs - o) / res)).withColumn(f"_{p}1", F.floor(((F.col(i) + 1) * cs - o) / res - 1e-4))
    out = out.where(f"_x1 >= 0 and _y1 >= 0 and _x0 < {n} and _y0 < {n}")
    span = lambda p: F.sequence(F.greatest(f"_{p}0", F.lit(0)), F.least(F.greatest(f"_{p}1", f"_{p}0"), F.lit(n - 1)))
    out = out.where("_x1 >= _x0 and _y1 >= _y0")
    return out.withColumn("px", F.explode(span("x"))).withColumn("py", F.explode(span("y"))).drop("_x0", "_x1", "_y0", "_y1")


def cost_raster(cells: DataFrame, robot_x: float, robot_y: float, frame: int, size: float = 100.0, res: float = 0.2) -> DataFrame:
    """(px, py, cost): the greatest cost of the cells over a pixel; pixels without row are unknown."""
    costed = cells.withColumn("cost", cost(frame)).select("level", "ix", "iy", "cost")
    # a filter on the cost before would take the whole expression of it down through every step that it comes from
    return footprint(costed, robot_x, robot_y, size, res).groupBy("px", "py").agg(F.max("cost").alias("cost")).where("cost is not null")


def severity(ground: float) -> Column:
    """0 to 7 for a cell with its cost."""
    return (
        F.when(F.col("hit_count") == 0, 1)
        .when(F.col("obstacle_flag") == C.NEGATIVE, 7)
        .when((F.col("cost") == 100) & (F.col("semantic_label") == 5) & (F.col("obstacle_flag") != C.LETHAL), 5)
        .when(F.col("cost") == 100, 6)
        .when(F.col("obstacle_flag") == C.ROUGH, 4)
        .when(F.col("h_min") - ground > C.CLEAR, 3)
        .otherwise(2)
    )


def _pick(index: Column, colours: tuple, channel: int) -> Column:
    return F.element_at(F.array(*(F.lit(c[channel]) for c in colours)), index)


def severity_image(cells: DataFrame, robot_x: float, robot_y: float, ground: float, frame: int, size: float = 100.0, res: float = 0.2) -> DataFrame:
    """(px, py, severity, r, g, b): the worst cell over a pixel, of equals the one hit last, then the finer; stale cells
    at half brightness."""
    costed = cells.withColumn("cost", cost(frame)).withColumn("severity", F.when(F.col("cost").isNotNull(), severity(ground)))
    tinted = (F.col("severity") == 2) & F.col("semantic_label").between(1, 3)
    shade = F.when(stale(frame), 2).otherwise(1)
    for i, c in enumerate("rgb"):
        plain = F.when(tinted, _pick(F.greatest(F.least("semantic_label", F.lit(3)), F.lit(1)), C.GROUND_RGB, i)).otherwise(_pick(F.col("severity") + 1, C.TERRAIN_RGB, i))
        costed = costed.withColumn(c, F.floor(plain / shade).cast("int"))
    spread = footprint(costed.select("level", "ix", "iy", "severity", "last_update_ts", "r", "g", "b"), robot_x, robot_y, size, res)
    worst = F.max(F.struct("severity", "last_update_ts", (-F.col("level")).alias("finer"), "ix", "iy", "r", "g", "b")).alias("m")  # without severity last
    return spread.groupBy("px", "py").agg(worst).where("m.severity is not null").select("px", "py", "m.severity", "m.r", "m.g", "m.b")


def elevation_colour(cells: DataFrame, ground: float) -> DataFrame:
    """Blue at a metre below ground to red at two above; severity rises with height."""
    t = F.least(F.greatest((F.col("h_max") - ground + 1.0) / 3.0, F.lit(0.0)), F.lit(1.0))
    byte = lambda x: F.round(255.0 * x, 0).cast("int")
    return cells.withColumn("severity", (2 + F.round(t * 250.0, 0)).cast("int")).withColumn("r", byte(F.least(2.0 * t, F.lit(1.0)))).withColumn("g", byte(1.0 - F.abs(2.0 * t - 1.0))).withColumn("b", byte(F.least(2.0 - 2.0 * t, F.lit(1.0))))


def layers(cells: DataFrame, ground: float, frame: int) -> DataFrame:
    """Terrain class, elevation and cost colours of the overview; unseen since carve and hit count as stale."""
    hit = F.col("hit_count") > 0
    up = F.least(F.greatest((F.col("h_max") - ground) / 2.5, F.lit(0.0)), F.lit(1.0))
    sure = F.greatest(F.least(F.col("hit_count") / C.FULL_HITS, F.lit(1.0)), F.lit(1e-3))
    t = F.least(F.greatest(F.col("traversability") / sure, F.lit(0.0)), F.lit(1.0))
    lethal = (F.col("obstacle_flag") == C.LETHAL) | (F.col("semantic_label").isin(4, 5) & hit)
    negative = F.col("obstacle_flag") == C.NEGATIVE
    terrain = (
        F.when(negative, 7).when(~hit, 1).when((F.col("obstacle_flag") == C.LETHAL) | (F.col("semantic_label") == 4), 6)
        .when((F.col("semantic_label") == 5) & (F.col("obstacle_flag") != C.LETHAL), 5).when(F.col("obstacle_flag") == C.ROUGH, 4)
        .when(F.col("h_min") - ground > C.CLEAR, 3).otherwise(2)
    )
    free = lambda c, v: F.when(~hit, v).otherwise(c).cast("int")
    seen = F.greatest("last_update_ts", "carve_ts") if "carve_ts" in cells.columns else F.col("last_update_ts")
    return cells.select(
        "level", "ix", "iy", terrain.cast("int").alias("terrain"),
        free(F.floor(255 * F.least(2 * up, F.lit(1.0))), C.FREE_RGB[0]).alias("elevation_r"),
        free(F.floor(255 * (1 - F.abs(2 * up - 1))), C.FREE_RGB[1]).alias("elevation_g"),
        free(F.floor(255 * F.greatest(1 - 2 * up, F.lit(0.0))), C.FREE_RGB[2]).alias("elevation_b"),
        F.when(negative, C.TERRAIN_RGB[7][0]).when(lethal, 255).when(~hit, 30).otherwise(F.floor(255 * (1 - t))).cast("int").alias("cost_r"),
        F.when(negative, C.TERRAIN_RGB[7][1]).when(lethal, 0).when(~hit, 90).otherwise(F.floor(200 * t)).cast("int").alias("cost_g"),
        (F.lit(frame) - seen > C.STALE_FRAMES).alias("stale"),
    )


def painted(cells: DataFrame, colours: list[str], x: float, y: float, half: float, pixel: float, outline: int, order: list[str]) -> DataFrame:
    """(px, py, colours): the cell drawn last over each pixel of a square around a place, by order and then the finer.

    A cell is as many pixels wide as its size asks for, one at least; those of outline pixels or more have a darker
    right and upper edge, so that the bands show.
    """
    n = max(1, round(2 * half / pixel))
    cs = L.by_level(F.col("level"), C.CELL)
    wide = F.greatest(F.lit(1), F.round(cs / pixel, 0).cast("int"))
    low = lambda i, o: F.floor((F.col(i) * cs - (o - half)) / pixel + 1e-6)
    placed = cells.select(*cells.columns, low("ix", x).alias("_x"), low("iy", y).alias("_y"), wide.alias("_w"))
    placed = placed.where(f"_x + _w > 0 and _y + _w > 0 and _x < {n} and _y < {n}")
    span = lambda c: F.sequence(F.greatest(F.lit(0).cast("long"), F.col(c)), F.least(F.lit(n - 1).cast("long"), F.col(c) + F.col("_w") - 1))
    spread = placed.withColumn("px", F.explode(span("_x"))).withColumn("py", F.explode(span("_y")))
    edge = (F.col("_w") >= outline) & ((F.col("px") == F.col("_x") + F.col("_w") - 1) | (F.col("py") == F.col("_y") + F.col("_w") - 1))
    shaded = [F.when(edge, F.floor(F.col(c) * 0.55)).otherwise(F.col(c)).cast("int").alias(c) for c in colours]
    top = F.max(F.struct(*order, (-F.col("level")).alias("_finer"), "ix", "iy", *shaded)).alias("m")
    return spread.groupBy("px", "py").agg(top).select("px", "py", *(F.col(f"m.{c}").alias(c) for c in colours))
