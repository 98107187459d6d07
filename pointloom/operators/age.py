"""Ageing, fading and eviction of cells, in closed form over any number of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import lattice as L


def ticks(frame: Column, last: Column) -> Column:
    """Decay ticks up to a frame for a cell last hit in another: every DECAY_EVERY frames once it is stale."""
    k = F.floor(frame / C.DECAY_EVERY) - F.floor((last + C.STALE_FRAMES) / C.DECAY_EVERY)
    return F.when(frame >= last + C.STALE_FRAMES + 1, k).otherwise(0).cast("int")


def free_ticks(frame: Column, first: Column) -> Column:
    """The same for a cell that was only carved, first in the given frame: it counts as last hit in frame 0."""
    begun = F.greatest(F.lit(C.STALE_FRAMES), first - 1)
    return F.greatest(F.lit(0), F.floor(frame / C.DECAY_EVERY) - F.floor(begun / C.DECAY_EVERY)).cast("int")


def age(cells: DataFrame, frame: int) -> DataFrame:
    """Scores fade by a tenth a tick; a lethal or negative cell is rough from its first tick, or once carved after its
    last hit if lethal."""
    k = ticks(F.lit(frame), F.col("last_update_ts"))
    carved = F.lit(False)
    if "carve_ts" in cells.columns:
        carved = (F.col("obstacle_flag") == C.LETHAL) & (F.col("carve_ts") > F.col("last_update_ts"))
        k = F.when((F.col("hit_count") == 0) & (F.col("carve_ts") > 0), free_ticks(F.lit(frame), F.col("carve_first"))).otherwise(k)
    faded = F.col("obstacle_flag").isin(C.LETHAL, C.NEGATIVE) & (k >= 1) & (F.col("traversability") * F.pow(F.lit(C.DECAY), k) < C.FADED)
    return cells.withColumn("ticks", k).withColumn("obstacle_flag", F.when(carved | faded, C.ROUGH).otherwise(F.col("obstacle_flag")).cast("int")).withColumn("traversability", F.col("traversability") * F.pow(F.lit(C.DECAY), k))


def keep_radius(margin: float) -> Column:
    return L.by_level(F.col("level"), tuple(r + min(margin, C.MARGIN_SHARE * r) for r in C.OUTER))


def evict(cells: DataFrame, robot_x: float, robot_y: float, margin: float = 20.0) -> DataFrame:
    """Cells whose centre is within their band's radius plus margin."""
    size = L.by_level(F.col("level"), C.CELL)
    dx, dy = (F.col("ix") + 0.5) * size - robot_x, (F.col("iy") + 0.5) * size - robot_y
    return cells.where(dx * dx + dy * dy <= keep_radius(margin) * keep_radius(margin))
