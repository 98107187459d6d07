"""Flags and scores of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import lattice as L
from ..runtime import settled

#: Steps to the ring of a rim, by level.
RING = (15, 7, 1)


def rim_cells(cells: DataFrame, ground: float) -> DataFrame:
    """Keys of deep cells that a neighbour near the ground stands by; only deep cells look for neighbours."""
    deep = cells.where((F.lit(ground) - F.col("h_max") > C.DEEP) & (F.col("hit_count") >= C.RIM_HITS)).select("level", "ix", "iy")
    r = L.by_level(F.col("level"), RING)
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    ring = [(0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)]
    steps = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in near), *(F.struct((r * a).alias("dx"), (r * b).alias("dy")) for a, b in ring))
    looked = deep.withColumn("d", F.explode(steps)).select("level", "ix", "iy", (F.col("ix") + F.col("d.dx")).alias("nx"), (F.col("iy") + F.col("d.dy")).alias("ny"))
    stands = cells.where((F.col("hit_count") > 0) & (F.col("h_max") >= ground - C.RIM)).select(F.col("level").alias("l2"), F.col("ix").alias("x2"), F.col("iy").alias("y2"))
    hit = looked.join(stands, (F.col("level") == F.col("l2")) & (F.col("nx") == F.col("x2")) & (F.col("ny") == F.col("y2")), "left_semi")
    return hit.select("level", "ix", "iy").distinct()


def flag(ground: float, rim: Column) -> Column:
    step, clear = F.col("h_max") - F.col("h_min"), F.col("h_min") - ground
    return F.when(rim, C.NEGATIVE).when(step < C.STEP, C.FLAT).when(clear > C.CLEAR, C.FLAT).when(F.col("h_max") - ground > C.HIGH, C.LETHAL).otherwise(C.ROUGH).cast("int")


def traversability(flagged: Column) -> Column:
    rough = F.sqrt(F.greatest(F.col("h_var"), F.lit(0.0)))
    sure = F.least(F.col("hit_count") / C.FULL_HITS, F.lit(1.0))
    score = sure * (0.5 * F.exp(-5.0 * rough) + 0.5 * L.by_level(F.col("semantic_label"), C.DRIVABLE))
    return F.when(flagged.isin(C.LETHAL, C.NEGATIVE), 0.0).otherwise(score)


def classify(cells: DataFrame, ground: float, only_frame: int | None = None) -> DataFrame:
    """Cells with obstacle_flag and traversability; only_frame: none but those updated in that frame are judged,
    though all count as neighbours.

    Cells that were never hit keep what they have: as free as carving left them, with the score of unseen ground.
    """
    rims = rim_cells(cells, ground).withColumn("rim", F.lit(True))
    judged = cells if only_frame is None else cells.where(F.col("last_update_ts") == only_frame)
    hit = F.col("hit_count") > 0
    free = F.when(F.col("carve_ts") > 0, C.FLAT).otherwise(C.ROUGH) if "carve_ts" in cells.columns else F.lit(C.ROUGH)
    out = judged.join(rims, ["level", "ix", "iy"], "left")
    out = out.withColumn("obstacle_flag", F.when(hit, flag(ground, F.coalesce("rim", F.lit(False)))).otherwise(free).cast("int")).drop("rim")
    return settled(out.withColumn("traversability", F.when(hit, traversability(F.col("obstacle_flag"))).otherwise(C.UNSEEN)))
