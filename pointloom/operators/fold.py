"""Folding points into cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import lattice as L

KEY = ["level", "ix", "iy"]


def gate_points(points: DataFrame, poses: DataFrame, self_range: float = 0.0) -> DataFrame:
    """Points that count, with their cell: finite, labelled, in range and in the height gate of their frame's pose.

    points: frame_ts, seq (the place in the scan), x, y, z, label; poses: frame_ts, robot_x, robot_y, ground_z.  Frames
    without pose drop out, and so do returns nearer than self_range, which the carrier itself gives.
    """
    finite = F.lit(True)
    for c in ("x", "y", "z"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    known = points.where(finite).withColumn("label", F.when(F.col("label").between(0, 7), F.col("label")).otherwise(C.UNKNOWN).cast("int")).where(F.col("label") != C.DUST)
    placed = known.join(poses, "frame_ts").withColumn("range", L.planar(F.col("x") - F.col("robot_x"), F.col("y") - F.col("robot_y")))
    height = F.col("z") - F.col("ground_z")
    kept = placed.where((height >= L.z_floor(F.col("range"))) & (height <= C.Z_HIGH)).withColumn("level", L.level_of(F.col("range"))).where("level is not null")
    if self_range:
        kept = kept.where(F.col("range") >= self_range)
    return kept.withColumn("ix", L.cell_index(F.col("x"), F.col("level"))).withColumn("iy", L.cell_index(F.col("y"), F.col("level")))


#: Bits of a point's place in its scan, in the stamp that tells which point came last.
SEQ_BITS = 29


def stamp() -> Column:
    """Frame, place in the scan and label as one integer, whose maximum is the last point's: it lives in a hash
    aggregate, which the maximum of a struct does not.  A place that does not fit raises."""
    fits = F.col("seq").between(0, (1 << SEQ_BITS) - 1)
    packed = (F.col("frame_ts").cast("long") * (1 << SEQ_BITS) + F.col("seq")) * 8 + F.col("label")
    return F.when(fits, packed).otherwise(F.raise_error(F.lit(f"seq is not a place in a scan below 2 ** {SEQ_BITS}")).cast("long"))


def label_of(last: Column) -> Column:
    return last.bitwiseAND(7).cast("int")


def frame_of(last: Column) -> Column:
    return F.shiftright(last, SEQ_BITS + 3).cast("int")


def _stats() -> list[Column]:
    z = F.col("z")
    return [F.count("*").alias("hit_count"), F.min(z).alias("h_min"), F.max(z).alias("h_max"), F.avg(z).alias("h_mean")]


_FOLDED = ["hit_count", "h_min", "h_max", "h_mean", "h_var", "semantic_label", "last_update_ts"]


def fold(gated: DataFrame) -> DataFrame:
    """One row per cell; partial sums merge map-side in hash tables, so a cell of very many points is no hot key."""
    out = gated.withColumn("_at", stamp()).groupBy(*KEY).agg(*_stats(), F.coalesce(F.var_samp("z"), F.lit(0.0)).alias("h_var"), F.max("_at").alias("_last"))
    return out.withColumn("semantic_label", label_of(F.col("_last"))).withColumn("last_update_ts", frame_of(F.col("_last"))).select(*KEY, *_FOLDED)


#: Sums of an island of hits: those of two merge without loss of digits.
SUMS = ["hit_count", "h_min", "h_max", "h_mean", "m2", "last", "since"]


def last_island(gated: DataFrame, gap: int = C.STALE_FRAMES) -> DataFrame:
    """For each cell the sums of its last island, i.e. of its hits after the last pause of more than gap frames; since
    is the island's first frame, alone whether the cell has no earlier one.

    Points are first folded to a row per cell and frame; only those rows go through the window.
    """
    by_frame = gated.withColumn("_at", stamp()).groupBy(*KEY, "frame_ts").agg(*_stats(), (F.var_pop("z") * F.count("*")).alias("m2"), F.max("_at").alias("last"))
    w = Window.partitionBy(*KEY).orderBy("frame_ts")
    pause = F.coalesce((F.col("frame_ts") - F.lag("frame_ts").over(w) > gap).cast("int"), F.lit(0))
    islands = by_frame.withColumn("pause", pause).withColumn("island", F.sum("pause").over(w))
    whole = Window.partitionBy(*KEY, "island")
    weighed = islands.withColumn("newest", F.max("island").over(Window.partitionBy(*KEY))).where("island = newest")
    mean = F.sum(F.col("h_mean") * F.col("hit_count")).over(whole) / F.sum("hit_count").over(whole)
    apart = (F.col("h_mean") - F.col("mean")) * (F.col("h_mean") - F.col("mean")) * F.col("hit_count")
    return weighed.withColumn("mean", mean).groupBy(*KEY).agg(
        F.sum("hit_count").alias("hit_count"), F.min("h_min").alias("h_min"), F.max("h_max").alias("h_max"), F.first("mean").alias("h_mean"), F.sum(F.col("m2") + apart).alias("m2"),
        F.max("last").alias("last"), F.min("frame_ts").alias("since"), (F.max("island") == 0).alias("alone"),
    )


def of_sums(sums: DataFrame, *more: str) -> DataFrame:
    """Cells as fold gives them, from sums."""
    n = F.col("hit_count")
    var = F.when(n > 1, F.greatest(F.col("m2"), F.lit(0.0)) / (n - 1)).otherwise(0.0)
    return sums.select(*KEY, n, "h_min", "h_max", "h_mean", var.alias("h_var"), label_of(F.col("last")).alias("semantic_label"), frame_of(F.col("last")).alias("last_update_ts"), *more)


def fold_with_restart(gated: DataFrame, gap: int = C.STALE_FRAMES) -> DataFrame:
    """As fold, but a cell that is hit again after more than gap frames starts anew."""
    return of_sums(last_island(gated, gap))


def merged(old: DataFrame, new: DataFrame, gap: int = C.STALE_FRAMES) -> DataFrame:
    """The sums of earlier frames with those of later ones: a later island continues the earlier one if it is the first
    of its cell and begins within gap frames of its end, else it takes its place."""
    a, b = old.alias("a"), new.select(*KEY, *SUMS, "alone").alias("b")
    both = a.join(b, KEY, "full")
    there, here = F.col("a.hit_count").isNotNull(), F.col("b.hit_count").isNotNull()
    on = there & here & F.col("b.alone") & (F.col("b.since") - frame_of(F.col("a.last")) <= gap)
    n = F.col("a.hit_count") + F.col("b.hit_count")
    step = F.col("b.h_mean") - F.col("a.h_mean")
    of_both = {
        "hit_count": n, "h_min": F.least("a.h_min", "b.h_min"), "h_max": F.greatest("a.h_max", "b.h_max"), "h_mean": F.col("a.h_mean") + step * F.col("b.hit_count") / n,
        "m2": F.col("a.m2") + F.col("b.m2") + step * step * F.col("a.hit_count") * F.col("b.hit_count") / n, "last": F.greatest("a.last", "b.last"), "since": F.col("a.since"),
    }
    return both.select(*KEY, *(F.when(on, v).when(here, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c, v in of_both.items()))


def upsert(cells: DataFrame, carved: DataFrame) -> DataFrame:
    """Cells that were hit, carved or both; what is missing takes the state of a new cell, which is rough until it is
    carved or judged."""
    out = cells.join(carved, KEY, "full")
    fill = {"hit_count": 0, "h_min": 1e9, "h_max": -1e9, "h_mean": 0.0, "h_var": 0.0, "semantic_label": C.UNKNOWN, "last_update_ts": 0, "carve_first": 0, "carve_ts": 0}
    whole = out.select(*KEY, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in fill.items()))
    flag = F.when((F.col("hit_count") == 0) & (F.col("carve_ts") > 0), C.FLAT).otherwise(C.ROUGH).cast("int")
    return whole.withColumn("obstacle_flag", flag).withColumn("traversability", F.lit(C.UNSEEN))


def with_size(cells: DataFrame) -> DataFrame:
    return cells.withColumn("cell_size", L.by_level(F.col("level"), C.CELL))
