"""Further queries: times, rays, audits and windows over tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import asof, clusters, fold, rangeimage, raster
from . import grid
from .grid import _DENSE, _WIDE, _gated, _index, _spread
from .registry import query, r6, sql6
from .views import duck


@query(
    f"""WITH {duck('points')}, scans AS (SELECT seq, seq % 2 AS sensor, seq * 1e-1 AS t FROM points), fixes AS (SELECT seq % 2 AS sensor, seq * 1e-1 + 3e-2 AS t, seq AS fix FROM points WHERE (seq * 7919) % 5 < 2)
  SELECT s.seq, CASE WHEN s.t - f.t <= 5e-1 THEN f.fix END AS fix FROM scans s ASOF LEFT JOIN fixes f ON s.sensor = f.sensor AND s.t >= f.t"""
)
def pose_as_of(t):
    scans = t("points").select("seq", (F.col("seq") % 2).alias("sensor"), (F.col("seq") * 0.1).alias("t"))
    fixes = t("points").where("(seq * 7919) % 5 < 2").select((F.col("seq") % 2).alias("sensor"), (F.col("seq") * 0.1 + 0.03).alias("t"), F.col("seq").alias("fix"))
    return asof.latest_within(scans, fixes, ["sensor"], "t", 0.5, ["fix"]).select("seq", "fix")


@query(
    f"""WITH {duck('points', 'poses')}, {_gated('points', 'poses')}, r AS (SELECT *, CASE WHEN rng <= 1e-3 THEN 0e0 ELSE (CASE level WHEN 0 THEN 0e0 WHEN 1 THEN 10e0 ELSE 25e0 END) / rng END AS f FROM gated)
  SELECT DISTINCT frame_ts, level, {_index('(robot_x + f * (x - robot_x))', 'level')} AS ox, {_index('(robot_y + f * (y - robot_y))', 'level')} AS oy, ix AS hx, iy AS hy FROM r WHERE f < 1"""
)
def ray_endpoints(t):
    return clusters.rays(fold.gate_points(t("points"), t("poses")))


@query(f"WITH {duck('points', 'poses')}, {_gated('points', 'poses')}, k AS (SELECT frame_ts, count(*) AS kept FROM gated GROUP BY frame_ts) SELECT p.frame_ts, count(*) AS points, coalesce(any_value(kept), 0) AS kept FROM points p LEFT JOIN k USING (frame_ts) GROUP BY p.frame_ts")
def insert_counts(t):
    kept = fold.gate_points(t("points"), t("poses")).groupBy("frame_ts").agg(F.count("*").alias("kept"))
    return t("points").groupBy("frame_ts").agg(F.count("*").alias("points")).join(kept, "frame_ts", "left").select("frame_ts", "points", F.coalesce("kept", F.lit(0)).alias("kept"))


@query(
    f"""{_WIDE}, costed AS (SELECT *, 0 AS cost FROM cells), {_spread(0.7, 0.3, 40.0, 0.5)}
  SELECT px, py, semantic_label, last_update_ts FROM (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY last_update_ts DESC, level, ix DESC, iy DESC) AS r FROM pixels) WHERE r = 1"""
)
def paint_order(t):
    spread = raster.footprint(grid.wide_cells(t).select("level", "ix", "iy", "semantic_label", "last_update_ts"), 0.7, 0.3, 40.0, 0.5)
    top = F.max_by(F.struct("semantic_label", "last_update_ts"), F.struct("last_update_ts", -F.col("level"), "ix", "iy")).alias("m")
    return spread.groupBy("px", "py").agg(top).select("px", "py", F.col("m.semantic_label").cast("int").alias("semantic_label"), "m.last_update_ts")


@query(f"WITH {duck('detections')} SELECT det_id, x - dx / 2 AS x0, y - dy / 2 AS y0, x + dx / 2 AS x1, y + dy / 2 AS y1, {sql6('sqrt(dx * dx + dy * dy)', 'speed')}, {sql6('x + dx * 15e-1', 'ahead_x')} FROM detections")
def box_views(t):
    x, y, dx, dy = (F.col(c) for c in ("x", "y", "dx", "dy"))
    return t("detections").select("det_id", (x - dx / 2).alias("x0"), (y - dy / 2).alias("y0"), (x + dx / 2).alias("x1"), (y + dy / 2).alias("y1"), G.planar_speed(dx, dy).alias("speed"), (x + dx * 1.5).alias("ahead_x")).select("det_id", "x0", "y0", "x1", "y1", r6("speed"), r6("ahead_x"))


@query(
    f"""WITH {duck('points')}, q AS (SELECT seq, CAST(least(greatest(round_even(sqrt(x * x + y * y + z * z) / 2e-3, 0), 0), 65535) AS INT) * 2e-3 AS r FROM points), m AS (SELECT avg(r) AS a, greatest(stddev_pop(r), 1e-6) AS s FROM q)
  SELECT seq, {sql6('CASE WHEN r > 0 THEN (r - a) / s ELSE 0e0 END', 'feature')} FROM q, m"""
)
def network_features(t):
    p = t("points").withColumn("range", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    back = rangeimage.quantised(p).select("seq", "range_back")
    one = back.agg(F.avg("range_back").alias("a"), F.greatest(F.stddev_pop("range_back"), F.lit(1e-6)).alias("s"))
    return back.join(F.broadcast(one), F.lit(True)).select("seq", F.when(F.col("range_back") > 0, (F.col("range_back") - F.col("a")) / F.col("s")).otherwise(0.0).alias("feature")).select("seq", r6("feature"))  # one row is broadcast


@query(f"WITH {duck('raws')} SELECT count(*) FILTER (WHERE id % 9 <> 6) AS known, {sql6('avg(CASE WHEN id % 9 = raw % 9 THEN 1e0 ELSE 0e0 END) FILTER (WHERE id % 9 <> 6)', 'agreement')} FROM raws")
def label_agreement(t):
    known = F.col("id") % 9 != 6
    return t("raws").agg(F.count_if(known).alias("known"), F.avg(F.when(known, (F.col("id") % 9 == F.col("raw") % 9).cast("double"))).alias("agreement")).select("known", r6("agreement"))


@query(
    f"""WITH {duck('truth', 'detections')}, m AS (SELECT t.frame_ts, t.truth_id % 40 AS thing, EXISTS (SELECT 1 FROM detections d WHERE d.frame_ts = t.frame_ts AND (t.x - d.x) * (t.x - d.x) + (t.y - d.y) * (t.y - d.y) <= 225e-2) AS hit FROM truth t)
  SELECT thing, min(frame_ts) AS first_seen, min(CASE WHEN hit THEN frame_ts END) - min(frame_ts) AS delay FROM m GROUP BY thing"""
)
def confirm_delay(t):
    truth = t("truth")
    found = clusters.nearest(truth, t("detections"), 1.5, "truth_id", "det_id")
    return found.groupBy((F.col("truth_id") % 40).alias("thing")).agg(F.min("frame_ts").alias("first_seen"), (F.min(F.when(F.col("nearest_det_id").isNotNull(), F.col("frame_ts"))) - F.min("frame_ts")).alias("delay"))


_TRACK = "tracked AS (SELECT frame_ts, det_id, det_id % 30 AS track, x, y FROM detections)"


@query(f"WITH {duck('detections')}, {_TRACK} SELECT det_id, first_value(det_id) OVER w AS oldest, frame_ts - first_value(frame_ts) OVER w AS age FROM tracked WINDOW w AS (PARTITION BY track ORDER BY frame_ts RANGE BETWEEN 10 PRECEDING AND CURRENT ROW)")
def evidence_window(t):
    w = Window.partitionBy("track").orderBy("frame_ts").rangeBetween(-10, 0)
    tracked = t("detections").withColumn("track", F.col("det_id") % 30)
    return tracked.select("det_id", F.first("det_id").over(w).alias("oldest"), (F.col("frame_ts") - F.first("frame_ts").over(w)).alias("age"))


@query(
    f"""WITH {duck('detections')}, {_TRACK}, steps AS (SELECT track, frame_ts, x - lag(x) OVER (PARTITION BY track ORDER BY frame_ts) AS v FROM tracked), l AS (SELECT track, list(v ORDER BY frame_ts) AS v FROM steps WHERE v IS NOT NULL GROUP BY track)
  SELECT track, {sql6('list_reduce(v, lambda a, b: 6e-1 * a + 4e-1 * b)', 'vx')}, len(v) AS n FROM l"""
)
def velocity_smoothing(t):
    # the smoothed value is a weighted sum, so no track is gathered in a row
    w = Window.partitionBy("track").orderBy("frame_ts")
    steps = t("detections").withColumn("track", F.col("det_id") % 30).withColumn("v", F.col("x") - F.lag("x").over(w)).where("v is not null")
    placed = steps.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("track")))
    weight = F.when(F.col("i") == 1, 1.0).otherwise(0.4) * F.pow(F.lit(0.6), F.col("n") - F.col("i"))
    return placed.groupBy("track").agg(F.sum(weight * F.col("v")).alias("vx"), F.count("*").alias("n")).select("track", r6("vx"), "n")


@query(
    f"""{_DENSE}, v AS (SELECT count(*) AS voxels FROM (SELECT DISTINCT floor(x / 5e-2) AS a, floor(y / 5e-2) AS b, floor(z / 5e-2) AS c FROM dense))
  SELECT (SELECT count(*) FROM cells) AS cells, (SELECT count(*) * 40 FROM cells) AS cell_bytes, voxels, CAST(200e0 / 5e-2 * 200e0 / 5e-2 AS BIGINT) * 40 AS flat_bytes FROM v"""
)
def memory_comparison(t):
    cells = grid.dense_cells(t).agg(F.count("*").alias("cells"))
    voxels = t("dense").select(*(F.floor(F.col(c) / 0.05).alias(c) for c in "xyz")).distinct().agg(F.count("*").alias("voxels"))
    return cells.join(F.broadcast(voxels), F.lit(True)).select("cells", (F.col("cells") * 40).alias("cell_bytes"), "voxels", F.lit(4000 * 4000 * 40).cast("long").alias("flat_bytes"))  # one row is broadcast


