"""Queries on chains of operators: movers from points, tracks, objects, messages, shards, segmentation, augmentation."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..functions import geometry as G
from ..operators import classify, clusters, fold, metrics, raster, rangeimage, segment, semantics, tracking
from ..runtime import shared_dir
from ..sources import clouds, simulate
from . import grid
from .grid import _DENSE
from .objects import _KIND, _ramp
from .registry import big, query, r6, sql6
from .scans import _BUFFER, _NEAR, _PIXELS
from .views import duck


def _folder(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


# Tracks ----------------------------------------------------------------------------------------------------------

_KEYS = "sensor_id, drive, det_id"
_SPAN = f"span AS (SELECT {_KEYS}, min(frame_ts) AS f0, max(frame_ts) AS f1 FROM scene GROUP BY {_KEYS})"
#: The filter of each thing frame by frame, axes apart: a, b, c are its covariances of place and speed, d that of size.
_FILTER = f"""st(sensor_id, drive, det_id, f, f1, x, y, w, h, vx, vy, a, b, c, d, since, streak) AS (
    SELECT s.sensor_id, s.drive, s.det_id, f0, f1, cx, cy, dx, dy, 0e0, 0e0, 1e0, 0e0, 10e0, 1e0, 0, 1 FROM span s JOIN scene m ON m.sensor_id = s.sensor_id AND m.drive = s.drive AND m.det_id = s.det_id AND m.frame_ts = s.f0
    UNION ALL SELECT sensor_id, drive, det_id, f + 1, f1, CASE WHEN mx IS NULL THEN px ELSE px + a / (a + 1e-1) * (mx - px) END, CASE WHEN mx IS NULL THEN py ELSE py + a / (a + 1e-1) * (my - py) END,
      CASE WHEN mx IS NULL THEN w ELSE w + d / (d + 1e-1) * (mw - w) END, CASE WHEN mx IS NULL THEN h ELSE h + d / (d + 1e-1) * (mh - h) END,
      CASE WHEN mx IS NULL THEN vx ELSE vx + b / (a + 1e-1) * (mx - px) END, CASE WHEN mx IS NULL THEN vy ELSE vy + b / (a + 1e-1) * (my - py) END,
      CASE WHEN mx IS NULL THEN a ELSE (1 - a / (a + 1e-1)) * a END, CASE WHEN mx IS NULL THEN b ELSE (1 - a / (a + 1e-1)) * b END, CASE WHEN mx IS NULL THEN c ELSE c - b / (a + 1e-1) * b END, CASE WHEN mx IS NULL THEN d ELSE (1 - d / (d + 1e-1)) * d END,
      CASE WHEN mx IS NULL THEN since + 1 ELSE 0 END, (CASE WHEN since > 0 THEN 0 ELSE streak END) + (CASE WHEN mx IS NULL THEN 0 ELSE 1 END)
    FROM (SELECT st.sensor_id, st.drive, st.det_id, f, f1, w, h, vx, vy, since, streak, x + 1e-1 * vx AS px, y + 1e-1 * vy AS py, a + 2e-1 * b + 1e-2 * c + 5e-2 AS a, b + 1e-1 * c AS b, c + 5e-1 AS c, d + 1e-2 AS d, m.cx AS mx, m.cy AS my, m.dx AS mw, m.dy AS mh
      FROM st LEFT JOIN scene m ON m.sensor_id = st.sensor_id AND m.drive = st.drive AND m.det_id = st.det_id AND m.frame_ts = st.f + 1 WHERE f < f1))"""
_STATE = ", ".join(sql6(a, b) for a, b in (("x", "cx"), ("y", "cy"), ("w", "dx"), ("h", "dy"), ("vx", "vx"), ("vy", "vy")))


@query(f"WITH RECURSIVE {duck('scene')}, {_SPAN}, {_FILTER} SELECT {_KEYS}, f AS frame_ts, {_STATE}, {sql6('a', 'p_x')}, {sql6('c', 'p_v')} FROM st WHERE since = 0")
def kalman_filter(t):
    out = tracking.filtered(t("scene"), ("sensor_id", "drive", "det_id"))
    return out.select("sensor_id", "drive", "det_id", "frame_ts", *map(r6, ("cx", "cy", "dx", "dy", "vx", "vy", "p_x", "p_v")))


@query(
    f"""WITH RECURSIVE {duck('scene')}, {_SPAN}, {_FILTER}, n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, drive ORDER BY f0, det_id) - 1 AS track_id, min(f0) OVER (PARTITION BY sensor_id, drive) AS begun FROM span)
  SELECT st.sensor_id, st.drive, f AS frame_ts, track_id, {_STATE} FROM st JOIN n ON n.sensor_id = st.sensor_id AND n.drive = st.drive AND n.det_id = st.det_id WHERE since = 0 AND (streak >= 2 OR f - begun < 2)"""
)
def sort_scene(t):
    return tracking.sort_tracks(t("scene")).select("sensor_id", "drive", "frame_ts", "track_id", *map(r6, ("cx", "cy", "dx", "dy", "vx", "vy")))


_SQUARES = """squares AS (SELECT * EXCLUDE (kx), unnest(range(CAST(floor((cy - dy / 2) / 5e-1) AS BIGINT), CAST(floor((cy + dy / 2) / 5e-1) AS BIGINT) + 1)) AS ky, kx
    FROM (SELECT sensor_id, drive, det_id, frame_ts, cy, dy, unnest(range(CAST(floor((cx - dx / 2) / 5e-1) AS BIGINT), CAST(floor((cx + dx / 2) / 5e-1) AS BIGINT) + 1)) AS kx FROM scene))"""
#: For each sight of a thing its oldest of the last ten frames, and whether the squares left since then are free.
_EVIDENCE = f"""old AS (SELECT a.sensor_id, a.drive, a.det_id, a.frame_ts, min(b.frame_ts) AS o FROM scene a JOIN scene b ON a.sensor_id = b.sensor_id AND a.drive = b.drive AND a.det_id = b.det_id AND b.frame_ts BETWEEN a.frame_ts - 10 AND a.frame_ts GROUP BY ALL),
  {_SQUARES}, gone AS (SELECT old.*, q.kx, q.ky FROM old JOIN squares q ON q.sensor_id = old.sensor_id AND q.drive = old.drive AND q.det_id = old.det_id AND q.frame_ts = old.o
    WHERE sqrt((q.kx + 5e-1) * 5e-1 * (q.kx + 5e-1) * 5e-1 + (q.ky + 5e-1) * 5e-1 * (q.ky + 5e-1) * 5e-1) <= 39 AND NOT EXISTS (SELECT 1 FROM squares p WHERE p.sensor_id = old.sensor_id AND p.drive = old.drive AND p.det_id = old.det_id AND p.frame_ts = old.frame_ts AND p.kx = q.kx AND p.ky = q.ky)),
  taken AS (SELECT DISTINCT sensor_id, drive, frame_ts, kx, ky FROM squares),
  vacated AS (SELECT g.sensor_id, g.drive, g.det_id, g.frame_ts, count(*) AS n, count(s.kx) AS busy FROM gone g LEFT JOIN taken s ON s.sensor_id = g.sensor_id AND s.drive = g.drive AND s.frame_ts = g.frame_ts AND s.kx = g.kx AND s.ky = g.ky GROUP BY ALL),
  evidence AS (SELECT a.*, a.frame_ts - old.o >= 5 AND abs(a.cx - b.cx) >= 8e-1 AND coalesce(v.n, 0) >= 2 AND v.busy <= 25e-2 * v.n AS shown FROM scene a JOIN old ON old.sensor_id = a.sensor_id AND old.drive = a.drive AND old.det_id = a.det_id AND old.frame_ts = a.frame_ts
    JOIN scene b ON b.sensor_id = a.sensor_id AND b.drive = a.drive AND b.det_id = a.det_id AND b.frame_ts = old.o LEFT JOIN vacated v ON v.sensor_id = a.sensor_id AND v.drive = a.drive AND v.det_id = a.det_id AND v.frame_ts = a.frame_ts)"""
_MOVING = """mv(sensor_id, drive, det_id, f, f1, x, vx, hits, streak, sure, seen) AS (
    SELECT s.sensor_id, s.drive, s.det_id, f0, f1, cx, 0e0, 1, 0, false, false FROM span s JOIN scene m ON m.sensor_id = s.sensor_id AND m.drive = s.drive AND m.det_id = s.det_id AND m.frame_ts = s.f0
    UNION ALL SELECT sensor_id, drive, det_id, f + 1, f1, CASE WHEN mx IS NULL THEN x + vx * 1e-1 ELSE mx END, v, CASE WHEN mx IS NULL THEN hits ELSE hits + 1 END,
      CASE WHEN mx IS NULL THEN streak WHEN shown AND abs(v) > 1 THEN streak + 1 ELSE 0 END, CASE WHEN mx IS NULL THEN sure WHEN shown AND abs(v) > 1 THEN sure OR streak >= 2 ELSE sure AND abs(v) >= 5e-1 END, mx IS NOT NULL
    FROM (SELECT mv.*, m.cx AS mx, coalesce(m.shown, false) AS shown, CASE WHEN m.cx IS NULL THEN vx WHEN hits = 1 THEN (m.cx - x) / 1e-1 ELSE 6e-1 * vx + 4e-1 * ((m.cx - x) / 1e-1) END AS v
      FROM mv LEFT JOIN evidence m ON m.sensor_id = mv.sensor_id AND m.drive = mv.drive AND m.det_id = mv.det_id AND m.frame_ts = mv.f + 1 WHERE f < f1))"""


@query(
    f"""WITH RECURSIVE {duck('scene')}, {_SPAN}, {_EVIDENCE}, {_MOVING}, n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, drive ORDER BY f0, det_id) AS track_id FROM span)
  SELECT mv.sensor_id, mv.drive, f AS frame_ts, track_id, mv.det_id, {sql6('x', 'cx')}, {sql6('vx', 'vx')}, CAST(f - f0 + 1 AS BIGINT) AS age FROM mv JOIN n ON n.sensor_id = mv.sensor_id AND n.drive = mv.drive AND n.det_id = mv.det_id WHERE seen AND sure"""
)
def mover_scene(t):
    return tracking.movers(t("scene")).select("sensor_id", "drive", "frame_ts", "track_id", "det_id", r6("cx"), r6("vx"), "age")


_CANDIDATES = """cand AS (SELECT d.frame_ts, seq, x * 4 AS x, y * 4 AS y, z, robot_x, robot_y FROM dense d JOIN poses USING (frame_ts)
    WHERE z - ground_z BETWEEN 3e-1 AND 25e-1 AND sqrt((x * 4 - robot_x) * (x * 4 - robot_x) + (y * 4 - robot_y) * (y * 4 - robot_y)) <= 40)"""


def _candidates(t):
    spread = t("dense").withColumns({"x": F.col("x") * 4, "y": F.col("y") * 4})
    return tracking.candidates(spread, t("poses"), by=())


@query(f"WITH {duck('dense', 'poses')}, {_CANDIDATES} SELECT frame_ts, seq, x, y, z FROM cand")
def mover_candidates(t):
    return _candidates(t).select("frame_ts", "seq", "x", "y", "z")


@query(
    f"""WITH RECURSIVE {duck('dense', 'poses')}, {_CANDIDATES}, own AS (SELECT *, CAST(floor((x - robot_x + 40) / 2e-1) AS BIGINT) AS kx, CAST(floor((y - robot_y + 40) / 2e-1) AS BIGINT) AS ky FROM cand), cell AS (SELECT DISTINCT frame_ts, kx, ky, kx * 100000 + ky AS k FROM own),
  step AS (SELECT a.frame_ts, a.k AS i, b.k AS j FROM cell a JOIN cell b ON a.frame_ts = b.frame_ts AND abs(a.kx - b.kx) <= 3 AND abs(a.ky - b.ky) <= 3),
  reach(frame_ts, i, r) AS (SELECT frame_ts, k, k FROM cell UNION SELECT step.frame_ts, step.j, reach.r FROM reach JOIN step ON step.frame_ts = reach.frame_ts AND step.i = reach.i),
  root AS (SELECT frame_ts, i, min(r) AS r FROM reach GROUP BY frame_ts, i), numbered AS (SELECT *, dense_rank() OVER (PARTITION BY frame_ts ORDER BY r) - 1 AS det_id FROM root),
  g AS (SELECT o.frame_ts, n.det_id, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, count(*) AS n_points, count(DISTINCT CAST(floor(x / 5e-1) * 1000 + floor(y / 5e-1) AS BIGINT)) AS n_cells, min(z) AS z_lo, max(z) AS z_hi
    FROM own o JOIN numbered n ON n.frame_ts = o.frame_ts AND n.i = o.kx * 100000 + o.ky GROUP BY o.frame_ts, n.det_id)
  SELECT frame_ts, det_id, {sql6('(x_lo + x_hi) / 2', 'cx')}, {sql6('(y_lo + y_hi) / 2', 'cy')}, {sql6('greatest(x_hi - x_lo, 1e-1)', 'dx')}, {sql6('greatest(y_hi - y_lo, 1e-1)', 'dy')}, n_points, CAST(n_cells AS INT) AS n_cells, z_lo, z_hi
  FROM g WHERE n_points >= 8 AND x_hi - x_lo <= 7 AND y_hi - y_lo <= 7"""
)
def mover_detections(t):
    return tracking.detections(_candidates(t), by=()).select("frame_ts", "det_id", *map(r6, ("cx", "cy", "dx", "dy")), "n_points", F.size("cells").alias("n_cells"), "z_lo", "z_hi")


@query()
def movers_of_points(t):
    """Points of things that move and stand, from candidates to confirmed movers."""
    things = t("scene").where("sensor_id = 0")
    grid = F.explode(F.sequence(F.lit(0), F.lit(23)))
    points = things.select("sensor_id", "drive", "frame_ts", "cx", "cy", "dx", "dy", F.col("det_id"), grid.alias("k"))
    x, y = F.col("cx") + (F.col("k") % 6 / 5.0 - 0.5) * F.col("dx"), F.col("cy") + (F.floor(F.col("k") / 6) / 3.0 - 0.5) * F.col("dy")
    points = points.select("sensor_id", "drive", "frame_ts", (F.col("det_id") * 100 + F.col("k")).alias("seq"), x.alias("x"), y.alias("y"), (F.col("k") / 20.0 + 0.2).alias("z"))
    poses = things.select("sensor_id", "drive", "frame_ts").distinct().withColumns({"robot_x": F.lit(0.0), "robot_y": F.lit(0.0), "ground_z": F.lit(-0.2)})
    return tracking.movers_of_points(points, poses)


# Objects ---------------------------------------------------------------------------------------------------------

_SURE = f"CASE obj_class WHEN 3 THEN {_ramp('tall', '3e0', '8e0')} WHEN 4 THEN {_ramp('slim', '3e0', '10e0')} WHEN 1 THEN {_ramp('tall', '11e-1', '4e0')} WHEN 2 THEN {_ramp('least(lg / 18e-1, sh / 11e-1)', '1e0', '25e-1')} WHEN 5 THEN 4e-1 ELSE 0e0 END"
_OF_BOUNDS = f"""e AS (SELECT *, greatest(length, width) AS lg, least(length, width) AS sh FROM b), s AS (SELECT *, lg / greatest(sh, 1e-3) AS slim, height / greatest(lg, 1e-3) AS tall FROM e), k AS (SELECT *, {_KIND} AS obj_class FROM s)"""


@query(
    f"""WITH {duck('extents')}, b AS (SELECT id, (id % 7 + length) - id % 7 AS length, (id % 3 + width) - id % 3 AS width, (2 + height) - 2 AS height FROM extents), {_OF_BOUNDS}
  SELECT id, obj_class, {sql6(_SURE, 'confidence')} FROM k"""
)
def box_class_of_bounds(t):
    b = t("extents").select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"), F.lit(2.0).alias("z"), "length", "width", "height")
    kind, sure = G.box_class(F.col("x"), F.col("y"), F.col("z"), F.col("x") + F.col("length"), F.col("y") + F.col("width"), F.col("z") + F.col("height"))
    return b.select("id", kind.alias("obj_class"), sure.alias("confidence")).select("id", "obj_class", r6("confidence"))


def _clustered(where: str, eps: str, least: int, key: str = "frame_ts") -> str:
    return f"""own AS (SELECT * FROM dense WHERE {where}), near AS (SELECT a.{key}, a.seq AS i, b.seq AS j FROM own a JOIN own b ON a.{key} = b.{key} AND a.label = b.label AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= CAST({eps} * {eps} AS DOUBLE)),
  core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= {least}), step AS (SELECT i, j FROM near WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
  reach(i, r) AS (SELECT i, i FROM core UNION SELECT step.j, reach.r FROM reach JOIN step ON step.i = reach.i), name AS (SELECT i, min(r) AS c FROM reach GROUP BY i),
  edge AS (SELECT near.i, min(name.c) AS c FROM near JOIN name ON name.i = near.j WHERE near.i NOT IN (SELECT i FROM core) GROUP BY near.i), named AS (SELECT * FROM name UNION ALL SELECT * FROM edge),
  g AS (SELECT frame_ts, label, c AS cluster, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, min(z) AS z_lo, max(z) AS z_hi, avg(x) AS x_mean, avg(y) AS y_mean, count(*) AS n_points FROM own JOIN named ON named.i = own.seq GROUP BY frame_ts, label, c)"""


@query(
    f"""WITH RECURSIVE {duck('dense')}, {_clustered('label = 4', '8e-1', 4)}, b AS (SELECT *, x_hi - x_lo AS length, y_hi - y_lo AS width, z_hi - z_lo AS height FROM g), {_OF_BOUNDS}
  SELECT frame_ts, cluster, n_points, {sql6('x_mean', 'cx')}, {sql6('greatest(length, 1e-1)', 'dx')}, {sql6('greatest(width, 1e-1)', 'dy')}, obj_class, {sql6(_SURE, 'obj_conf')} FROM k"""
)
def hard_object_boxes(t):
    out = clusters.hard_objects(t("dense"), C.OBSTACLE, 0.8, 4)
    return out.withColumn("cx", F.col("x_mean")).select("frame_ts", "cluster", "n_points", r6("cx"), r6("dx"), r6("dy"), "obj_class", r6("obj_conf"))


@query(
    f"""WITH RECURSIVE {duck('dense')}, {_clustered('label BETWEEN 1 AND 3', '6e-1', 4)}
  SELECT frame_ts, CAST(label AS INT) AS obj_class, cluster, {sql6('x_mean', 'cx')}, {sql6('greatest(x_hi - x_lo, 3e-1)', 'size_x')}, {sql6('greatest(z_hi - z_lo, 3e-1)', 'size_z')}, {sql6('z_hi + 6e-1', 'text_z')}, (CASE label WHEN 1 THEN 'person' WHEN 2 THEN 'vehicle' ELSE 'pole' END) || ' (' || n_points || ' pts)' AS caption FROM g"""
)
def semantic_markers(t):
    points = t("dense").withColumn("obj_class", F.when(F.col("label").between(1, 3), F.col("label")).otherwise(0))
    return clouds.object_markers(points, 10**6, 0.6, 4).select("frame_ts", "obj_class", "cluster", r6("cx"), r6("size_x"), r6("size_z"), r6("text_z"), "caption")


@query(f"WITH {duck('truth', 'detections')} SELECT d.frame_ts, d.det_id FROM detections d WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.frame_ts = d.frame_ts AND (t.x - d.x) * (t.x - d.x) + (t.y - d.y) * (t.y - d.y) <= 9e0)")
def static_false_positives(t):
    return clusters.nearest(t("detections"), t("truth"), 3.0, "det_id", "truth_id").where("nearest_truth_id is null").select("frame_ts", "det_id")


_CLASSED = "c AS (SELECT CAST(id % 6 AS INT) AS true_class, CAST((id * 7 + raw) % 6 AS INT) AS found_class, CAST((id * 37) % 100 AS DOUBLE) AS range FROM raws)"


def _classed(t):
    return t("raws").select((F.col("id") % 6).cast("int").alias("true_class"), ((F.col("id") * 7 + F.col("raw")) % 6).cast("int").alias("found_class"), ((F.col("id") * 37) % 100).cast("double").alias("range"))


@query(f"WITH {duck('raws')}, {_CLASSED} SELECT CASE WHEN range < 10 THEN 0 WHEN range < 25 THEN 1 WHEN range < 40 THEN 2 WHEN range < 100 THEN 3 END AS range_bin, count(*) AS n, {sql6('avg(CASE WHEN true_class = found_class THEN 1e0 ELSE 0e0 END)', 'accuracy')} FROM c GROUP BY 1")
def object_accuracy_by_range(t):
    return metrics.object_scores(_classed(t)).select("range_bin", "n", r6("accuracy"))


@query(f"WITH {duck('raws')}, {_CLASSED} SELECT true_class AS gt, found_class AS pred, count(*) AS n FROM c GROUP BY 1, 2")
def object_confusion(t):
    return metrics.confusion(_classed(t).toDF("gt", "pred", "range"))


_FINE13 = "f AS (SELECT CAST(id % 13 AS INT) AS gt, CAST((id * 5 + raw) % 13 AS INT) AS pred, CAST((id * 7919) % 13 AS INT) AS chance FROM raws)"


def _fine13(t):
    return t("raws").select((F.col("id") % 13).cast("int").alias("gt"), ((F.col("id") * 5 + F.col("raw")) % 13).cast("int").alias("pred"), ((F.col("id") * 7919) % 13).cast("int").alias("chance"))


@query(f"WITH {duck('raws')}, {_FINE13} SELECT gt, pred, count(*) AS n FROM f GROUP BY 1, 2")
def fine_confusion(t):
    return metrics.confusion(_fine13(t))


@query(f"WITH {duck('raws')}, {_FINE13} SELECT {sql6('avg(CASE WHEN gt = pred THEN 1e0 ELSE 0e0 END)', 'model')}, {sql6('avg(CASE WHEN gt = chance THEN 1e0 ELSE 0e0 END)', 'chance')} FROM f")
def random_baseline(t):
    own = _fine13(t)
    share = lambda c, name: F.avg((F.col("gt") == F.col(c)).cast("double")).alias(name)
    return own.agg(share("pred", "model"), share("chance", "chance")).select(r6("model"), r6("chance"))


_PIXEL = "floor((i{c} * (CASE level WHEN 0 THEN 5e-2 WHEN 1 THEN 1e-1 ELSE 5e-1 END) - ({o} - 6e-1)) / 1e-2 + 1e-6)"


@query(
    f"""{_DENSE}, p AS (SELECT *, CAST({_PIXEL.format(c='x', o='3e-1')} AS BIGINT) AS x0, CAST({_PIXEL.format(c='y', o='2e-1')} AS BIGINT) AS y0, CASE level WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 50 END AS w FROM cells),
  s AS (SELECT * EXCLUDE (px), px, unnest(range(greatest(y0, 0), least(y0 + w - 1, 119) + 1)) AS py FROM (SELECT *, unnest(range(greatest(x0, 0), least(x0 + w - 1, 119) + 1)) AS px FROM p WHERE x0 + w > 0 AND y0 + w > 0 AND x0 < 120 AND y0 < 120)),
  r AS (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY last_update_ts DESC, level, ix DESC, iy DESC) AS n FROM s)
  SELECT px, py, CAST(CASE WHEN px = x0 + w - 1 OR py = y0 + w - 1 THEN floor(semantic_label * 30 * 55e-2) ELSE semantic_label * 30 END AS INT) AS shade FROM r WHERE n = 1"""
)
def paint_outlined(t):
    cells = grid.dense_cells(t).withColumn("shade", F.col("semantic_label") * 30)
    return raster.painted(cells, ["shade"], 0.3, 0.2, 0.6, 0.01, 5, ["last_update_ts"])


@query(f"{_DENSE} SELECT ix, iy, level, CAST(semantic_label AS INT) AS semantic_label, h_min, h_max, hit_count, last_update_ts, CASE level WHEN 0 THEN 5e-2 WHEN 1 THEN 1e-1 ELSE 5e-1 END AS cell_size FROM cells")
def cell_snapshot(t):
    place = _folder(t, "snapshot")
    clouds.write_cells(fold.with_size(classify.classify(grid.dense_cells(t), grid.GROUND)), place)
    return t.spark.read.parquet(place).select("ix", "iy", "level", "semantic_label", "h_min", "h_max", "hit_count", "last_update_ts", "cell_size")


@query(f"WITH {duck('scene')} SELECT sensor_id, frame_ts, det_id, {sql6('cx + dx * (frame_ts * 1e-1)', 'cx')}, {sql6('cy - dy * (frame_ts * 1e-1)', 'cy')} FROM scene")
def constant_velocity(t):
    moved = simulate.at_time(t("scene").withColumn("vx", F.col("dx")).withColumn("vy", -F.col("dy")), F.col("frame_ts") * 0.1)
    return moved.select("sensor_id", "frame_ts", "det_id", r6("cx"), r6("cy"))


# Scans, messages and shards --------------------------------------------------------------------------------------

@query(
    f"""WITH {duck('dense')}, {_NEAR}, {_PIXELS.format('near').replace('* 64), 0), 63)', '* 16), 0), 15)').replace('* 1024), 0), 1023)', '* 64), 0), 63)')}, {_BUFFER},
  fine AS (SELECT *, CASE WHEN z < -5e-1 THEN 0 WHEN z < 0 THEN 2 WHEN z < 5e-1 THEN 3 WHEN z < 1 THEN 5 WHEN z < 15e-1 THEN 6 ELSE 8 END AS fine FROM image),
  px AS (SELECT * EXCLUDE (label), CASE fine WHEN 0 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END AS label, CASE fine WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 8 THEN 1 ELSE 0 END AS obj,
    (exp(4e0) + (CASE fine WHEN 0 THEN 0e0 WHEN 2 THEN 0e0 WHEN 3 THEN 0e0 ELSE 5e0 END)) / (exp(4e0) + 11e0) AS conf FROM fine),
  seen AS (SELECT p.frame_ts, p.idx, abs(i.rng - p.rng) AS gap, i.v - p.v AS dv, i.u - p.u AS du, i.label, i.obj FROM proj p JOIN px i ON i.frame_ts = p.frame_ts AND i.v BETWEEN p.v - 2 AND p.v + 2 AND i.u BETWEEN p.u - 2 AND p.u + 2 AND abs(i.rng - p.rng) <= 1e0),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_ts, idx ORDER BY gap, dv, du) AS r FROM seen) WHERE r <= 5),
  labels AS (SELECT frame_ts, idx, label FROM (SELECT frame_ts, idx, label, row_number() OVER (PARTITION BY frame_ts, idx ORDER BY count(*) DESC, label) AS r FROM best GROUP BY frame_ts, idx, label) WHERE r = 1),
  objects AS (SELECT frame_ts, idx, obj FROM (SELECT frame_ts, idx, obj, row_number() OVER (PARTITION BY frame_ts, idx ORDER BY count(*) DESC, obj) AS r FROM best GROUP BY frame_ts, idx, obj) WHERE r = 1)
  SELECT n.frame_ts, n.idx, CASE WHEN w.conf IS NULL AND coalesce(l.label, h.label, 255) = 0 THEN 6 ELSE coalesce(l.label, h.label, 255) END AS label, CASE WHEN w.conf IS NULL THEN 0 ELSE coalesce(o.obj, h.obj, 255) END AS obj_class, {sql6('coalesce(w.conf, 0e0)', 'confidence')}
  FROM proj n LEFT JOIN px h ON h.frame_ts = n.frame_ts AND h.v = n.v AND h.u = n.u LEFT JOIN labels l ON l.frame_ts = n.frame_ts AND l.idx = n.idx LEFT JOIN objects o ON o.frame_ts = n.frame_ts AND o.idx = n.idx LEFT JOIN px w ON w.frame_ts = n.frame_ts AND w.idx = n.idx"""
)
def segment_scan(t):
    near = t("dense").withColumn("frame_ts", F.expr("cast(seq div 500 + 1 as int)"))
    return segment.segment(near, semantics.stub_logits, 16, 64).select("frame_ts", "idx", "label", "obj_class", r6("confidence"))


_CHANNELS = ("rng", "x", "y", "z", "intensity")


@query(
    f"""WITH {duck('points')}, q AS (SELECT seq, sqrt(x * x + y * y + z * z) AS rng, x, y, z, intensity, raw FROM (SELECT *, CAST(label * 3 - 2 AS INT) AS raw FROM points) WHERE seq % 11 <> 0 UNION ALL SELECT seq, 0e0, 0e0, 0e0, 0e0, 0e0, 3 FROM points WHERE seq % 11 = 0),
  m AS (SELECT {', '.join(f'avg({c}) AS a_{c}, greatest(stddev_pop({c}), 1e-6) AS s_{c}' for c in _CHANNELS)} FROM q WHERE rng > 0)
  SELECT seq, {', '.join(sql6(f'CASE WHEN rng > 0 THEN ({c} - a_{c}) / s_{c} ELSE 0e0 END', f'f_{c}') for c in _CHANNELS)}, CASE WHEN raw BETWEEN 0 AND 11 THEN raw ELSE 255 END AS label FROM q, m"""
)
def network_channels(t):
    p = t("points").withColumn("rng", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).withColumn("label", (F.col("label") * 3 - 2).cast("int"))
    gone = F.col("seq") % 11 == 0
    p = p.select("seq", *(F.when(gone, 0.0).otherwise(F.col(c)).alias(c) for c in _CHANNELS), F.when(gone, 3).otherwise(F.col("label")).alias("label"))
    norm = metrics.moments(p.where("rng > 0"), list(_CHANNELS)).first()  # one row
    mean, std = ({c if c != "rng" else "range": norm[f"{c}_{k}"] for c in _CHANNELS} for k in ("mean", "std"))
    out = segment.normalised(p.withColumnRenamed("rng", "range"), mean, std).withColumnRenamed("f_range", "f_rng")
    return out.select("seq", *(r6(f"f_{c}") for c in _CHANNELS), "label")


def _records(t):
    kind = (F.col("seq") % 6).cast("int")
    return t("points").select("frame_ts", (F.col("seq") % 50).cast("int").alias("seq"), *(F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "intensity")), F.col("label").cast("int").alias("label"), kind.alias("obj_class"), (F.col("seq") % 10 / 10.0).cast("float").alias("conf"))


@query(f"WITH {duck('points')} SELECT frame_ts, CAST(seq % 50 AS BIGINT) AS seq, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, CAST(label AS INT) AS label FROM points")
def labelled_cloud(t):
    return clouds.decode_messages(clouds.packed(_records(t))).select("frame_ts", "seq", "x", "y", "z", "label")


@query(f"WITH {duck('points')} SELECT frame_ts, CAST(x AS FLOAT) AS x, CAST(z AS FLOAT) AS z, CAST(label AS INT) AS label, count(*) AS n FROM points WHERE seq % 50 % 7 <> 3 GROUP BY ALL")
def filtered_cloud(t):
    records = _records(t)
    left = clouds.without_points(clouds.packed(records), records.where("seq % 7 = 3").select("frame_ts", "seq"))
    return clouds.decode_messages(left).groupBy("frame_ts", "x", "z", "label").agg(F.count("*").alias("n"))


@query(f"WITH {duck('points')} SELECT CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, CAST(label AS SMALLINT) AS label, count(*) AS n FROM points WHERE frame_ts <= 40 GROUP BY ALL")
def csv_scene(t):
    place = _folder(t, "scene")
    t("points").where("frame_ts <= 40").select("x", "y", "z", "label").write.option("header", True).csv(place)
    return clouds.read_csv(t.spark, place).groupBy("x", "y", "z", "label").agg(F.count("*").alias("n"))


@query(
    f"""WITH {duck('points')}, {_PIXELS.format('points')}, {_BUFFER}, q AS (SELECT frame_ts, v, u, label, CAST(least(greatest(round_even(rng / 2e-3, 0), 0), 65535) AS INT) AS range_q FROM image)
  SELECT 's' || frame_ts % 5 AS seq, frame_ts, v, u, {sql6('range_q * 2e-3', 'range')}, CAST(label AS INT) AS label, range_q > 0 AS mask FROM q"""
)
def range_cache_round_trip(t):
    place = _folder(t, "shards")
    image = rangeimage.z_buffer(rangeimage.project(t("points")), "intensity")
    shards = rangeimage.quantised(image).select(F.lit("train").alias("split"), F.concat(F.lit("s"), F.col("frame_ts") % 5).alias("seq"), "frame_ts", "v", "u", "range_q", "intensity_q", F.col("label").cast("int").alias("label"))
    clouds.write_shards(shards.where("seq < 's3'"), place)
    clouds.write_shards(shards, place)  # goes on with what is not done
    return clouds.read_shards(t.spark, place).select("seq", "frame_ts", "v", "u", r6("range"), "label", "mask")


_PATHS = "paths AS (SELECT DISTINCT '/d/0000' || frame_ts % 4 || '/' || (CASE WHEN seq % 2 = 0 THEN 'os1_cloud_node_kitti_bin' ELSE 'vel_cloud_node_kitti_bin' END) || '/' || lpad(CAST(frame_ts AS VARCHAR), 6, '0') || '.bin' AS path FROM points)"


def _paths(t):
    name = F.when(F.col("seq") % 2 == 0, "os1_cloud_node_kitti_bin").otherwise("vel_cloud_node_kitti_bin")
    return t("points").select(F.concat(F.lit("/d/0000"), F.col("frame_ts") % 4, F.lit("/"), name, F.lit("/"), F.lpad(F.col("frame_ts").cast("string"), 6, "0"), F.lit(".bin")).alias("path")).distinct()


@query(f"WITH {duck('points')}, {_PATHS} SELECT path, 'first' AS side FROM (SELECT path FROM paths ORDER BY path LIMIT 7) UNION ALL SELECT path, 'last' FROM (SELECT path FROM paths ORDER BY path DESC LIMIT 5)")
def first_and_last_scans(t):
    files = _paths(t)
    return clouds.first_scans(files, 7).withColumn("side", F.lit("first")).unionByName(clouds.last_scans(files, 5).withColumn("side", F.lit("last")))


@query(f"WITH {duck('points')}, {_PATHS} SELECT split_part(path, '/', 3) AS seq, split_part(path, '/', 4) AS folder, 'bin' AS suffix, count(*) AS files FROM paths GROUP BY 1, 2")
def layout_audit(t):
    return clouds.layout(_paths(t))


@query(f"WITH {duck('points')}, s AS (SELECT frame_ts % 3 AS k FROM points) SELECT CAST(k + 1 AS INT) AS columns, count(*) AS lines FROM s GROUP BY 1")
def split_audit(t):
    lines = t("points").select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.col("frame_ts") % 3), lambda i: F.concat(F.lit("c"), i)), F.lit("# note")).alias("value"))
    return clouds.split_layout(lines)


@query(f"WITH {duck('points')}, {_PATHS}, s AS (SELECT *, split_part(path, '/', 3) AS seq, split_part(split_part(path, '/', 5), '.', 1) AS scan FROM paths) SELECT path, '/d/' || seq || (CASE WHEN CAST(scan AS INT) % 3 = 0 THEN '/labels/' ELSE '/os1_cloud_node_semantickitti_label_id/' END) || scan || '.label' AS label_path FROM s WHERE path LIKE '%os1%'")
def label_preference(t):
    scans = _paths(t).where("path like '%os1%'").select("path", clouds.sequence_of(F.col("path")).alias("seq"), F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("scan"))
    number = F.col("scan").cast("int")
    at = lambda folder: F.concat(F.lit("/d/"), F.col("seq"), F.lit(f"/{folder}/"), F.col("scan"), F.lit(".label")).alias("path")
    real, beside = scans.where(number % 3 == 1).select(at(clouds.LABEL_FOLDERS[0])), scans.where(number % 3 != 2).select(at(clouds.LABEL_FOLDERS[1]))
    return clouds.with_labels(scans, real.unionByName(beside)).select("path", "label_path")


# Augmentation and fixtures ---------------------------------------------------------------------------------------

@query(f"WITH {duck('points')} SELECT seq FROM points WHERE (seq % 2 = 0 AND atan2(y, x) < 4e-1) OR (seq % 2 = 1 AND atan2(y, x) >= 4e-1)")
def lasermix_points(t):
    points = t("points")
    return rangeimage.mixed_points(points.where("seq % 2 = 0"), points.where("seq % 2 = 1"), 0.4).select("seq")


_COS, _SIN = f"({math.cos(0.7)!r}::DOUBLE)", f"({math.sin(0.7)!r}::DOUBLE)"


@query(f"WITH {duck('points')} SELECT seq, {sql6(f'(x * {_COS} - y * {_SIN}) * 102e-2', 'x')}, {sql6(f'(x * {_SIN} + y * {_COS}) * 102e-2', 'y')}, {sql6('z * 102e-2', 'z')} FROM points")
def rotate_scale(t):
    return rangeimage.rotated_scaled(t("points"), 0.7, 1.02).select("seq", r6("x"), r6("y"), r6("z"))


@query(f"WITH {duck('points')}, {_PIXELS.format('points')} SELECT seq, CASE WHEN (v * 31 + u * 17) % 20 = 0 THEN 0e0 ELSE x END AS x, {sql6('CASE WHEN (v * 31 + u * 17) % 20 = 0 THEN 0e0 ELSE rng END', 'range')}, CASE WHEN (v * 31 + u * 17) % 20 = 0 THEN 255 ELSE CAST(label AS INT) END AS label FROM proj")
def image_dropout(t):
    image = rangeimage.project(t("points"))
    return rangeimage.dropped(image, ["range", "x", "y", "z"], drop=(F.col("v") * 31 + F.col("u") * 17) % 20 == 0).select("seq", "x", r6("range"), F.col("label").cast("int").alias("label"))


@query(f"WITH {duck('points')}, {_PIXELS.format('points')} SELECT seq, 1023 - u AS u, {sql6('-y - 2e0 * 13e-1 / 25e-1', 'y')} FROM proj")
def image_flip_normalised(t):
    return rangeimage.flipped(rangeimage.project(t("points")), 1.3, 2.5).select("seq", "u", r6("y"))


@query(f"WITH {duck('points')}, {_PIXELS.format('points')} SELECT seq, v FROM proj WHERE ((CASE WHEN v >= 9 THEN 1 ELSE 0 END) + (CASE WHEN v >= 30 THEN 1 ELSE 0 END) + (CASE WHEN v >= 41 THEN 1 ELSE 0 END)) % 2 = seq % 2")
def lasermix_bands(t):
    image = rangeimage.project(t("points"))
    return rangeimage.mixed(image.where("seq % 2 = 0"), image.where("seq % 2 = 1"), cuts=[9, 30, 41]).select("seq", "v")


@query(f"WITH {duck('points')} SELECT seq, CASE WHEN z NOT BETWEEN -2e0 AND 15e0 THEN 7 WHEN z < 1e-1 THEN 0 WHEN z < 3e-1 THEN 1 WHEN sqrt(x * x + y * y) < 10 THEN 4 ELSE 3 END AS label FROM points")
def ladder_labels(t):
    return semantics.ladder_labels(t("points")).select("seq", "label")


@query(f"WITH {duck('dense')}, v AS (SELECT *, dense_rank() OVER (PARTITION BY frame_ts ORDER BY floor(x / 5e-2), floor(y / 5e-2), floor(z / 5e-2)) - 1 AS voxel FROM dense) SELECT frame_ts, idx, CAST(voxel AS INT) AS voxel, idx = min(idx) OVER (PARTITION BY frame_ts, voxel) AS is_first FROM v")
def voxel_maps(t):
    return metrics.voxel_maps(t("dense")).select("frame_ts", "idx", F.col("voxel").cast("int").alias("voxel"), "is_first")


@query(f"WITH {duck('dense')} SELECT frame_ts, label, count(DISTINCT CAST(floor(x / 5e-1) * 1000 + floor(y / 5e-1) AS BIGINT)) AS n, CAST(sum(DISTINCT CAST(floor(x / 5e-1) * 1000 + floor(y / 5e-1) AS BIGINT)) AS BIGINT) AS total FROM dense GROUP BY frame_ts, label")
def footprint_keys(t):
    keys = t("dense").groupBy("frame_ts", "label").agg(F.collect_set(G.footprint_key(F.col("x"), F.col("y"), 0.5)).alias("k"))  # squares of one scan
    total = F.aggregate("k", F.lit(0).cast("long"), lambda a, k: a + k["kx"] * 1000 + k["ky"])
    return keys.select("frame_ts", "label", F.size("k").cast("long").alias("n"), total.alias("total"))


_WATER = "((x - 42e0) / 5e0) * ((x - 42e0) / 5e0) + ((y + 7e0) / 3e0) * ((y + 7e0) / 3e0) < 1 OR ((x - 95e0) / 4e0) * ((x - 95e0) / 4e0) + ((y - 9e0) / 6e0) * ((y - 9e0) / 6e0) < 1"


@query(f"WITH {duck('points')} SELECT seq, CASE WHEN {_WATER} THEN 5 WHEN abs(y) < 3 THEN 1 WHEN abs(y) < 25 THEN 2 ELSE 0 END AS label, {sql6('-12e-1 + 3e-2 * sin(35e-2 * x) * cos(25e-2 * y) + (CASE WHEN y > 4 AND y < 44e-1 THEN 25e-2 ELSE 0e0 END)', 'height')} FROM points")
def terrain_fixture(t):
    x, y = F.col("x"), F.col("y")
    return t("points").select("seq", simulate.terrain_label(x, y).alias("label"), simulate.terrain_height(x, y, -1.2).alias("height")).select("seq", "label", r6("height"))


def _lcg(seed: str, k: int) -> str:
    x = f"(({seed}) % 2147483648)"
    for _ in range(k):
        x = f"(({x} * 1103515245 % 2147483648 + 12345) % 2147483648)"
    return f"(floor({x} / 256) / 8388608e0)"


@query(
    f"""WITH p AS (SELECT i AS idx, radians(-225e-1 + 45e0 * (i // 256) / 63e0) AS up, 2e0 * {math.pi!r}::DOUBLE * (i % 256) / 256 AS az FROM range(16384) r(i)),
  s AS (SELECT *, CASE WHEN up < -1e-2 THEN 12e-1 / tan(-up) ELSE 20e0 + 70e0 * {_lcg('idx + 7', 4)} END AS r FROM p WHERE up < -1e-2 OR {_lcg('idx + 3', 5)} < 35e-2)
  SELECT idx, {sql6('r * cos(az)', 'x')}, {sql6('r * sin(az)', 'y')}, {sql6(f'CASE WHEN up < -1e-2 THEN -12e-1 + ({_lcg("idx", 3)} - 5e-1) * 4e-2 ELSE r * tan(up) END', 'z')}, CASE WHEN up < -1e-2 THEN 0 ELSE 3 END AS label FROM s WHERE r <= 100"""
)
def regression_drive(t):
    return simulate.drive_scan(t.spark, 256).select(big("idx"), r6("x"), r6("y"), r6("z"), "label")
