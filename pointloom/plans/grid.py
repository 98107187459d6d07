"""Queries on the grid: lattice, folding, flags, ageing, lookups and rasters."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..functions import lattice as L
from ..operators import age, classify, clusters, fold, lookup, raster
from ..runtime import shared_dir
from ..streaming import live
from .registry import big, query, r6, r9, sql6, sql9, whole
from .views import duck


def _base(w: str) -> str:
    return f"CAST(floor(CAST({w} AS FLOAT) / CAST(0.05 AS FLOAT)) AS BIGINT)"


def _index(w: str, level: str) -> str:
    return f"CAST(floor({_base(w)} / (CASE {level} WHEN 0 THEN 1e0 WHEN 1 THEN 2e0 ELSE 10e0 END)) AS BIGINT)"


_SIZE = "(CASE level WHEN 0 THEN 5e-2 WHEN 1 THEN 1e-1 ELSE 5e-1 END)"


def _gated(points: str, poses: str) -> str:
    return f"""placed AS (SELECT p.* REPLACE (CASE WHEN label BETWEEN 0 AND 7 THEN label ELSE 6 END AS label), robot_x, robot_y, ground_z,
    sqrt((x - robot_x) * (x - robot_x) + (y - robot_y) * (y - robot_y)) AS rng FROM {points} p JOIN {poses} USING (frame_ts)),
  banded AS (SELECT *, CASE WHEN rng <= 10 THEN 0 WHEN rng <= 25 THEN 1 WHEN rng <= 100 THEN 2 END AS level FROM placed
    WHERE label <> 7 AND z - ground_z >= -2e0 - 4e-1 * rng AND z - ground_z <= 15e0),
  gated AS (SELECT *, {_index('x', 'level')} AS ix, {_index('y', 'level')} AS iy FROM banded WHERE level IS NOT NULL)"""


_CELLS = """cells AS (SELECT level, ix, iy, count(*) AS hit_count, min(z) AS h_min, max(z) AS h_max, avg(z) AS h_mean, coalesce(var_samp(z), 0) AS h_var,
    arg_max(label, frame_ts * 100000000000 + seq) AS semantic_label, max(frame_ts) AS last_update_ts FROM gated GROUP BY level, ix, iy)"""


def _rim(ground: float) -> str:
    ring = "(CASE level WHEN 0 THEN 15 WHEN 1 THEN 7 ELSE 1 END)"
    steps = [f"({a}, {b}, 0)" for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))] + [f"({a}, {b}, 1)" for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    return f"""steps(dx, dy, far) AS (VALUES {', '.join(steps)}),
  rims AS (SELECT DISTINCT d.level, d.ix, d.iy FROM (SELECT * FROM cells, steps WHERE {ground}e0 - h_max > 15e-2 AND hit_count >= 3) d
    JOIN cells n ON n.level = d.level AND n.hit_count > 0 AND n.h_max >= {ground}e0 - 8e-2
     AND n.ix = d.ix + d.dx * (CASE far WHEN 1 THEN (CASE d.level WHEN 0 THEN 15 WHEN 1 THEN 7 ELSE 1 END) ELSE 1 END)
     AND n.iy = d.iy + d.dy * (CASE far WHEN 1 THEN (CASE d.level WHEN 0 THEN 15 WHEN 1 THEN 7 ELSE 1 END) ELSE 1 END))"""


def _classified(ground: float) -> str:
    return f"""{_rim(ground)},
  flagged AS (SELECT c.*, CASE WHEN r.level IS NOT NULL THEN 3 WHEN h_max - h_min < 5e-2 THEN 0 WHEN h_min - ({ground}e0) > 5e-1 THEN 0 WHEN h_max - ({ground}e0) > 3e-1 THEN 1 ELSE 2 END AS obstacle_flag
    FROM cells c LEFT JOIN rims r ON r.level = c.level AND r.ix = c.ix AND r.iy = c.iy),
  judged AS (SELECT *, CASE WHEN obstacle_flag IN (1, 3) THEN 0e0 ELSE least(hit_count / 10e0, 1e0) * (5e-1 * exp(-5e0 * sqrt(greatest(h_var, 0e0)))
    + 5e-1 * (CASE semantic_label WHEN 0 THEN 1e0 WHEN 1 THEN 8e-1 WHEN 2 THEN 65e-2 WHEN 3 THEN 15e-2 WHEN 4 THEN 0e0 WHEN 5 THEN 0e0 ELSE 4e-1 END)) END AS traversability FROM flagged)"""


_FOLDED = f"level, ix, iy, hit_count, h_min, h_max, {sql9('h_mean', 'h_mean')}, {sql9('h_var', 'h_var')}, CAST(semantic_label AS INT) AS semantic_label, last_update_ts"
_DENSE = f"WITH {duck('dense', 'poses')}, {_gated('dense', 'poses')}, {_CELLS}"
_WIDE = f"WITH {duck('points', 'poses')}, {_gated('points', 'poses')}, {_CELLS}"
GROUND, DEEP_GROUND, FRAME = -0.2, 1.9, 260


def _folded(df):
    return df.select(whole("level"), big("ix"), big("iy"), big("hit_count"), "h_min", "h_max", r9("h_mean"), r9("h_var"), whole("semantic_label"), whole("last_update_ts"))


def wide_cells(t):
    return fold.fold(fold.gate_points(t("points"), t("poses")))


def dense_cells(t):
    return fold.fold(fold.gate_points(t("dense"), t("poses")))


@query(f"WITH {duck('points')} SELECT seq, {_base('x')} AS base_x, {_index('x', '1')} AS x1, {_index('x', '2')} AS x2 FROM points")
def lattice_base_index(t):
    x = F.col("x")
    return t("points").select("seq", L.base_index(x).alias("base_x"), L.cell_index(x, F.lit(1)).alias("x1"), L.cell_index(x, F.lit(2)).alias("x2"))


_STRETCHED = "(x * 100037e-5)"


@query(
    f"""WITH {duck('points')}, i AS (SELECT {_base(_STRETCHED)} AS b, {_index(_STRETCHED, '1')} AS c1, {_index(_STRETCHED, '2')} AS c2 FROM points)
  SELECT count(*) AS n, count(*) FILTER (WHERE floor(c1 / 5e0) <> c2 OR floor(b / 2e0) <> c1 OR floor(b / 10e0) <> c2) AS violations FROM i"""
)
def lattice_nesting_audit(t):
    x = F.col("x") * 1.00037
    wrong = (L.floor_div(L.cell_index(x, F.lit(1)), 5) != L.cell_index(x, F.lit(2))) | (L.floor_div(L.base_index(x), 2) != L.cell_index(x, F.lit(1))) | (L.floor_div(L.base_index(x), 10) != L.cell_index(x, F.lit(2)))
    return t("points").agg(F.count("*").alias("n"), F.count_if(wrong).alias("violations"))


@query(
    f"""WITH {duck('points', 'poses')}, d AS (SELECT seq, x, y, sqrt((x - robot_x) * (x - robot_x) + (y - robot_y) * (y - robot_y)) AS rng FROM points JOIN poses USING (frame_ts)),
  b AS (SELECT *, CASE WHEN rng <= 10 THEN 0 WHEN rng <= 25 THEN 1 WHEN rng <= 100 THEN 2 END AS level FROM d)
  SELECT seq, level, CASE WHEN level IS NOT NULL THEN {_index('x', 'level')} END AS ix, CASE WHEN level IS NOT NULL THEN {_index('y', 'level')} END AS iy FROM b"""
)
def resolve_level(t):
    d = t("points").join(t("poses"), "frame_ts").withColumn("level", L.level_of(L.planar(F.col("x") - F.col("robot_x"), F.col("y") - F.col("robot_y"))))
    return d.select("seq", "level", L.cell_index(F.col("x"), F.col("level")).alias("ix"), L.cell_index(F.col("y"), F.col("level")).alias("iy"))


@query(f"WITH {duck('points', 'poses')}, {_gated('points', 'poses')} SELECT seq, CAST(label AS INT) AS label, level, ix, iy FROM gated")
def point_gate(t):
    return fold.gate_points(t("points"), t("poses")).select("seq", whole("label"), "level", "ix", "iy")


@query(f"{_WIDE} SELECT {_FOLDED} FROM cells")
def cell_fold(t):
    return _folded(wide_cells(t))


_RESTARTED = """gaps AS (SELECT *, CASE WHEN frame_ts - lag(frame_ts) OVER (PARTITION BY level, ix, iy ORDER BY frame_ts, seq) > 50 THEN 1 ELSE 0 END AS fresh FROM gated),
  islands AS (SELECT *, sum(fresh) OVER (PARTITION BY level, ix, iy ORDER BY frame_ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM gaps),
  marked AS (SELECT *, max(island) OVER (PARTITION BY level, ix, iy) AS newest FROM islands),
  cells AS (SELECT level, ix, iy, count(*) AS hit_count, min(z) AS h_min, max(z) AS h_max, avg(z) AS h_mean, coalesce(var_samp(z), 0) AS h_var,
    arg_max(label, frame_ts * 100000000000 + seq) AS semantic_label, max(frame_ts) AS last_update_ts FROM marked WHERE island = newest GROUP BY level, ix, iy)"""


@query(f"WITH {duck('passes', 'still')}, {_gated('passes', 'still')}, {_RESTARTED} SELECT {_FOLDED} FROM cells")
def cell_fold_restart(t):
    return _folded(fold.fold_with_restart(fold.gate_points(t("passes"), t("still"))))


@query(
    f"""{_WIDE}, carved AS (SELECT 2 AS level, {_index('x', '2')} AS ix, {_index('y', '2')} AS iy, max(frame_ts) AS carve_ts FROM points WHERE seq % 7 = 0 GROUP BY 1, 2, 3)
  SELECT coalesce(c.level, v.level) AS level, coalesce(c.ix, v.ix) AS ix, coalesce(c.iy, v.iy) AS iy, coalesce(hit_count, 0) AS hit_count, coalesce(h_min, 1e9) AS h_min, coalesce(h_max, -1e9) AS h_max,
    CAST(coalesce(semantic_label, 6) AS INT) AS semantic_label, coalesce(last_update_ts, 0) AS last_update_ts, coalesce(carve_ts, 0) AS carve_ts, CASE WHEN c.level IS NULL THEN 0 ELSE 2 END AS obstacle_flag, 4e-1 AS traversability
  FROM cells c FULL JOIN carved v ON c.level = v.level AND c.ix = v.ix AND c.iy = v.iy"""
)
def cell_upsert_defaults(t):
    two = F.lit(2)
    carved = t("points").where("seq % 7 = 0").select(two.alias("level"), L.cell_index(F.col("x"), two).alias("ix"), L.cell_index(F.col("y"), two).alias("iy"), "frame_ts").groupBy("level", "ix", "iy").agg(F.min("frame_ts").alias("carve_first"), F.max("frame_ts").alias("carve_ts"))
    return fold.upsert(wide_cells(t), carved).select("level", "ix", "iy", "hit_count", "h_min", "h_max", whole("semantic_label"), "last_update_ts", "carve_ts", "obstacle_flag", "traversability")


_JUDGED = f"level, ix, iy, obstacle_flag, {sql6('traversability', 'traversability')}"


@query(f"{_DENSE}, {_classified(GROUND)} SELECT {_JUDGED} FROM judged")
def classify_all(t):
    return classify.classify(dense_cells(t), GROUND).select("level", "ix", "iy", "obstacle_flag", r6("traversability"))


@query(f"{_WIDE}, {_classified(GROUND)} SELECT {_JUDGED} FROM judged WHERE last_update_ts = 20")
def classify_dirty(t):
    return classify.classify(wide_cells(t), GROUND, only_frame=20).select("level", "ix", "iy", "obstacle_flag", r6("traversability"))


@query(f"{_DENSE}, {_classified(DEEP_GROUND)} SELECT level, ix, iy, obstacle_flag FROM judged")
def negative_obstacle_rim(t):
    return classify.classify(dense_cells(t), DEEP_GROUND).select("level", "ix", "iy", "obstacle_flag")


_AGED = f"""aged AS (SELECT * REPLACE (CASE WHEN obstacle_flag IN (1, 3) AND k >= 1 AND traversability * pow(9e-1, k) < 5e-2 THEN 2 ELSE obstacle_flag END AS obstacle_flag, traversability * pow(9e-1, k) AS traversability)
  FROM (SELECT *, CASE WHEN {FRAME} >= last_update_ts + 51 THEN CAST(floor({FRAME} / 5e0) - floor((last_update_ts + 50) / 5e0) AS INT) ELSE 0 END AS k FROM judged))"""


@query(f"{_WIDE}, {_classified(GROUND)}, {_AGED} SELECT level, ix, iy, k AS ticks, obstacle_flag, {sql6('traversability', 'traversability')} FROM aged")
def decay_closed_form(t):
    return age.age(classify.classify(wide_cells(t), GROUND), FRAME).select("level", "ix", "iy", "ticks", "obstacle_flag", r6("traversability"))


def _near(x: float, y: float, margin: float) -> str:
    keep = "(CASE level WHEN 0 THEN 125e-1 WHEN 1 THEN 3125e-2 ELSE 12e1 END)" if margin == 20 else "(CASE level WHEN 0 THEN 11e0 WHEN 1 THEN 26e0 ELSE 101e0 END)"
    d = [f"((i{a} + 5e-1) * {_SIZE} - {v}e0)" for a, v in (("x", x), ("y", y))]
    return f"{d[0]} * {d[0]} + {d[1]} * {d[1]} <= {keep} * {keep}"


@query(f"{_WIDE} SELECT level, ix, iy, hit_count FROM cells WHERE {_near(40, -15, 1)}")
def evict_by_band(t):
    return age.evict(wide_cells(t), 40.0, -15.0, 1.0).select("level", "ix", "iy", "hit_count")


@query(f"{_WIDE}, {_classified(GROUND)}, {_AGED} SELECT level, ix, iy, obstacle_flag, {sql6('traversability', 'traversability')} FROM aged WHERE {_near(-30, 25, 20)}")
def age_then_evict(t):
    aged = age.age(classify.classify(wide_cells(t), GROUND), FRAME)
    return age.evict(aged, -30.0, 25.0).select("level", "ix", "iy", "obstacle_flag", r6("traversability"))


@query(
    f"""WITH {duck('points', 'passes', 'poses', 'probes')}, {_gated('points', 'poses')}, {_CELLS},
  looked AS (SELECT probe_id, level, {_index('x', 'level')} AS ix, {_index('y', 'level')} AS iy FROM (SELECT probe_id, x * 30 AS x, y * 30 AS y, level FROM probes, (VALUES (0), (1), (2)) l(level))),
  ranked AS (SELECT probe_id, c.level, c.ix, c.iy, c.hit_count, c.last_update_ts, row_number() OVER (PARTITION BY probe_id ORDER BY c.last_update_ts DESC NULLS LAST, looked.level) AS r
    FROM looked LEFT JOIN cells c ON c.level = looked.level AND c.ix = looked.ix AND c.iy = looked.iy)
  SELECT probe_id, level, ix, iy, hit_count, last_update_ts FROM ranked WHERE r = 1"""
)
def query_world_latest(t):
    probes = t("probes").select("probe_id", (F.col("x") * 30).alias("x"), (F.col("y") * 30).alias("y"))
    return lookup.query_world(wide_cells(t), probes).select("probe_id", "level", "ix", "iy", "hit_count", "last_update_ts")


def _cost() -> str:
    return f"""costed AS (SELECT *, CASE WHEN obstacle_flag IN (1, 3) THEN 100 WHEN hit_count = 0 THEN 0 WHEN {FRAME} - last_update_ts > 50 AND traversability < 5e-2 THEN NULL WHEN semantic_label IN (4, 5) THEN 100
    ELSE CAST(round(99e0 * (1e0 - least(greatest(traversability / least(hit_count / 10e0, 1e0), 0e0), 1e0)), 0) AS INT) END AS cost FROM judged)"""


def _spread(x: float, y: float, size: float, res: float) -> str:
    n = max(1, round(size / res))
    ox, oy = (math.floor((v - size / 2) / res) * res for v in (x, y))
    low = lambda i, o: f"CAST(floor(({i} * {_SIZE} - ({o!r}::DOUBLE)) / {res!r}::DOUBLE) AS BIGINT)"
    high = lambda i, o: f"CAST(floor((({i} + 1) * {_SIZE} - ({o!r}::DOUBLE)) / {res!r}::DOUBLE - 1e-4) AS BIGINT)"
    return f"""spread AS (SELECT * EXCLUDE (x0, x1, y0, y1), unnest(range(greatest(x0, 0), least(x1, {n - 1}) + 1)) AS px, y0, y1
    FROM (SELECT *, {low('ix', ox)} AS x0, {high('ix', ox)} AS x1, {low('iy', oy)} AS y0, {high('iy', oy)} AS y1 FROM costed WHERE cost IS NOT NULL) WHERE x1 >= 0 AND y1 >= 0 AND x0 < {n} AND y0 < {n} AND x1 >= x0 AND y1 >= y0),
  pixels AS (SELECT * EXCLUDE (y0, y1), unnest(range(greatest(y0, 0), least(y1, {n - 1}) + 1)) AS py FROM spread)"""


@query(f"{_WIDE}, {_classified(GROUND)}, {_cost()}, {_spread(0.7, 0.3, 60.0, 0.2)} SELECT px, py, max(cost) AS cost FROM pixels GROUP BY px, py")
def costmap_raster(t):
    return raster.cost_raster(classify.classify(wide_cells(t), GROUND), 0.7, 0.3, FRAME, 60.0, 0.2).select("px", "py", "cost")


_SEVERE = f"""severe AS (SELECT *, CASE WHEN hit_count = 0 THEN 1 WHEN obstacle_flag = 3 THEN 7 WHEN cost = 100 AND semantic_label = 5 AND obstacle_flag <> 1 THEN 5 WHEN cost = 100 THEN 6 WHEN obstacle_flag = 2 THEN 4
    WHEN h_min - ({GROUND}e0) > 5e-1 THEN 3 ELSE 2 END AS severity FROM pixels),
  worst AS (SELECT px, py, arg_max(severe, ((severity * 100000 + last_update_ts) * 10 - level) * 100000000::HUGEINT + (ix + 5000) * 10000 + iy + 5000) AS m FROM severe GROUP BY px, py)"""


def _channel(i: int) -> str:
    from .. import config as C

    plain = "CASE m.severity " + " ".join(f"WHEN {s} THEN {c[i]}" for s, c in enumerate(C.TERRAIN_RGB)) + " END"
    tint = " ".join(f"WHEN m.severity = 2 AND m.semantic_label = {s + 1} THEN {c[i]}" for s, c in enumerate(C.GROUND_RGB))
    return f"CAST(floor((CASE {tint} ELSE {plain} END) / (CASE WHEN {FRAME} - m.last_update_ts > 50 THEN 2e0 ELSE 1e0 END)) AS INT) AS {'rgb'[i]}"


@query(f"{_WIDE}, {_classified(GROUND)}, {_cost()}, {_spread(0.7, 0.3, 60.0, 0.2)}, {_SEVERE} SELECT px, py, m.severity AS severity, {', '.join(map(_channel, range(3)))} FROM worst")
def severity_image(t):
    return raster.severity_image(classify.classify(wide_cells(t), GROUND), 0.7, 0.3, GROUND, FRAME, 60.0, 0.2)


@query(
    f"""{_DENSE}, h AS (SELECT *, least(greatest((h_max - ({GROUND}e0) + 1e0) / 3e0, 0e0), 1e0) AS t FROM cells)
  SELECT level, ix, iy, CAST(2 + round(t * 250e0, 0) AS INT) AS severity, CAST(round(255e0 * least(2e0 * t, 1e0), 0) AS INT) AS r, CAST(round(255e0 * (1e0 - abs(2e0 * t - 1e0)), 0) AS INT) AS g,
    CAST(round(255e0 * least(2e0 - 2e0 * t, 1e0), 0) AS INT) AS b FROM h"""
)
def elevation_colour(t):
    return raster.elevation_colour(dense_cells(t), GROUND).select("level", "ix", "iy", "severity", "r", "g", "b")


@query(
    f"""{_DENSE}, {_classified(GROUND)},
  h AS (SELECT *, least(greatest((h_max - ({GROUND}e0)) / 25e-1, 0e0), 1e0) AS up, least(greatest(traversability / greatest(least(hit_count / 10e0, 1e0), 1e-3), 0e0), 1e0) AS t FROM judged)
  SELECT level, ix, iy, CASE WHEN obstacle_flag = 3 THEN 7 WHEN obstacle_flag = 1 OR semantic_label = 4 THEN 6 WHEN semantic_label = 5 THEN 5 WHEN obstacle_flag = 2 THEN 4 WHEN h_min - ({GROUND}e0) > 5e-1 THEN 3 ELSE 2 END AS terrain,
    CAST(floor(255 * least(2 * up, 1e0)) AS INT) AS elevation_r, CAST(floor(255 * (1 - abs(2 * up - 1))) AS INT) AS elevation_g, CAST(floor(255 * greatest(1 - 2 * up, 0e0)) AS INT) AS elevation_b,
    CASE WHEN obstacle_flag = 3 THEN 75 WHEN obstacle_flag = 1 OR semantic_label IN (4, 5) THEN 255 ELSE CAST(floor(255 * (1 - t)) AS INT) END AS cost_r,
    CASE WHEN obstacle_flag = 3 THEN 35 WHEN obstacle_flag = 1 OR semantic_label IN (4, 5) THEN 0 ELSE CAST(floor(200 * t) AS INT) END AS cost_g, {FRAME} - last_update_ts > 50 AS stale FROM h"""
)
def dashboard_layers(t):
    return raster.layers(classify.classify(dense_cells(t), GROUND), GROUND, FRAME)


@query(f"{_WIDE} SELECT level, count(*) AS cells, CAST(sum(hit_count) AS BIGINT) AS points, count(*) / 2097152e0 AS load FROM cells GROUP BY level")
def levels_histogram(t):
    return wide_cells(t).groupBy("level").agg(F.count("*").alias("cells"), F.sum("hit_count").alias("points"), (F.count("*") / float(1 << 21)).alias("load"))


#: Rays walked cell by cell, from the hit back to where its band starts, by the error of the line.
_CARVED = f"""r AS (SELECT *, CASE WHEN rng <= 1e-3 THEN 0e0 ELSE (CASE level WHEN 0 THEN 0e0 WHEN 1 THEN 10e0 ELSE 25e0 END) / rng END AS f FROM gated),
  rays AS (SELECT DISTINCT frame_ts, level, {_index('(robot_x + f * (x - robot_x))', 'level')} AS ox, {_index('(robot_y + f * (y - robot_y))', 'level')} AS oy, ix AS hx, iy AS hy FROM r WHERE f < 1),
  walk(k, frame_ts, level, x, y, ox, oy, dx, dy, sx, sy, e) AS (
    SELECT 0, frame_ts, level, hx, hy, ox, oy, abs(ox - hx), abs(oy - hy), CASE WHEN ox > hx THEN 1 ELSE -1 END, CASE WHEN oy > hy THEN 1 ELSE -1 END, abs(ox - hx) - abs(oy - hy) FROM rays
    UNION ALL SELECT k + 1, frame_ts, level, x + (CASE WHEN 2 * e > -dy THEN sx ELSE 0 END), y + (CASE WHEN 2 * e < dx THEN sy ELSE 0 END), ox, oy, dx, dy, sx, sy,
      e - (CASE WHEN 2 * e > -dy THEN dy ELSE 0 END) + (CASE WHEN 2 * e < dx THEN dx ELSE 0 END) FROM walk WHERE x <> ox OR y <> oy),
  carved AS (SELECT level, x AS ix, y AS iy, min(frame_ts) AS carve_first, max(frame_ts) AS carve_ts FROM walk WHERE k > 0 GROUP BY level, x, y)"""


@query(f"WITH RECURSIVE {duck('dense', 'poses')}, {_gated('dense', 'poses')}, {_CARVED} SELECT level, ix, iy, carve_first, carve_ts FROM carved")
def carve_rays(t):
    return clusters.carve(fold.gate_points(t("dense"), t("poses"))).select("level", "ix", "iy", "carve_first", "carve_ts")


@query(f"WITH {duck('dense', 'poses')}, {_gated('dense', 'poses')} SELECT seq, level, ix, iy FROM gated WHERE rng >= 3e-1")
def self_return_filter(t):
    return fold.gate_points(t("dense"), t("poses"), C.SELF_RANGE).select("seq", "level", "ix", "iy")


LOOP_FRAME = 640

_LOOP = f"""WITH RECURSIVE {duck('passes', 'still')}, {_gated('passes', 'still').replace('gated AS', 'all_gated AS')}, gated AS (SELECT * FROM all_gated WHERE rng >= 3e-1), {_RESTARTED}, {_CARVED}, {_classified(GROUND)},
  whole AS (SELECT level, ix, iy, coalesce(hit_count, 0) AS hit_count, coalesce(h_min, 1e9) AS h_min, coalesce(semantic_label, 6) AS semantic_label, coalesce(obstacle_flag, 0) AS flag, coalesce(traversability, 4e-1) AS score, coalesce(last_update_ts, 0) AS last_update_ts,
    coalesce(carve_first, 0) AS carve_first, coalesce(carve_ts, 0) AS carve_ts FROM judged FULL JOIN carved USING (level, ix, iy)),
  ticked AS (SELECT *, CASE WHEN hit_count = 0 THEN greatest(0, floor({LOOP_FRAME} / 5e0) - floor(greatest(50, carve_first - 1) / 5e0)) WHEN {LOOP_FRAME} >= last_update_ts + 51 THEN floor({LOOP_FRAME} / 5e0) - floor((last_update_ts + 50) / 5e0) ELSE 0 END AS k FROM whole),
  judged_late AS (SELECT * EXCLUDE (flag, score), CASE WHEN flag = 1 AND carve_ts > last_update_ts THEN 2 WHEN flag IN (1, 3) AND k >= 1 AND score * pow(9e-1, k) < 5e-2 THEN 2 ELSE flag END AS obstacle_flag, score * pow(9e-1, k) AS traversability FROM ticked)"""


def _fed(t, name: str, parts: int) -> live.LiveMap:
    """The live map after a stream of a view's scans, a file for each micro-batch, frames in order."""
    folder = f"{shared_dir(t.spark)}/feed-{uuid.uuid4().hex}"
    points = t(name)
    low, high = points.agg(F.min("frame_ts"), F.max("frame_ts")).first()
    for i in range(parts if low is not None else 0):
        cut = lambda k: low + (high + 1 - low) * k // parts
        points.where((F.col("frame_ts") >= cut(i)) & (F.col("frame_ts") < cut(i + 1))).coalesce(1).write.mode("append").parquet(f"{folder}/scans")
    stream = t.spark.readStream.schema(points.schema).option("maxFilesPerTrigger", "1").parquet(f"{folder}/scans")
    return live.run(t.spark, stream, t("still" if name == "passes" else "poses"), f"{folder}/map", self_range=C.SELF_RANGE if name == "passes" else 0.0)


@query(f"{_LOOP} SELECT level, ix, iy, hit_count, obstacle_flag, {sql6('traversability', 'traversability')}, last_update_ts, carve_ts FROM judged_late WHERE {_near(0, 0, 20)}")
def frame_loop(t):
    out = _fed(t, "passes", 3).at(LOOP_FRAME, 0.0, 0.0, GROUND)
    return out.select("level", "ix", "iy", big("hit_count"), "obstacle_flag", r6("traversability"), "last_update_ts", "carve_ts")


def loop_map(t):
    """The same map in one batch: gate, fold with restarts, carve, judge, fade, evict."""
    gated = fold.gate_points(t("passes"), t("still"), C.SELF_RANGE)
    whole = fold.upsert(fold.fold_with_restart(gated), clusters.carve(gated))
    return age.evict(age.age(classify.classify(whole, GROUND), LOOP_FRAME), 0.0, 0.0)


@query(
    f"""{_LOOP}, costed AS (SELECT *, CASE WHEN obstacle_flag IN (1, 3) THEN 100 WHEN hit_count = 0 THEN 0 WHEN {LOOP_FRAME} - last_update_ts > 50 AND traversability < 5e-2 THEN NULL WHEN semantic_label IN (4, 5) THEN 100
    ELSE CAST(round(99e0 * (1e0 - least(greatest(traversability / least(hit_count / 10e0, 1e0), 0e0), 1e0)), 0) AS INT) END AS cost FROM judged_late WHERE {_near(0, 0, 20)}),
  {_spread(0.03, 0.03, 6.0, 0.1)} SELECT px, py, max(cost) AS cost, count(*) FILTER (WHERE hit_count = 0) AS n_free FROM pixels GROUP BY px, py"""
)
def free_space_raster(t):
    costed = loop_map(t).withColumn("cost", raster.cost(LOOP_FRAME)).select("level", "ix", "iy", "cost", "hit_count")
    out = raster.footprint(costed, 0.03, 0.03, 6.0, 0.1).groupBy("px", "py").agg(F.max("cost").alias("cost"), F.count_if(F.col("hit_count") == 0).alias("n_free"))
    return out.where("cost is not null").select("px", "py", "cost", "n_free")


@query(f"WITH {duck('points', 'poses')}, {_gated('points', 'poses')}, {_RESTARTED} SELECT {_FOLDED} FROM cells")
def streaming_map_update(t):
    return _folded(_fed(t, "points", 2).cells().where("hit_count > 0"))


@query("SELECT CAST(0 AS BIGINT) AS cells, true AS forgotten")
def map_reset(t):
    kept = _fed(t, "passes", 1)
    there = kept.cells().count()
    kept.reset()
    return kept.cells().agg(F.count("*").alias("cells")).withColumn("forgotten", F.lit(there > 0))


@query(
    f"""{_LOOP}, costed AS (SELECT *, CASE WHEN obstacle_flag IN (1, 3) THEN 100 WHEN hit_count = 0 THEN 0 WHEN {LOOP_FRAME} - last_update_ts > 50 AND traversability < 5e-2 THEN NULL WHEN semantic_label IN (4, 5) THEN 100
    ELSE CAST(round(99e0 * (1e0 - least(greatest(traversability / least(hit_count / 10e0, 1e0), 0e0), 1e0)), 0) AS INT) END AS cost FROM judged_late WHERE {_near(0, 0, 20)}),
  {_spread(0.0, 0.0, 20.0, 0.2)} SELECT px, py, max(cost) AS cost, {LOOP_FRAME} AS frame_ts FROM pixels GROUP BY px, py"""
)
def cost_grid_publish(t):
    return _fed(t, "passes", 1).publish(LOOP_FRAME, 0.0, 0.0, GROUND, 20.0, 0.2).select("px", "py", "cost", "frame_ts")
