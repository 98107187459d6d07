"""Queries on range images."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import rangeimage
from .registry import query, r6, sql6
from .views import duck

_UP = math.radians(22.5)
_PIXELS = f"""proj AS (SELECT *, CAST(least(greatest(floor((1e0 - (asin(least(greatest(z / rng, -1e0), 1e0)) - ({-_UP!r}::DOUBLE)) / {2 * _UP!r}::DOUBLE) * 64), 0), 63) AS INT) AS v,
    CAST(least(greatest(floor(5e-1 * (-atan2(y, x) / {math.pi!r}::DOUBLE + 1e0) * 1024), 0), 1023) AS INT) AS u FROM (SELECT *, sqrt(x * x + y * y + z * z) AS rng FROM {{0}}) WHERE rng > 1e-6)"""
_BUFFER = """image AS (SELECT frame_ts, v, u, idx, rng, x, y, z, label FROM (SELECT *, row_number() OVER (PARTITION BY frame_ts, v, u ORDER BY rng, idx DESC) AS r FROM proj) WHERE r = 1)"""


def _projected(t, name="points"):
    return rangeimage.project(t(name))


@query(f"WITH {duck('points')}, {_PIXELS.format('points')} SELECT seq, v, u, {sql6('rng', 'rng')} FROM proj")
def pixel_projection(t):
    return _projected(t).withColumnRenamed("range", "rng").select("seq", "v", "u", r6("rng"))


@query(f"WITH {duck('dense')}, {_PIXELS.format('dense')}, {_BUFFER} SELECT frame_ts, v, u, idx, {sql6('rng', 'rng')} FROM image")
def z_buffer(t):
    return rangeimage.z_buffer(_projected(t, "dense")).withColumnRenamed("range", "rng").select("frame_ts", "v", "u", "idx", r6("rng"))


@query(f"WITH {duck('dense')}, {_PIXELS.format('dense')}, {_BUFFER} SELECT p.frame_ts, p.idx, coalesce(i.label, 255) AS label FROM dense p LEFT JOIN image i ON i.frame_ts = p.frame_ts AND i.idx = p.idx")
def unproject_fill(t):
    points = t("dense")
    return rangeimage.unproject(points.select("frame_ts", "idx"), rangeimage.z_buffer(_projected(t, "dense")), "label")


# frames of 500 points on a lattice of 2 m, so that windows hold several returns
_NEAR = "near AS (SELECT * REPLACE (CAST(seq // 500 + 1 AS INT) AS frame_ts) FROM dense)"


@query(
    f"""WITH {duck('dense')}, {_NEAR}, {_PIXELS.format('near').replace('* 64), 0), 63)', '* 16), 0), 15)').replace('* 1024), 0), 1023)', '* 64), 0), 63)')}, {_BUFFER},
  seen AS (SELECT p.frame_ts, p.idx, abs(i.rng - p.rng) AS gap, i.v - p.v AS dv, i.u - p.u AS du, i.label FROM proj p JOIN image i ON i.frame_ts = p.frame_ts AND i.v BETWEEN p.v - 2 AND p.v + 2 AND i.u BETWEEN p.u - 2 AND p.u + 2 AND abs(i.rng - p.rng) <= 1e0),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_ts, idx ORDER BY gap, dv, du) AS r FROM seen) WHERE r <= 5),
  votes AS (SELECT frame_ts, idx, label, count(*) AS n FROM best WHERE label <> 255 GROUP BY frame_ts, idx, label),
  won AS (SELECT frame_ts, idx, label FROM (SELECT *, row_number() OVER (PARTITION BY frame_ts, idx ORDER BY n DESC, label) AS r FROM votes) WHERE r = 1)
  SELECT p.frame_ts, p.idx, coalesce(w.label, i.label, 255) AS label FROM proj p LEFT JOIN won w ON w.frame_ts = p.frame_ts AND w.idx = p.idx LEFT JOIN image i ON i.frame_ts = p.frame_ts AND i.v = p.v AND i.u = p.u"""
)
def knn_label_vote(t):
    near = t("dense").withColumn("frame_ts", F.expr("cast(seq div 500 + 1 as int)"))
    projected = rangeimage.project(near, 16, 64)
    return rangeimage.knn_labels(projected, rangeimage.z_buffer(projected))


@query(
    f"""SELECT v, u, {sql6('cos(pitch) * cos(yaw)', 'dx')}, {sql6('cos(pitch) * sin(yaw)', 'dy')}, {sql6('sin(pitch)', 'dz')} FROM (SELECT CAST(i // 1024 AS INT) AS v, CAST(i % 1024 AS INT) AS u,
  {_UP!r}::DOUBLE - (i // 1024 + 5e-1) / 64 * {2 * _UP!r}::DOUBLE AS pitch, -((i % 1024 + 5e-1) / 1024 * 2e0 - 1e0) * {math.pi!r}::DOUBLE AS yaw FROM range(65536) r(i))"""
)
def direction_table(t):
    return rangeimage.directions(t.spark).select("v", "u", r6("dx"), r6("dy"), r6("dz"))


def _images(t):
    points = t("points")
    return rangeimage.project(points.where("seq % 2 = 0")), rangeimage.project(points.where("seq % 2 = 1"))


@query(f"WITH {duck('points')}, {_PIXELS.format('points')} SELECT seq, v, u FROM proj WHERE floor(v * 4 / 64e0) % 2 = seq % 2")
def lasermix_union(t):
    return rangeimage.mixed(*_images(t)).select("seq", "v", "u")


@query(f"WITH {duck('points')}, {_PIXELS.format('points')} SELECT seq, v, CAST(1023 - (u + 100) % 1024 AS INT) AS u, -y AS y FROM proj")
def image_roll_flip(t):
    return rangeimage.roll_flip(_projected(t), 100, True).select("seq", "v", "u", "y")


@query(
    f"""WITH {duck('dense')}, c AS (SELECT seq, frame_ts, CAST(((CAST(floor((atan2(y, x) / {2 * math.pi!r}::DOUBLE + 5e-1) * 32) AS BIGINT) % 32) + 32) % 32 AS INT) AS col, sqrt(x * x + y * y) AS dist FROM dense)
  SELECT seq, col FROM (SELECT *, min(dist) OVER (PARTITION BY frame_ts, col) AS nearest FROM c) WHERE dist <= nearest + 5e-2"""
)
def occlusion_horizon(t):
    return rangeimage.horizon(t("dense"), columns=32).select("seq", "col")


_Q = (0.1, -0.2, 0.3, math.sqrt(1 - 0.01 - 0.04 - 0.09))


def _turned_sql() -> str:
    x, y, z, w = (f"({v!r}::DOUBLE)" for v in _Q)
    rows = (
        f"(1 - 2 * ({y} * {y} + {z} * {z})) * x + (2 * ({x} * {y} - {z} * {w})) * y + (2 * ({x} * {z} + {y} * {w})) * z + robot_x",
        f"(2 * ({x} * {y} + {z} * {w})) * x + (1 - 2 * ({x} * {x} + {z} * {z})) * y + (2 * ({y} * {z} - {x} * {w})) * z + robot_y",
        f"(2 * ({x} * {z} - {y} * {w})) * x + (2 * ({y} * {z} + {x} * {w})) * y + (1 - 2 * ({x} * {x} + {y} * {y})) * z + ground_z",
    )
    return ", ".join(sql6(r, f"w{c}") for r, c in zip(rows, "xyz", strict=True))


@query(f"WITH {duck('points', 'poses')} SELECT seq, {_turned_sql()} FROM points JOIN poses USING (frame_ts)")
def rigid_transform(t):
    p = t("points").join(t("poses"), "frame_ts")
    turned = G.rotated(tuple(F.lit(v) for v in _Q), (F.col("x"), F.col("y"), F.col("z")), (F.col("robot_x"), F.col("robot_y"), F.col("ground_z")))
    return p.select("seq", *(c.alias(f"w{n}") for c, n in zip(turned, "xyz", strict=True))).select("seq", r6("wx"), r6("wy"), r6("wz"))
