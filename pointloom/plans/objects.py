"""Queries on objects: extents, boxes, clusters, tracks, nearest neighbours, and on feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import clusters, metrics, tracking
from ..sources import clouds
from .registry import query, r6, r9, sql6, sql9
from .views import duck

_KIND = """CASE WHEN lg <= 0 THEN 0 WHEN lg <= 6e-1 AND height >= 18e-1 AND tall >= 3 THEN 3 WHEN lg >= 3 AND slim >= 3 THEN 4
    WHEN lg <= 12e-1 AND height BETWEEN 9e-1 AND 23e-1 AND tall >= 11e-1 THEN 1 WHEN lg BETWEEN 18e-1 AND 12 AND sh BETWEEN 11e-1 AND 3 AND height BETWEEN 5e-1 AND 45e-1 THEN 2
    WHEN lg >= 3 OR height >= 45e-1 THEN 5 ELSE 0 END"""


def _ramp(v: str, low: str, high: str) -> str:
    return f"5e-1 + 5e-1 * least(greatest(({v} - {low}) / ({high} - {low}), 0e0), 1e0)"


@query(
    f"""WITH {duck('extents')}, e AS (SELECT *, greatest(length, width) AS lg, least(length, width) AS sh FROM extents),
  s AS (SELECT *, lg / greatest(sh, 1e-3) AS slim, height / greatest(lg, 1e-3) AS tall FROM e), k AS (SELECT *, {_KIND} AS obj_class FROM s)
  SELECT id, obj_class, {sql6(f"CASE obj_class WHEN 3 THEN {_ramp('tall', '3e0', '8e0')} WHEN 4 THEN {_ramp('slim', '3e0', '10e0')} WHEN 1 THEN {_ramp('tall', '11e-1', '4e0')} WHEN 2 THEN {_ramp('least(lg / 18e-1, sh / 11e-1)', '1e0', '25e-1')} WHEN 5 THEN 4e-1 ELSE 0e0 END", 'confidence')} FROM k"""
)
def classify_extent(t):
    kind, sure = G.extent_class(F.col("length"), F.col("width"), F.col("height"))
    return t("extents").select("id", kind.alias("obj_class"), sure.alias("confidence")).select("id", "obj_class", r6("confidence"))


_BOX = "WITH " + duck("detections") + ", b AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(dx) OVER w AS dx2, lead(dy) OVER w AS dy2 FROM (SELECT * REPLACE (x / 20e0 AS x, y / 20e0 AS y) FROM detections) WINDOW w AS (PARTITION BY sensor_id, frame_ts // 10 ORDER BY det_id))"


def _next_boxes(t):
    from pyspark.sql import Window

    w = Window.partitionBy("sensor_id", F.expr("frame_ts div 10")).orderBy("det_id")  # a stretch of a sensor's frames
    d = t("detections").withColumn("x", F.col("x") / 20.0).withColumn("y", F.col("y") / 20.0)
    return d.select("*", *(F.lead(c).over(w).alias(f"{c}2") for c in ("x", "y", "dx", "dy"))).where("x2 is not null")


def _side(c: str) -> str:
    return f"greatest(least({c} + d{c} / 2, {c}2 + d{c}2 / 2) - greatest({c} - d{c} / 2, {c}2 - d{c}2 / 2), 0e0)"


@query(f"{_BOX} SELECT det_id, {sql6(f'({_side("x")} * {_side("y")}) / (dx * dy + dx2 * dy2 - {_side("x")} * {_side("y")})', 'iou')} FROM b WHERE x2 IS NOT NULL")
def iou_pairs(t):
    box = lambda s: tuple(F.col(c + s) for c in ("x", "y", "dx", "dy"))
    return _next_boxes(t).withColumn("iou", G.iou(box(""), box("2"))).select("det_id", r6("iou"))


def _axis(c: str) -> str:
    low, high = f"(({c}2 - d{c}2 / 2) - ({c} - d{c} / 2))", f"(({c}2 + d{c}2 / 2) - ({c} + d{c} / 2))"
    return f"(CASE WHEN {low} * {high} > 0 THEN least(abs({low}), abs({high})) ELSE 0e0 END)"


@query(f"{_BOX} SELECT det_id, {sql6(f'sqrt({_axis("x")} * {_axis("x")} + {_axis("y")} * {_axis("y")})', 'shift')} FROM b WHERE x2 IS NOT NULL")
def edge_shift(t):
    edges = lambda s: (F.col(f"x{s}") - F.col(f"dx{s}") / 2, F.col(f"x{s}") + F.col(f"dx{s}") / 2, F.col(f"y{s}") - F.col(f"dy{s}") / 2, F.col(f"y{s}") + F.col(f"dy{s}") / 2)
    return _next_boxes(t).withColumn("shift", G.edge_shift(edges(""), edges("2"))).select("det_id", r6("shift"))


@query(
    f"""WITH {duck('dense')}, k AS (SELECT DISTINCT frame_ts, CAST(floor(x / 5e-1) * 100 + floor(y / 5e-1) AS BIGINT) AS k FROM dense WHERE label < 4), o AS (SELECT DISTINCT frame_ts, CAST(floor(x / 5e-1) * 100 + floor(y / 5e-1) AS BIGINT) AS k FROM dense WHERE label >= 4),
  f AS (SELECT DISTINCT frame_ts FROM dense), v AS (SELECT k.frame_ts + 1 AS frame_ts, k.k FROM k WHERE NOT EXISTS (SELECT 1 FROM k n WHERE n.frame_ts = k.frame_ts + 1 AND n.k = k.k))
  SELECT f.frame_ts, {sql6('CAST(count(o.k) AS DOUBLE) / count(v.k)', 'still_occupied')} FROM f JOIN v ON v.frame_ts = f.frame_ts LEFT JOIN o ON o.frame_ts = v.frame_ts AND o.k = v.k
  WHERE EXISTS (SELECT 1 FROM k WHERE k.frame_ts = f.frame_ts) AND EXISTS (SELECT 1 FROM o WHERE o.frame_ts = f.frame_ts) GROUP BY f.frame_ts"""
)
def vacated_fraction(t):
    key = (F.floor(F.col("x") / 0.5) * 100 + F.floor(F.col("y") / 0.5)).alias("k")
    cells = t("dense").select("frame_ts", "label", key)
    sets = lambda test, name: cells.where(test).groupBy("frame_ts").agg(F.collect_set("k").alias(name))
    now = sets("label < 4", "fresh")
    old = now.select((F.col("frame_ts") + 1).alias("frame_ts"), F.col("fresh").alias("old"))
    out = now.join(old, "frame_ts").join(sets("label >= 4", "busy"), "frame_ts").select("frame_ts", clusters.vacated("old", "fresh", "busy").alias("still_occupied"))
    return out.where("still_occupied is not null").select("frame_ts", r6("still_occupied"))


@query(
    f"""WITH RECURSIVE {duck('dense')}, near AS (SELECT a.frame_ts, a.seq AS i, b.seq AS j FROM dense a JOIN dense b ON a.frame_ts = b.frame_ts AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= CAST(3e-1 * 3e-1 AS DOUBLE)),
  core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 4), step AS (SELECT i, j FROM near WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
  reach(i, r) AS (SELECT i, i FROM core UNION SELECT step.j, reach.r FROM reach JOIN step ON step.i = reach.i), name AS (SELECT i, min(r) AS c FROM reach GROUP BY i),
  edge AS (SELECT near.i, min(name.c) AS c FROM near JOIN name ON name.i = near.j WHERE near.i NOT IN (SELECT i FROM core) GROUP BY near.i)
  SELECT d.frame_ts, d.seq, coalesce(name.c, edge.c) AS cluster FROM dense d LEFT JOIN name ON name.i = d.seq LEFT JOIN edge ON edge.i = d.seq"""
)
def dbscan_clusters(t):
    return clusters.dbscan(t("dense"), 0.3, 4)


@query(
    f"""WITH RECURSIVE {duck('dense')}, own AS (SELECT frame_ts, seq, CAST(floor(x * 4 / 2e-1) AS BIGINT) AS kx, CAST(floor(y * 4 / 2e-1) AS BIGINT) AS ky FROM dense), cell AS (SELECT DISTINCT frame_ts, kx, ky, kx * 100000 + ky AS k FROM own),
  step AS (SELECT a.frame_ts, a.k AS i, b.k AS j FROM cell a JOIN cell b ON a.frame_ts = b.frame_ts AND abs(a.kx - b.kx) <= 3 AND abs(a.ky - b.ky) <= 3),
  reach(frame_ts, i, r) AS (SELECT frame_ts, k, k FROM cell UNION SELECT step.frame_ts, step.j, reach.r FROM reach JOIN step ON step.frame_ts = reach.frame_ts AND step.i = reach.i),
  root AS (SELECT frame_ts, i, min(r) AS r FROM reach GROUP BY frame_ts, i), numbered AS (SELECT *, dense_rank() OVER (PARTITION BY frame_ts ORDER BY r) - 1 AS component FROM root)
  SELECT o.frame_ts, o.seq, n.component FROM own o JOIN numbered n ON n.frame_ts = o.frame_ts AND n.i = o.kx * 100000 + o.ky"""
)
def raster_components(t):
    return clusters.raster_components(t("dense").withColumn("x", F.col("x") * 4).withColumn("y", F.col("y") * 4))


@query(
    f"""WITH {duck('dense')}, b AS (SELECT frame_ts, label, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, count(*) AS n_points FROM dense GROUP BY frame_ts, label)
  SELECT frame_ts, label, {sql6('(x_lo + x_hi) / 2', 'cx')}, {sql6('(y_lo + y_hi) / 2', 'cy')}, {sql6('greatest(x_hi - x_lo, 1e-1)', 'dx')}, {sql6('greatest(y_hi - y_lo, 1e-1)', 'dy')}, n_points FROM b WHERE n_points >= 8"""
)
def cluster_boxes(t):
    return clusters.boxes(t("dense"), ["frame_ts", "label"]).where("n_points >= 8").select("frame_ts", "label", r6("cx"), r6("cy"), r6("dx"), r6("dy"), "n_points")


@query(f"WITH {duck('points', 'detections')} SELECT p.frame_ts, p.seq, p.label FROM points p ANTI JOIN (SELECT frame_ts, det_id FROM detections WHERE dx > 1e0) d ON p.frame_ts = d.frame_ts AND p.seq = d.det_id")
def moving_point_antijoin(t):
    moving = t("detections").where("dx > 1e0").select("frame_ts", F.col("det_id").alias("seq"))
    return t("points").join(moving, ["frame_ts", "seq"], "left_anti").select("frame_ts", "seq", "label")


_NEAREST = """n AS (SELECT t.frame_ts, t.truth_id, d.det_id, (t.x - d.x) * (t.x - d.x) + (t.y - d.y) * (t.y - d.y) AS d2, t.x, t.y FROM truth t LEFT JOIN detections d ON d.frame_ts = t.frame_ts AND (t.x - d.x) * (t.x - d.x) + (t.y - d.y) * (t.y - d.y) <= 225e-2),
  m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_ts, truth_id ORDER BY d2, det_id) AS r FROM n) WHERE r = 1)"""


@query(f"WITH {duck('truth', 'detections')}, {_NEAREST} SELECT frame_ts, truth_id, det_id AS nearest_det_id, {sql6('d2', 'd2')} FROM m")
def nearest_mover_match(t):
    return clusters.nearest(t("truth"), t("detections"), 1.5, "truth_id", "det_id").select("frame_ts", "truth_id", "nearest_det_id", r6("d2"))


@query(
    f"""WITH {duck('truth', 'detections')}, {_NEAREST}, b AS (SELECT *, CASE WHEN rng >= 0 AND rng < 10 THEN 0 WHEN rng >= 10 AND rng < 25 THEN 1 WHEN rng >= 25 AND rng < 50 THEN 2 END AS range_bin FROM (SELECT *, sqrt(x * x + y * y) AS rng FROM m))
  SELECT range_bin, count(*) AS n, count(det_id) AS found, {sql6('CAST(count(det_id) AS DOUBLE) / count(*)', 'recall')} FROM b GROUP BY range_bin"""
)
def recall_by_range(t):
    truth = t("truth")
    found = clusters.nearest(truth, t("detections"), 1.5, "truth_id", "det_id").join(truth, ["frame_ts", "truth_id"])
    binned = found.withColumn("range_bin", metrics.range_bin(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), (0.0, 10.0, 25.0, 50.0), right_closed=False))
    return binned.groupBy("range_bin").agg(F.count("*").alias("n"), F.count("nearest_det_id").alias("found"), (F.count("nearest_det_id") / F.count("*")).alias("recall")).select("range_bin", "n", "found", r6("recall"))


def _boxes(t):
    """All detections, by sensor and drive, and among them the things of the scene, as the detections' places are random
    and never move on."""
    detected = t("detections").select("sensor_id", F.expr("cast(frame_ts div 100 as bigint)").alias("drive"), "frame_ts", "det_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "dx", "dy")
    return detected.unionByName(t("scene").withColumn("det_id", (-1 - F.col("det_id")).cast("long")))


@query()
def mover_tracks(t):
    return tracking.movers(_boxes(t))


@query()
def sort_tracks(t):
    return tracking.sort_tracks(_boxes(t))


@query()
def mover_markers(t):
    return clouds.markers(tracking.movers(_boxes(t)))


@query(f"WITH {duck('points')} SELECT 'scan' || frame_ts AS scan, idx, CAST(x AS FLOAT) AS x, label & 65535 AS label, CAST((seq % 3) AS INT) AS instance FROM points")
def scan_label_zip(t):
    scan = F.concat(F.lit("scan"), F.col("frame_ts"))
    words = t("points").select(scan.alias("scan"), "idx", (F.col("label") + (F.col("seq") % 3) * 65536).alias("word"))
    labels = words.select("scan", "idx", F.col("word").bitwiseAND(65535).cast("int").alias("label"), F.shiftright("word", 16).cast("int").alias("instance"))
    points = t("points").select(scan.alias("scan"), "idx", F.col("x").cast("float").alias("x"))
    return clouds.zip_labels(points, labels).select("scan", "idx", "x", "label", "instance")


@query(f"WITH {duck('points')} SELECT frame_ts % 4 AS seq_id, count(DISTINCT frame_ts) AS scans, count(*) AS n FROM points WHERE frame_ts IN (SELECT frame_ts FROM points WHERE label = 3 AND seq % 5 = 0) GROUP BY 1")
def split_semijoin(t):
    points = t("points").withColumn("scan", F.concat(F.lit("f"), F.col("frame_ts")))
    path = F.concat(F.lit("seq"), (F.col("frame_ts") % 4).cast("string"), F.lit("/bin/"), F.col("scan"), F.lit(".bin"))
    split = points.where("label = 3 and seq % 5 = 0").select(path.alias("cloud"), F.lit("-").alias("label"))
    kept = clouds.restrict(points, split).withColumn("seq_id", clouds.sequence_of(path))
    return kept.groupBy(F.regexp_extract("seq_id", "[0-9]+", 0).cast("int").alias("seq_id")).agg(F.countDistinct("frame_ts").alias("scans"), F.count("*").alias("n"))


@query(f"WITH {duck('points', 'poses')}, s AS (SELECT frame_ts, {sql9('avg(z)', 'mean_z')}, count(*) AS n FROM points GROUP BY frame_ts) SELECT s.frame_ts, n, mean_z, robot_x FROM s LEFT JOIN (SELECT * FROM poses WHERE frame_ts % 3 <> 0) p ON p.frame_ts = s.frame_ts")
def pose_pass_through(t):
    scans = t("points").groupBy("frame_ts").agg(F.avg("z").alias("mean_z"), F.count("*").alias("n"))
    return scans.join(t("poses").where("frame_ts % 3 <> 0"), "frame_ts", "left").select("frame_ts", "n", r9("mean_z"), "robot_x")
