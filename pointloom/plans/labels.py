"""Queries on label spaces, network outputs and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import metrics, rangeimage, semantics
from .registry import big, query, r6, sql6, whole
from .views import duck

_FINE = "(CASE raw " + " ".join(f"WHEN {raw} THEN {fine}" for raw, fine in C.RAW_TO_FINE.items()) + f" ELSE {C.IGNORE} END)"


def _of_fine(values: tuple, fine: str, other: int) -> str:
    return f"(CASE {fine} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {other} END)"


@query(f"WITH {duck('raws')} SELECT id, raw, {_FINE} AS fine, {_of_fine(C.LABEL_OF_FINE, _FINE, 6)} AS label, {_of_fine(C.OBJECT_OF_FINE, _FINE, 0)} AS obj_class FROM raws")
def remap_raw_fine_adl1(t):
    fine = semantics.fine_of_raw(F.col("raw"))
    return t("raws").select("id", "raw", fine.alias("fine"), semantics.label_of_fine(fine).alias("label"), semantics.object_of_fine(fine).alias("obj_class"))


@query(
    f"""WITH {duck('raws')}, f AS (SELECT raw, {_FINE} AS fine FROM raws)
  SELECT raw, count(*) AS n, bool_and(fine = 255) AS ignored, bool_and(raw NOT IN ({', '.join(map(str, C.RAW_TO_FINE))})) AS unmapped FROM f GROUP BY raw"""
)
def label_audit(t):
    return t("raws").withColumn("fine", semantics.fine_of_raw(F.col("raw"))).groupBy("raw").agg(F.count("*").alias("n"), F.bool_and(F.col("fine") == C.IGNORE).alias("ignored"), F.bool_and(~F.col("raw").isin(list(C.RAW_TO_FINE))).alias("unmapped"))


_CHANCES = """p AS (SELECT vec_id, label AS gt, list_transform(e, lambda x: x / list_sum(e)) AS p FROM
    (SELECT vec_id, label, list_transform(embedding[1:12], lambda x: exp(CAST(x AS DOUBLE) * 8 - CAST(list_max(embedding[1:12]) AS DOUBLE) * 8)) AS e FROM embeddings))"""
_GROUPS = [[i for i, k in enumerate(C.LABEL_OF_FINE) if k == g] for g in range(8)]
_SUMS = ", ".join(" + ".join(["0e0", *(f"p[{i + 1}]" for i in g)]) + f" AS s{k}" for k, g in enumerate(_GROUPS))
_MOST = "greatest(" + ", ".join(f"s{k}" for k in range(8)) + ")"
_OBJECTS = [(i, k) for i, k in enumerate(C.OBJECT_OF_FINE) if k]


def _logits(t):
    return t.table("embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double") * 8).alias("logits"))


@query(
    f"""WITH {_CHANCES}, s AS (SELECT vec_id, p, {_SUMS} FROM p), m AS (SELECT *, {_MOST} AS most FROM s)
  SELECT vec_id, CASE WHEN most < 45e-2 THEN 6 {' '.join(f'WHEN s{k} = most THEN {k}' for k in range(8))} END AS label, {sql6('most', 'confidence')} FROM m"""
)
def softmax_grouped_collapse(t):
    return semantics.collapse(_logits(t), min_conf=0.45).select("vec_id", "label", r6("confidence"))


@query(
    f"""WITH {_CHANCES}, s AS (SELECT vec_id, p, {_SUMS} FROM p), m AS (SELECT *, {_MOST} AS most, greatest({', '.join(f'p[{i + 1}]' for i, _ in _OBJECTS)}) AS best FROM s),
  l AS (SELECT *, CASE {' '.join(f'WHEN s{k} = most THEN {k}' for k in range(8))} END AS label FROM m)
  SELECT vec_id, CASE WHEN label = 4 AND best >= 1e-1 THEN CASE {' '.join(f'WHEN p[{i + 1}] = best THEN {k}' for i, k in _OBJECTS)} END ELSE 0 END AS obj_class, CAST(list_position(p, list_max(p)) - 1 AS INT) AS fine FROM l"""
)
def object_head_argmax(t):
    return semantics.collapse(_logits(t), obj_min_conf=0.1).select("vec_id", "obj_class", "fine")


@query(f"WITH {duck('raws')}, f AS (SELECT {_FINE} AS fine FROM raws), c AS (SELECT fine, count(*) AS n FROM f GROUP BY fine) SELECT fine AS class, n, {sql6('1 / ln(102e-2 + n / CAST((SELECT sum(n) FROM c) AS DOUBLE))', 'weight')} FROM c")
def class_weights(t):
    return semantics.class_weights(t("raws").withColumn("fine", semantics.fine_of_raw(F.col("raw"))), "fine").select("class", "n", r6("weight"))


_EDGES = (0.0, 10.0, 25.0, 50.0, 100.0)


@query(f"WITH {duck('pairs')} SELECT CASE WHEN rng > 0 AND rng <= 10 THEN 0 WHEN rng > 10 AND rng <= 25 THEN 1 WHEN rng > 25 AND rng <= 50 THEN 2 WHEN rng > 50 AND rng <= 100 THEN 3 END AS range_bin, gt, pred, count(*) AS n FROM pairs GROUP BY 1, 2, 3")
def confusion_by_range(t):
    return metrics.confusion(t("pairs").withColumn("range_bin", metrics.range_bin(F.col("rng"), _EDGES, right_closed=True)), ["range_bin"])


_LABELLED = f"""labelled AS (SELECT {_of_fine(C.LABEL_OF_FINE, 'a', 6)} AS gt, {_of_fine(C.LABEL_OF_FINE, 'b', 6)} AS pred FROM (SELECT id % 13 AS a, (id * id + raw) % 13 AS b FROM raws)),
  m AS (SELECT gt, pred, count(*) AS n FROM labelled GROUP BY gt, pred)"""
_IOU = """o AS (SELECT coalesce(r.c, q.c) AS class, coalesce(r.n, 0) AS in_gt, coalesce(q.n, 0) AS in_pred, coalesce(h.n, 0) AS hit FROM (SELECT gt AS c, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY gt) r
  FULL JOIN (SELECT pred AS c, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY pred) q ON r.c = q.c LEFT JOIN (SELECT gt AS c, n FROM m WHERE gt = pred) h ON h.c = coalesce(r.c, q.c))"""


def _matrix(t):
    label = lambda x: semantics.label_of_fine(x.cast("int"))
    return metrics.confusion(t("raws").select(label(F.col("id") % 13).alias("gt"), label((F.col("id") * F.col("id") + F.col("raw")) % 13).alias("pred")))


@query(f"WITH {duck('raws')}, {_LABELLED}, {_IOU} SELECT class, in_gt, in_pred, hit, {sql6('CAST(hit AS DOUBLE) / (in_gt + in_pred - hit)', 'iou')}, in_gt > 0 AS present FROM o")
def iou_miou(t):
    return metrics.overlap(_matrix(t)).select("class", big("in_gt"), big("in_pred"), big("hit"), r6("iou"), "present")


@query(
    f"""WITH {duck('raws')}, {_LABELLED}, {_IOU} SELECT {sql6('(SELECT sum(n) FROM m WHERE gt = pred) / CAST((SELECT sum(n) FROM m) AS DOUBLE)', 'accuracy')},
  {sql6('(SELECT max(in_gt) FROM o) / CAST((SELECT sum(n) FROM m) AS DOUBLE)', 'majority')}, {sql6('(SELECT avg(CAST(hit AS DOUBLE) / (in_gt + in_pred - hit)) FROM o WHERE in_gt > 0)', 'miou')}, CAST((SELECT sum(n) FROM m) AS BIGINT) AS n"""
)
def accuracy_vs_majority(t):
    return metrics.accuracy(_matrix(t)).select(r6("accuracy"), r6("majority"), r6("miou"), "n")


@query(
    f"""WITH {duck('pairs')}, e AS (SELECT k AS class, id, CASE WHEN gt = k THEN 1 ELSE 0 END AS is_class, abs((CASE WHEN gt = k THEN 1e0 ELSE 0e0 END) - (id * 13 % 97) / 97e0) AS error FROM pairs, (VALUES (0), (1)) c(k)),
  s AS (SELECT *, sum(is_class) OVER (PARTITION BY class) AS total, sum(is_class) OVER w AS hit, sum(1 - is_class) OVER w AS miss FROM e WINDOW w AS (PARTITION BY class ORDER BY error DESC, id ROWS UNBOUNDED PRECEDING)),
  l AS (SELECT *, 1 - CAST(total - hit AS DOUBLE) / (total + miss) AS loss FROM s),
  d AS (SELECT class, error * (loss - coalesce(lag(loss) OVER (PARTITION BY class ORDER BY error DESC, id), 0e0)) AS term, total FROM l) SELECT class, {sql6('sum(term)', 'loss')} FROM d WHERE total > 0 GROUP BY class"""
)
def lovasz_metric(t):
    own = t("pairs").withColumn("class", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("is_class", (F.col("gt") == F.col("class")).cast("int"))
    return metrics.lovasz(own.select("class", "id", "is_class", F.abs(F.col("is_class") - (F.col("id") * 13 % 97) / 97.0).alias("error"))).select("class", r6("loss"))


@query(f"WITH {duck('points')} SELECT {', '.join(x for c in ('x', 'y', 'z') for x in (sql6(f'avg({c})', f'{c}_mean'), sql6(f'stddev_pop({c})', f'{c}_std')))} FROM points")
def channel_norm_stats(t):
    return metrics.moments(t("points"), ["x", "y", "z"]).select(*(r6(f"{c}_{k}") for c in "xyz" for k in ("mean", "std")))


@query(f"SELECT event_type AS step, {sql6('avg(value)', 'mean')}, {sql6('quantile_cont(value, 95e-2)', 'p95')}, {sql6('max(value)', 'most')}, count(*) AS n FROM events GROUP BY event_type")
def latency_stats(t):
    return metrics.latency(t.table("events").withColumnRenamed("event_type", "step"), ["step"], "value").select("step", r6("mean"), r6("p95"), r6("most"), "n")


@query(f"WITH {duck('points')} SELECT frame_ts, {sql6('quantile_cont(z, 2e-2)', 'ground_z')} FROM points GROUP BY frame_ts")
def ground_percentile(t):
    return metrics.percentiles(t("points"), ["frame_ts"], "z", {"ground_z": 0.02}).select("frame_ts", r6("ground_z"))


@query(f"WITH {duck('points')} SELECT {sql6('quantile_cont(p, 1e-3)', 'low')}, {sql6('quantile_cont(p, 999e-3)', 'high')} FROM (SELECT degrees(asin(least(greatest(z / sqrt(x * x + y * y + z * z), -1e0), 1e0))) AS p FROM points)")
def fov_percentiles(t):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    pitch = F.degrees(F.asin(F.least(F.greatest(F.col("z") / r, F.lit(-1.0)), F.lit(1.0))))
    return metrics.percentiles(t("points").select(pitch.alias("p")), [], "p", {"low": 0.001, "high": 0.999}).select(r6("low"), r6("high"))


@query(
    f"""WITH {duck('points')}, s AS (SELECT frame_ts, count(*) AS n FROM points GROUP BY frame_ts), k AS (SELECT n, count(*) AS k FROM s GROUP BY n), m AS (SELECT n AS mode FROM k ORDER BY k DESC, n LIMIT 1)
  SELECT mode, arg_min(w, abs(64 * w - mode) * 10000 + w) AS width FROM m, (VALUES (512), (1024), (2048)) o(w) GROUP BY mode"""
)
def azimuth_width_mode(t):
    return metrics.width_of_scan(t("points"))


@query(f"WITH {duck('points')} SELECT CAST(floor(x / 5e-2) AS BIGINT) AS kx, CAST(floor(y / 5e-2) AS BIGINT) AS ky, CAST(floor(z / 5e-2) AS BIGINT) AS kz, count(*) AS n FROM points GROUP BY 1, 2, 3")
def distinct_voxels(t):
    return metrics.voxels(t("points"))


@query(f"WITH {duck('points')} SELECT seq, CASE WHEN z NOT BETWEEN -2e0 AND 15e0 THEN 7 WHEN z > 1e0 THEN 4 ELSE 0 END AS label FROM points")
def segment_scan_stub(t):
    return semantics.height_labels(t("points")).select("seq", "label")


@query(
    f"""WITH {duck('points')}, q AS (SELECT seq, frame_ts, rng, intensity, CASE WHEN max(intensity) OVER (PARTITION BY frame_ts) > 15e-1 THEN intensity / max(intensity) OVER (PARTITION BY frame_ts) ELSE intensity END AS scaled
    FROM (SELECT seq, frame_ts, sqrt(x * x + y * y + z * z) AS rng, intensity * (1 + frame_ts % 3) AS intensity FROM points))
  SELECT seq, CAST(least(greatest(round_even(rng / 2e-3, 0), 0), 65535) AS INT) AS range_q, CAST(round_even(least(greatest(scaled, 0e0), 1e0) * 255, 0) AS INT) AS intensity_q, round_even(rng / 2e-3, 0) > 65535 AS saturated FROM q"""
)
def quantise_round_trip(t):
    p = t("points").withColumn("range", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).withColumn("intensity", F.col("intensity") * (1 + F.col("frame_ts") % 3))
    return rangeimage.quantised(p).select("seq", "range_q", "intensity_q", "saturated")
