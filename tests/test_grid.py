"""Scenes with known outcomes, and the grid against a frame-by-frame simulator written for the purpose."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import config as C
from pointloom.functions import geometry as G
from pointloom.functions import lattice as L
from pointloom.operators import age, classify, clusters, fold, lookup, metrics, raster, semantics, tracking

POINTS = "frame_ts int, seq long, x double, y double, z double, label int"
POSES = "frame_ts int, robot_x double, robot_y double, ground_z double"


def cells_of(spark, points, ground=-1.2, poses=None):
    rows = [(f, i, float(x), float(y), float(z), label) for i, (f, x, y, z, label) in enumerate(points)]
    poses = poses or [(f, 0.0, 0.0, ground) for f in sorted({r[0] for r in rows})]
    return fold.gate_points(spark.createDataFrame(rows, POINTS), spark.createDataFrame(poses, POSES))


def test_bands(spark):
    got = [r.level for r in spark.createDataFrame([(2.83,), (9.99,), (10.0,), (15.0,), (70.0,), (100.0,), (150.0,), (float("nan"),)], "d double").select(L.level_of(F.col("d")).alias("level")).collect()]
    assert got == [0, 0, 0, 1, 2, 2, None, None]


def test_lattice(spark):
    w = np.arange(-100, 100, 0.0173).astype(np.float32)
    rows = spark.createDataFrame([(float(x),) for x in w], "w float").select("w", L.base_index(F.col("w")).alias("b"), *(L.cell_index(F.col("w"), F.lit(k)).alias(f"c{k}") for k in range(3))).collect()
    for r in rows:
        b = int(np.floor(np.float32(r.w) / np.float32(0.05)))
        assert (r.b, r.c0, r.c1, r.c2) == (b, b, b // 2, b // 10) and r.c1 // 5 == r.c2


def test_welford(spark):
    got = fold.fold(cells_of(spark, [(1, 1, 1, z, 0) for z in (1, 2, 3)], ground=0.0)).first()
    assert (got.hit_count, got.h_mean, got.h_var, got.h_min, got.h_max) == (3, 2, 1, 1, 3)


def test_gates(spark):
    points = [(1, 30, 0, -2.2, 0), (1, 10, 0, -20, 0), (1, 5, 0, 0, 250), (1, 5, 0, 0, 7), (1, 5, 0, math.nan, 0), (1, 5, 0, 20, 0)]
    got = {(r.x, r.label) for r in cells_of(spark, points).collect()}
    assert got == {(30.0, 0), (5.0, 6)}
    slope = [(1, r / 2, 0.0, -1.2 - 0.08 * r / 2, 0) for r in range(2, 121)]
    assert cells_of(spark, slope).count() == 119


def lattice(xs, ys, z):
    return [(1, x, y, z(x, y), 0) for x in xs for y in ys]


def test_negative_obstacles(spark):
    pit = lambda x, y: -1.6 if 4.8 < x < 5.2 and -0.2 < y < 0.2 else -1.2
    got = classify.classify(fold.fold(cells_of(spark, lattice(np.arange(4.01, 6, 0.02), np.arange(-0.99, 1, 0.02), pit))), -1.2)
    flags = {(r.ix, r.iy): (r.obstacle_flag, r.traversability) for r in got.collect()}
    assert flags[100, 0] == (3, 0.0) and flags[86, 0][0] != 3
    for grade in (0.02, 0.04):
        down = lattice(np.arange(2.01, 12, 0.04), np.arange(-0.5, 0.5, 0.04), lambda x, y, g=grade: -1.2 - g * (x - 2))
        assert classify.classify(fold.fold(cells_of(spark, down)), -1.2).where("obstacle_flag = 3").count() == 0


def test_dust_clears(spark):
    dust = [(1, 3.01, 0.01, -1.2 + i / 20, 0) for i in range(21)]
    judged = classify.classify(fold.fold(cells_of(spark, dust)), -1.2)
    assert judged.first().obstacle_flag == 1
    assert age.age(judged, 60).first().obstacle_flag == 2
    again = cells_of(spark, dust + [(61, 3.01, 0.01, -1.2, 0)] * 10)
    assert classify.classify(fold.fold_with_restart(again), -1.2).first().obstacle_flag == 0


def test_eviction(spark):
    cells = spark.createDataFrame([(2, ix, iy) for ix in range(-600, 600, 7) for iy in range(-90, 90, 11)], "level int, ix long, iy long")
    kept = {(r.ix, r.iy) for r in age.evict(cells, 0.0, 0.0, 300.0).collect()}
    assert kept == {(r.ix, r.iy) for r in cells.collect() if ((r.ix + 0.5) / 2) ** 2 + ((r.iy + 0.5) / 2) ** 2 <= 125**2}


def test_simulator(spark):
    """Hits with gaps, frame by frame, as the loop of a robot would fold and fade them."""
    rng = random.Random(8)
    points = []
    for frame in range(1, 320):
        for x in (1.02, 2.02, 3.02):
            if rng.random() < 0.02:
                points.append((frame, x, 0.01, rng.choice((0.0, 0.5, 1.0)), rng.randrange(7)))
    state, k = {}, {(r.x, r.ix) for r in cells_of(spark, points, 0.0).collect()}
    name = dict(k)
    for frame in range(1, 321):
        for f, x, _, z, label in points:
            if f == frame:
                c = state.get(name[x])
                if c is None or frame - c["last"] > 50:
                    c = state[name[x]] = {"z": []}
                c["z"].append(z)
                c |= {"last": frame, "label": label, "ticks": 0}
        if frame % 5 == 0:
            for c in state.values():
                c["ticks"] += frame - c["last"] > 50
    got = age.age(classify.classify(fold.fold_with_restart(cells_of(spark, points, 0.0)), 0.0), 320).collect()
    assert len(got) == len(state)
    for r in got:
        c = state[r.ix]
        assert (r.hit_count, r.h_min, r.h_max, r.last_update_ts, r.semantic_label, r.ticks) == (len(c["z"]), min(c["z"]), max(c["z"]), c["last"], c["label"], c["ticks"])
        assert r.h_var == pytest.approx(np.var(c["z"], ddof=1) if len(c["z"]) > 1 else 0)


def test_partitions_do_not_matter(spark):
    rng = random.Random(2)
    points = [(rng.randrange(9), rng.uniform(-30, 30), rng.uniform(-30, 30), rng.uniform(-1, 1), rng.randrange(7)) for _ in range(500)]
    gated = cells_of(spark, points, 0.0)
    keyed = [sorted((r.level, r.ix, r.iy, r.hit_count, round(r.h_mean, 9), r.semantic_label) for r in fold.fold(gated.repartition(n)).collect()) for n in (1, 16)]
    assert keyed[0] == keyed[1]


def test_lookup(spark):
    cells = spark.createDataFrame([(0, 2, 2, 5, 1), (1, 1, 1, 9, 0), (2, 0, 0, 9, 3)], "level int, ix long, iy long, last_update_ts int, carve_ts int")
    got = lookup.query_world(cells, spark.createDataFrame([(1, 0.12, 0.12), (2, 50.0, 50.0)], "probe_id int, x double, y double")).orderBy("probe_id").collect()
    assert (got[0].level, got[0].seen) == (1, 9) and got[1].level is None


def walked(hx, hy, ox, oy):
    """The cells of a line from its hit to its origin, by its error, step by step; the hit is left out."""
    dx, dy, x, y, out = abs(ox - hx), abs(oy - hy), hx, hy, []
    e = dx - dy
    while (x, y) != (ox, oy):
        twice = 2 * e
        if twice > -dy:
            e, x = e - dy, x + (1 if ox > hx else -1)
        if twice < dx:
            e, y = e + dx, y + (1 if oy > hy else -1)
        out.append((x, y))
    return out


def test_lines(spark):
    """Every line of up to nine cells either way, ties included, against the walk."""
    assert walked(4, 2, 0, 0) == [(3, 2), (2, 1), (1, 1), (0, 0)]  # at half a cell it stays behind
    ends = [(a, b) for a in range(-9, 10) for b in range(-9, 10) if a or b]
    df = spark.createDataFrame([(3, -2, 3 + a, b - 2) for a, b in ends], "hx long, hy long, ox long, oy long")
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.abs(F.col("ox") - F.col("hx")), F.abs(F.col("oy") - F.col("hy"))))
    x, y = clusters.line_cell(*(F.col(c) for c in ("hx", "hy", "ox", "oy", "k")))
    got = {}
    for r in df.withColumn("k", F.explode(steps)).select("ox", "oy", "k", x.alias("x"), y.alias("y")).orderBy("k").collect():
        got.setdefault((r.ox, r.oy), []).append((r.x, r.y))
    assert got == {(3 + a, b - 2): walked(3, -2, 3 + a, b - 2) for a, b in ends}


def test_carving(spark):
    got = {(r.ix, r.iy): (r.carve_first, r.carve_ts) for r in clusters.carve(cells_of(spark, [(1, 0.26, 0.01, 0.0, 0), (4, 0.16, 0.01, 0.0, 0)], 0.0)).collect()}
    assert got == {(i, 0): (1, 4 if i < 3 else 1) for i in range(5)}


@pytest.mark.parametrize("window", [1 << 24, 1 << 14])
def test_carving_in_windows(spark, monkeypatch, window):
    """Rays of several frames, far apart at times, walked side by side, against each on its own."""
    monkeypatch.setattr(clusters, "WINDOW", window)
    rng = random.Random(3)
    rays = [(f, lv, f * 300 + a, -f * 200 + b, f * 300 + a + rng.randrange(-40, 41), -f * 200 + b + rng.randrange(-40, 41)) for f in (1, 2, 9, 2) for lv in (0, 2) for a in (0, 3) for b in (0, 5) for _ in range(12)]
    import pandas as pd

    frames = [pd.DataFrame(part, columns=["frame_ts", "level", "ox", "oy", "hx", "hy"]) for part in (rays[:50], rays[50:])]
    got, want = {}, {}
    for r in pd.concat(list(clusters._walked(iter(frames)))).itertuples(index=False):
        old = got.get(r[:3], r[3:])
        got[r[:3]] = min(old[0], r[3]), max(old[1], r[4])
    for f, lv, ox, oy, hx, hy in rays:
        for x, y in walked(hx, hy, ox, oy):
            old = want.get((lv, x, y), (f, f))
            want[lv, x, y] = min(old[0], f), max(old[1], f)
    assert got == want


def free_map(spark, points, frame, ground=0.0):
    gated = cells_of(spark, points, ground)
    whole = fold.upsert(fold.fold_with_restart(gated), clusters.carve(gated))
    return {(r.level, r.ix, r.iy): r for r in age.age(classify.classify(whole, ground), frame).collect()}


def test_free_space(spark):
    """Cells that rays only passed are free, cost nothing, and fade from their first ray on; a lethal cell that a later
    ray passes is rough."""
    wall = [(1, 1.02, 0.01, z / 10, 4) for z in range(11)]
    got = free_map(spark, wall, 2)
    assert got[0, 20, 0].obstacle_flag == 1 and got[0, 20, 0].traversability == 0
    free = got[0, 10, 0]
    assert (free.hit_count, free.obstacle_flag, free.semantic_label, free.traversability, free.carve_ts) == (0, 0, 6, 0.4, 1)
    later = free_map(spark, [*wall, (3, 2.02, 0.01, 0.0, 0)], 70)
    assert later[0, 20, 0].obstacle_flag == 2 and later[0, 30, 0].carve_ts == 3
    assert later[0, 10, 0].traversability == pytest.approx(0.4 * 0.9 ** (70 // 5 - 50 // 5))
    cells = fold.upsert(fold.fold(cells_of(spark, wall, 0.0)), clusters.carve(cells_of(spark, wall, 0.0)))
    pixels = {(r.px, r.py): r.cost for r in raster.cost_raster(classify.classify(cells, 0.0), 0.0, 0.0, 2, 4.0, 0.05).collect()}
    assert pixels[40 + 20, 40] == 100 and pixels[40 + 10, 40] == 0


def test_self_returns(spark):
    rows = [(1, i, x, 0.0, 0.0, 0) for i, x in enumerate((0.1, 0.29, 0.3, 5.0))]
    poses = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], POSES)
    got = fold.gate_points(spark.createDataFrame(rows, POINTS), poses, C.SELF_RANGE)
    assert {r.seq for r in got.collect()} == {2, 3}


def test_plans_hash(spark):
    """Folding needs no sort: the last label is the maximum of one integer."""
    gated = cells_of(spark, [(1, 1, 1, 1, 0)], 0.0)
    plan = fold.fold(gated)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    big = spark.createDataFrame([(1, 1 << 29, 1.0, 1.0, 0.0, 0)], POINTS)
    with pytest.raises(Exception, match="place in a scan"):
        fold.fold(fold.gate_points(big, spark.createDataFrame([(1, 0.0, 0.0, 0.0)], POSES))).collect()


def test_variance_keeps_its_digits(spark):
    """Heights far from zero: sums of squares would lose all digits."""
    z = [12.0 + k * 1e-7 for k in range(50)]
    points = [(1 + k, 1.0, 1.0, v, 0) for k, v in enumerate(z)]
    want = np.var(z, ddof=1)
    got = fold.fold_with_restart(cells_of(spark, points, 0.0)).first()
    assert got.h_var == pytest.approx(want, rel=1e-4)


def test_raster(spark):
    cells = spark.createDataFrame([(2, 0, 0, 10, 0.0, 1, 0.0, 4, 5), (0, 0, 0, 10, 0.0, 0, 1.0, 0, 5)], "level int, ix long, iy long, hit_count long, h_min double, obstacle_flag int, traversability double, semantic_label int, last_update_ts int")
    got = raster.cost_raster(cells, 0.0, 0.0, 6, 4.0, 0.25).collect()
    assert len(got) == 4 and {r.cost for r in got} == {100}


def test_extents(spark):
    rows = [(0.6, 0.5, 1.75, "person"), (4.5, 1.9, 1.6, "vehicle"), (7.0, 2.4, 3.2, "vehicle"), (0.25, 0.25, 3.0, "pole"), (30.0, 0.3, 2.0, "wall"), (5.0, 4.0, 3.0, "structure"), (0.0, 0.0, 0.0, "none"), (float("nan"), 1.0, 1.0, "none")]
    df = spark.createDataFrame(rows, "l double, w double, h double, name string")
    for a, b in (("l", "w"), ("w", "l")):
        kind, sure = G.extent_class(F.col(a), F.col(b), F.col("h"))
        for r in df.select("name", kind.alias("k"), sure.alias("c")).collect():
            assert C.OBJECTS[r.k] == r.name and (r.c > 0) == (r.k > 0)


def test_grouped_collapse(spark):
    p = [0.0125] * 12
    for i in (4, 5, 6, 7, 8):
        p[i] = 0.15
    p[2] = 0.20
    got = semantics.collapse(spark.createDataFrame([(1, [math.log(v) for v in p])], "id int, logits array<double>")).first()
    assert (got.label, got.fine) == (4, 2) and got.confidence > 0.7


def test_dbscan():
    rng = np.random.default_rng(0)
    xy = np.concatenate([rng.normal(c, 0.2, (n, 2)) for c, n in (((0, 0), 35), ((6, 2), 45), ((-5, 4), 25))] + [np.array([[20, 20], [-20, 9], [15, -15]])])
    name = clusters.dbscan_labels(xy, 0.8, 5)
    assert len(set(name) - {-1}) == 3 and (name[-3:] == -1).all()
    assert all(np.linalg.norm(xy[name == k].mean(0) - c) < 0.3 for k, c in zip(sorted(set(name) - {-1}), ((0, 0), (6, 2), (-5, 4))))


def test_assignment():
    import itertools

    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 5), (5, 3), (6, 6), (0, 4)):
        cost = rng.random((n, m))
        got = tracking.assign(cost)
        assert len(got) == min(n, m)
        if n and m:
            small, big = (cost, m) if n <= m else (cost.T, n)
            best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(big), min(n, m)))
            assert sum(cost[i, j] for i, j in got) == pytest.approx(best)


def box(i, *xywh):
    return tracking.Detection.of_box(i, *xywh)


def test_movers():
    tracker, seen = tracking.MoverTracker(), {}
    for f in range(60):
        for m in tracker.update([box(0, 25.0, -8 + 0.14 * f, 0.5, 0.5), box(1, 39 - 0.8 * f, -4.0, 4.5, 1.9), box(2, 10.0, 3.0, 0.6, 0.6)]):
            seen.setdefault(m["track_id"], []).append(m)
    assert len(seen) == 2 and all(len(v) >= 20 for v in seen.values())
    assert {round(v[-1]["speed"], 1) for v in seen.values()} == {1.4, 8.0}


def test_mover_rules():
    """Speed of exactly the least is none; growth since the oldest sight rules out; a miss coasts and speed is taken from
    there; the fourth miss in a row ends a track; what was left beyond the reach is not looked at."""
    def confirmed(boxes, sensor=(0.0, 0.0)):
        tracker = tracking.MoverTracker()
        return [m for b in boxes for m in tracker.update([box(0, *b)] if b else [], None, sensor)], tracker

    steady = [(0.2 * f, 0.0, 0.5, 0.5) for f in range(20)]
    assert confirmed(steady)[0]
    assert not confirmed([(0.125 * 0.8 * f, 0.0, 0.5, 0.5) for f in range(20)])[0]
    assert not confirmed([(0.2 * f, 0.0, 0.5 + 0.25 * f, 0.5) for f in range(20)])[0]
    assert not confirmed(steady, sensor=(60.0, 0.0))[0]
    _, tracker = confirmed([(0.0, 0.0, 0.5, 0.5), (0.2, 0.0, 0.5, 0.5), None, (0.6, 0.0, 0.5, 0.5)])
    track = tracker.tracks[0]
    assert track.vx == pytest.approx(0.6 * 2.0 + 0.4 * 2.0) and track.misses == 0 and track.age == 4
    assert confirmed([*steady[:3], None, None, None])[1].tracks and not confirmed([*steady[:3], None, None, None, None])[1].tracks


def test_kalman_states():
    """One box at 2 m/s: the first states, worked out by hand from the fixed values."""
    state, got = tracking.Kalman(0, (0.0, 5.0, 2.0, 1.5)), []
    for f in range(1, 11):
        state.predict()
        state.update((0.2 * f, 5.0, 2.0, 1.5))
        got.append((state.x[0], state.x[4]))
    x, v, p = 0.0, 0.0, np.array([[1.0, 0.0], [0.0, 10.0]])
    for f in range(1, 11):
        x, p = x + 0.1 * v, np.array([[p[0, 0] + 0.2 * p[0, 1] + 0.01 * p[1, 1] + 0.05, p[0, 1] + 0.1 * p[1, 1]], [p[0, 1] + 0.1 * p[1, 1], p[1, 1] + 0.5]])
        k = p[:, 0] / (p[0, 0] + 0.1)
        off = 0.2 * f - x
        x, v = x + k[0] * off, v + k[1] * off
        p = p - np.outer(k, p[0])
        assert got[f - 1] == pytest.approx((x, v))
    assert [round(v, 2) for _, v in got[:4]] == [0.16, 0.75, 1.27, 1.56]


def test_movers_from_points(spark):
    from pointloom import catalogue

    out = catalogue.queries()["movers_of_points"](spark, "/root/testdata/sf0.001").collect()
    assert {r.det_id for r in out} and {round(r.speed, 1) for r in out} <= {1.5, 2.0} and all(r.n_points >= 8 for r in out)


def test_trackers_take_all_detections(spark):
    """Every detection reaches the registered trackers: in the first frame each box is a track of its own."""
    from pointloom import catalogue
    from pointloom.plans import views

    sf = "/root/testdata/sf0.001"
    first = views.view(spark, sf, "detections").where("frame_ts = 1").collect()
    key = lambda r, x, y: (r.sensor_id, *(round(float(v), 6) for v in (x, y, r.dx, r.dy)))
    tracks = catalogue.queries()["sort_tracks"](spark, sf).where("frame_ts = 1").collect()
    assert first and {key(r, r.x, r.y) for r in first} <= {key(r, r.cx, r.cy) for r in tracks}


def test_sort():
    """Three things for ten frames, one missed now and then: three ids from the first frame on, speeds near the truth."""
    tracker, ids = tracking.SortTracker(), []
    for f in range(10):
        t = f * 0.1
        seen = [(2.0 * t, 5.0, 2.0, 1.5), (10.0 - 0.5 * t, 1.0 * t, 0.8, 0.8), (0.0, 15.0, 1.2, 1.2)]
        ids.append({x["track_id"]: x for x in tracker.update(seen)})
    assert all(set(x) == {0, 1, 2} for x in ids)
    assert ids[-1][0]["vx"] == pytest.approx(2.0, abs=0.5) and ids[-1][1]["vy"] == pytest.approx(1.0, abs=0.5) and abs(ids[-1][2]["vx"]) < 0.1
    late = tracking.SortTracker()
    late.skip(5)
    assert [len(late.update([(0.0, 0.0, 1.0, 1.0)])) for _ in range(3)] == [0, 1, 1]  # shown from its second hit in a row on


def loop_points(spark, n=400):
    rng = random.Random(6)
    rows, seq = [], {}
    for _ in range(n):
        f = rng.choice((1, 2, 3, 40, 41, 100, 101, 160, 161, 200))
        seq[f] = seq.get(f, -1) + 1
        rows.append((f, seq[f], round(rng.uniform(-3, 3), 2) + 0.013, round(rng.uniform(-3, 3), 2) + 0.013, round(rng.uniform(-0.1, 1), 3), rng.randrange(7)))
    return rows


def key_rows(cells):
    return sorted((r.level, r.ix, r.iy, r.hit_count, r.obstacle_flag, round(r.traversability, 9), round(r.h_mean, 9), round(r.h_var, 9), r.last_update_ts, r.carve_ts) for r in cells.collect())


@pytest.mark.parametrize("cuts", [[200], [3, 41, 101, 200], [1, 2, 3, 40, 41, 100, 101, 160, 161, 200]])
def test_live_map_is_the_batch_map(spark, tmp_path, cuts):
    """One, few and many batches, and a batch that runs twice, give the map of one batch."""
    from pointloom.streaming import live

    rows = loop_points(spark)
    points = spark.createDataFrame(rows, POINTS)
    poses = spark.createDataFrame([(f, 0.0, 0.0, 0.0) for f in sorted({r[0] for r in rows})], POSES)
    gated = fold.gate_points(points, poses, C.SELF_RANGE)
    whole = fold.upsert(fold.fold_with_restart(gated), clusters.carve(gated))
    want = key_rows(age.evict(age.age(classify.classify(whole, 0.0), 230), 0.0, 0.0))
    kept = live.LiveMap(spark, f"file://{tmp_path}/map")
    low = 0
    for n, high in enumerate(cuts):
        for _ in range(1 + (n == 1)):
            kept.add(n, gated.where(f"frame_ts > {low} and frame_ts <= {high}"))
        low = high
    assert key_rows(kept.at(230, 0.0, 0.0, 0.0)) == want
    assert sum(1 for _ in (tmp_path / "map/tiles").iterdir()) <= 2  # what later lists replace is gone


def test_live_map_goes_on(spark, tmp_path):
    """A second run over the same folder takes up where the first ended, and reads only what is new."""
    from pointloom.streaming import live

    rows = loop_points(spark)
    poses = spark.createDataFrame([(f, 0.0, 0.0, 0.0) for f in sorted({r[0] for r in rows})], POSES)
    for low, high in ((0, 41), (41, 300)):
        spark.createDataFrame([r for r in rows if low < r[0] <= high], POINTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/scans")
        stream = spark.readStream.schema(POINTS).parquet(f"{tmp_path}/scans")
        kept = live.run(spark, stream, poses, f"file://{tmp_path}/map")
    gated = fold.gate_points(spark.createDataFrame(rows, POINTS), poses, C.SELF_RANGE)
    whole = fold.upsert(fold.fold_with_restart(gated), clusters.carve(gated))
    assert key_rows(kept.at(230, 0.0, 0.0, 0.0)) == key_rows(age.evict(age.age(classify.classify(whole, 0.0), 230), 0.0, 0.0))
    assert kept.publish(230, 0.0, 0.0, 0.0, 8.0, 0.5).count() > 0
    kept.reset()
    assert kept.cells().count() == 0 and kept.batches() == []


def test_metrics(spark):
    matrix = spark.createDataFrame([(0, 0, 8), (0, 1, 2), (1, 1, 5), (2, 0, 5)], "gt int, pred int, n long")
    got = {r["class"]: r.iou for r in metrics.overlap(matrix).collect()}
    assert got == {0: 8 / 15, 1: 5 / 7, 2: 0}
    one = metrics.accuracy(matrix).first()
    assert one.accuracy == 13 / 20 and one.majority == 0.5 and one.miou == pytest.approx((8 / 15 + 5 / 7) / 3)


def test_dbscan_in_frames():
    """Cells, runs of core points and frames side by side against the plain definition."""
    rng = np.random.default_rng(3)
    for eps, least in ((0.3, 3), (0.5, 6), (1.0, 1)):
        n = 250
        xy, frame = np.round(rng.normal(0, 1.2, (n, 2)), 2), np.sort(rng.integers(0, 4, n))
        near = (((xy[:, None] - xy[None]) ** 2).sum(2) <= eps * eps) & (frame[:, None] == frame[None])
        core = near.sum(1) >= least
        want = np.full(n, -1)
        for i in range(n):
            if core[i] and want[i] < 0:
                stack = [i]
                while stack:
                    j = stack.pop()
                    if want[j] < 0:
                        want[j] = i
                        stack += [k for k in np.flatnonzero(near[j] & core) if want[k] < 0]
        for i in np.flatnonzero(~core):
            at = want[near[i] & core]
            want[i] = at.min() if len(at) else -1
        assert (clusters.dbscan_labels(xy, eps, least, frame) == want).all()


def test_percentiles(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 5000), ("d", 7)) for v in (np.full(n, 3.0) if g == "d" else rng.normal(size=n))] + [("c", None), (None, 2.5)]
    got = {r.g: (r.low, r.mid) for r in metrics.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"low": 0.01, "mid": 0.5}).collect()}
    for g in ("a", "b", "c", "d", None):
        assert got[g] == pytest.approx(tuple(np.percentile([v for h, v in rows if h == g and v is not None], (1, 50))))


def test_segmentation_in_sessions(spark):
    """A network in a session of its own gives what the same network in expressions gives; another shape raises."""
    from pointloom.operators import segment

    rng = random.Random(2)
    rows = [(f, i, rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-1, 2), 0.5) for f in (1, 2) for i in range(200)]
    points = spark.createDataFrame(rows, "frame_ts int, idx long, x double, y double, z double, intensity double")
    plain = dict.fromkeys(segment.CHANNELS, 0.0), dict.fromkeys(segment.CHANNELS, 1.0)

    def load():
        def run(image):
            z = image[3]
            fine = np.select([z < -0.5, z < 0.0, z < 0.5, z < 1.0, z < 1.5], [0, 2, 3, 5, 6], 8)
            return np.where(np.arange(12)[:, None, None] == fine, 4.0, 0.0)

        return run

    key = lambda df: sorted((r.frame_ts, r.idx, r.label, r.obj_class, round(r.confidence, 5), r.fine) for r in df.collect())
    got = key(segment.segment(points, segment.session_network(load, 16, 64, *plain), 16, 64))
    assert got == key(segment.segment(points, semantics.stub_logits, 16, 64)) and len({r[2] for r in got}) > 2
    with pytest.raises(Exception, match="one logit"):
        segment.segment(points, segment.session_network(lambda: lambda image: image, 16, 64, *plain), 16, 64).collect()
