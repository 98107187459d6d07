"""Simulated scans, the tracker on a stream, and the join in time."""

import math

from pyspark.sql import functions as F

from pointloom.operators import asof, rangeimage, tracking
from pointloom.sources import simulate
from pointloom.streaming import movers

BOXES = "name string, cx double, cy double, vx double, vy double, sx double, sy double, h double, label int"


def test_beams(spark):
    scan = simulate.beams(spark, 2, columns=64)
    got = scan.agg(F.countDistinct("frame_ts").alias("f"), F.min(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("lo"), F.max("z").alias("top"), F.count("*").alias("n")).first()
    assert got.f == 2 and got.lo >= 0.3 and got.n > 2000
    assert sorted(map(tuple, scan.collect())) == sorted(map(tuple, simulate.beams(spark, 2, columns=64).repartition(5).collect()))


def test_scene_hides_what_is_behind(spark):
    boxes = spark.createDataFrame([("near", 10.0, 0.0, 0.0, 0.0, 2.0, 8.0, 2.0, 4), ("behind", 20.0, 0.0, 0.0, 0.0, 2.0, 4.0, 2.0, 4), ("aside", 0.0, 15.0, 0.0, 1.0, 2.0, 2.0, 2.0, 4)], BOXES)
    got = {(r.frame_ts, r.name): r for r in simulate.scene(spark, boxes, 11).groupBy("frame_ts", "name").agg(F.count("*").alias("n"), F.avg("y").alias("y")).collect()}
    assert (1, "near") in got and (1, "behind") not in got
    assert abs(got[11, "aside"].y - got[1, "aside"].y - 1.0) < 0.2
    assert simulate.scene(spark, boxes, 1, occlusion=False).where("name = 'behind'").count() > 50


def test_projection_of_pixel_centres(spark):
    """Returns at the centres of pixels come back to the same pixels, and nearer ones win."""
    table = rangeimage.directions(spark, 16, 64).withColumn("r", 3.0 + (F.col("u") % 7))
    points = table.select(F.lit(1).alias("frame_ts"), (F.col("v") * 64 + F.col("u")).cast("long").alias("idx"), *((F.col(f"d{c}") * F.col("r")).alias(c) for c in "xyz"), F.lit(1).alias("label"))
    projected = rangeimage.project(points, 16, 64)
    assert projected.where("v * 64 + u <> idx").count() == 0
    twice = rangeimage.project(points.unionByName(points.withColumn("idx", F.col("idx") + 5000).withColumn("x", F.col("x") * 2).withColumn("y", F.col("y") * 2).withColumn("z", F.col("z") * 2)), 16, 64)
    assert rangeimage.z_buffer(twice).where("idx >= 5000").count() == 0


def test_stream_of_movers_equals_batch(spark, tmp_path):
    rows = [(s, f, i, 0.2 * f * (i - 1) + 20 * s, 9.0 * i, 0.8, 0.8) for s in range(2) for f in range(1, 40) for i in range(3)]
    schema = "sensor_id long, frame_ts int, det_id long, cx double, cy double, dx double, dy double"
    detections = spark.createDataFrame(rows, schema)
    for k in range(3):
        detections.where(f"frame_ts between {13 * k + 1} and {13 * k + 13}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(detections.schema).option("maxFilesPerTrigger", "1").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    query = movers.track(stream).writeStream.format("memory").queryName("movers").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r.sensor_id, r.frame_ts, r.track_id, round(r.vx, 6))
    got, want = sorted(map(key, spark.table("movers").collect())), sorted(map(key, tracking.movers(detections, by=("sensor_id",)).collect()))
    assert got == want and len({t for _, _, t, _ in want}) >= 2


def test_as_of(spark):
    left = spark.createDataFrame([(k, 0.7 * i) for k in range(2) for i in range(40)] + [(0, 0.7)], "k int, t double")
    right = spark.createDataFrame([(k, 1.3 * i, i) for k in range(2) for i in range(15)], "k int, t double, fix int")
    for r in asof.latest_within(left, right, ["k"], "t", 0.9, ["fix"]).collect():
        fits = [i for i in range(15) if 1.3 * i <= r.t and r.t - 1.3 * i <= 0.9]
        assert r.fix == (max(fits) if fits else None)
    assert math.isclose(asof.latest_within(left, right, ["k"], "t", 0.9, ["fix"]).count(), left.count())
