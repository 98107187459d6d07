"""Readers, writers and the stream."""

import numpy as np
import pytest

from pointloom.operators import fold
from pointloom.sources import clouds
from pointloom.streaming import live


def scans(root):
    rng = np.random.default_rng(0)
    for seq in ("00001", "00002"):
        for k in range(2):
            for folder, suffix, data in (("os1_cloud_node_kitti_bin", "bin", rng.normal(size=(50, 4)).astype("<f4")), ("labels", "label", (np.arange(50) + (3 << 16)).astype("<u4")), ("vel_cloud_node_kitti_bin", "bin", rng.normal(size=(5, 4)).astype("<f4"))):
                p = root / seq / folder
                p.mkdir(parents=True, exist_ok=True)
                (p / f"s{seq}{k}.{suffix}").write_bytes(data.tobytes())


def test_clouds(spark, tmp_path):
    scans(tmp_path)
    found = clouds.discover(spark, str(tmp_path)).collect()
    assert len(found) == 4 and {r.seq for r in found} == {"00001", "00002"}
    points = clouds.read_clouds(spark, str(tmp_path / "00001" / "os1_cloud_node_kitti_bin"))
    labels = clouds.read_labels(spark, str(tmp_path / "00001" / "labels"))
    both = clouds.zip_labels(points, labels).orderBy("scan", "idx").collect()
    assert len(both) == 100 and all((r.label, r.instance) == (r.idx, 3) for r in both)
    raw = np.frombuffer((tmp_path / "00001/os1_cloud_node_kitti_bin/s000010.bin").read_bytes(), "<f4").reshape(-1, 4)
    assert [r.x for r in both[:50]] == raw[:, 0].tolist()
    with pytest.raises(Exception, match="differ in scan"):
        clouds.zip_labels(points, labels.where("idx < 49")).collect()


def test_broken_file(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole rows"):
        clouds.read_clouds(spark, str(tmp_path)).collect()


def test_split(spark, tmp_path):
    (tmp_path / "pt_val.lst").write_text("# head\n00001/os1/a.bin 00001/labels/a.label\n\n00002/os1/b.bin  x # more\n")
    split = clouds.read_split(spark, str(tmp_path / "pt_val.lst"))
    assert [tuple(r) for r in split.collect()] == [("00001/os1/a.bin", "00001/labels/a.label"), ("00002/os1/b.bin", "x")]
    assert [r.scan for r in clouds.restrict(spark.createDataFrame([("a",), ("c",)], "scan string"), split).collect()] == ["a"]
    (tmp_path / "bad.lst").write_text("one\n")
    with pytest.raises(Exception, match="one column only"):
        clouds.read_split(spark, str(tmp_path / "bad.lst")).collect()


def test_messages(spark):
    kind = np.dtype({"names": ["x", "y", "z", "label"], "formats": ["<f4", "<f4", "<f4", "<u2"], "offsets": [0, 4, 8, 14], "itemsize": 18})
    data = np.zeros(3, kind)
    data["x"], data["label"] = [1, 2, 3], [4, 5, 999]
    fields = [("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("label", 14, 4)]
    good = (1, 18, False, fields, data.tobytes())
    rows = [good, (2, 18, True, fields, data.tobytes()), (3, 18, False, fields[1:], data.tobytes()), (4, 18, False, fields, b"123"), (5, 18, False, fields, None)]
    messages = spark.createDataFrame([(a, b, c, f, bytearray(d) if d else None) for a, b, c, f, d in rows], "frame_ts int, point_step int, big_endian boolean, fields array<struct<name:string,offset:int,datatype:int>>, data binary")
    assert [(r.frame_ts, r.seq, r.x, r.label) for r in clouds.decode_messages(messages).collect()] == [(1, 0, 1.0, 4), (1, 1, 2.0, 5), (1, 2, 3.0, 255)]


def test_dataset(spark, tmp_path):
    """Scans in order, labels beside them, a limit on files, and label spaces."""
    from pointloom import config as C

    scans(tmp_path)
    found = clouds.discover(spark, str(tmp_path))
    paths = [r.path for r in found.collect()]
    assert paths == sorted(paths)
    assert [r.path for r in clouds.first_scans(found, 2).collect()] == paths[:2] and [r.path for r in clouds.last_scans(found, 1).collect()] == paths[-1:]
    labels = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.label").load(str(tmp_path)).select("path")
    beside = {r.scan: r.label_path for r in clouds.with_labels(found, labels).collect()}
    assert all(p.endswith(f"/labels/{scan}.label") for scan, p in beside.items())
    expected = {r.scan: r.label_path for r in clouds.with_labels(found, labels.limit(0)).collect()}
    assert all(p.endswith(f"/{clouds.LABEL_FOLDERS[0]}/{scan}.label") for scan, p in expected.items())
    for f in tmp_path.glob("*/vel_cloud_node_kitti_bin/*"):
        f.unlink()
    found = clouds.discover(spark, str(tmp_path))
    raw = clouds.dataset(spark, str(tmp_path), "raw")
    fine, adl1 = (clouds.dataset(spark, str(tmp_path), s) for s in ("fine", "adl1"))
    assert raw.count() == 200 and clouds.dataset(spark, str(tmp_path), limit=1).select("scan").distinct().count() == 1
    assert {(r.idx, r.label) for r in fine.collect()} == {(i, C.RAW_TO_FINE.get(i, 255)) for i in range(50)}
    assert {r.label for r in adl1.collect()} <= {*C.LABEL_OF_FINE, C.UNKNOWN}
    audit = {(r.seq, r.folder, r.suffix): r.files for r in clouds.layout(found.select("path")).collect()}
    assert audit == {(s, "os1_cloud_node_kitti_bin", "bin"): 2 for s in ("00001", "00002")}


def test_empty_split(spark, tmp_path):
    (tmp_path / "none.lst").write_text("# only a note\n\n")
    with pytest.raises(ValueError, match="no scan"):
        clouds.read_split(spark, str(tmp_path / "none.lst"))


def test_csv_and_settings(spark, tmp_path):
    (tmp_path / "scene.csv").write_text("x,y,z,label\n1.5,2,-0.25,4\n")
    assert [tuple(r) for r in clouds.read_csv(spark, str(tmp_path / "scene.csv")).collect()] == [(1.5, 2.0, -0.25, 4)]
    (tmp_path / "meta.json").write_text('{"H": 32, "fov_up": 15}')
    assert clouds.geometry(clouds.read_config(str(tmp_path / "meta.json"))) == {"height": 32, "width": 1024, "up": 15.0, "down": -22.5}
    clouds.write_json(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).collect()[0].s == "a"


def test_shards_go_on(spark, tmp_path):
    """A sequence that a broken run left behind is written again; one that is done is not."""
    rows = [("train", f"s{k}", f, f, 0, 1000 * (k + 1) + f, 255, 1) for k in range(3) for f in range(4)]
    pixels = spark.createDataFrame(rows, "split string, seq string, frame_ts int, v int, u int, range_q int, intensity_q int, label int")
    place = f"{tmp_path}/cache"
    assert clouds.write_shards(pixels.where("seq = 's0'"), place) == 1
    pixels.where("seq = 's1'").limit(1).write.mode("append").partitionBy("split", "seq").parquet(f"{place}/shards")  # not listed as done
    assert {r.seq for r in clouds.read_shards(spark, place).collect()} == {"s0"}
    assert clouds.write_shards(pixels, place) == 2 and clouds.write_shards(pixels, place) == 0
    got = clouds.read_shards(spark, place).collect()
    assert sorted((r.split, r.seq, r.frame_ts, r.range_q) for r in got) == sorted((r[0], r[1], r[2], r[5]) for r in rows)
    assert all(r.mask and r.intensity == 1 and abs(r.range - r.range_q * 0.002) < 1e-9 for r in got)


def test_messages_without_points(spark):
    rows = [(f, s, float(s), 0.5, -1.0, 0.25, 3, 1, 0.75) for f in (1, 2) for s in range(5)]
    points = spark.createDataFrame(rows, "frame_ts int, seq int, x float, y float, z float, intensity float, label int, obj_class int, conf float")
    whole = clouds.packed(points)
    left = clouds.without_points(whole, spark.createDataFrame([(1, 0), (1, 3), (2, 99)], "frame_ts int, seq int"))
    data = {r.frame_ts: bytes(r.data) for r in whole.collect()}
    cut = {r.frame_ts: bytes(r.data) for r in left.collect()}
    assert len(data[1]) == 5 * 24 and cut[2] == data[2]
    assert cut[1] == b"".join(data[1][24 * s : 24 * s + 24] for s in (1, 2, 4))
    record = np.frombuffer(data[1], clouds.RECORD)[3]
    assert (record["x"], record["label"], record["obj_class"], record["conf"]) == (3.0, 3, 1, 0.75)


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(i // 40), i % 40, *map(float, rng.uniform(-20, 20, 2)), float(rng.uniform(-1, 2)), int(rng.integers(0, 9))) for i in range(600)]
    points = spark.createDataFrame(rows, "frame_ts int, seq long, x double, y double, z double, label int")
    poses = spark.createDataFrame([(f, 0.0, 0.0, 0.0) for f in range(15)], "frame_ts int, robot_x double, robot_y double, ground_z double")
    for k in range(3):
        points.where(f"frame_ts between {5 * k} and {5 * k + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    seen = []
    key = lambda r: (r.level, r.ix, r.iy, r.hit_count, round(r.h_mean, 9), round(r.h_var, 9), r.semantic_label, r.last_update_ts)
    kept = live.run(spark, stream, poses, f"file://{tmp_path}/map", self_range=0.0, publish=lambda m, n: seen.append(n))
    assert seen == [0, 1, 2]
    assert sorted(map(key, kept.cells().where("hit_count > 0").collect())) == sorted(map(key, fold.fold(fold.gate_points(points, poses)).collect()))
