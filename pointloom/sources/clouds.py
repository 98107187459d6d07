"""Readers and writers of scans: binary clouds and labels, packed cloud messages, point lists, split lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..runtime import ship

POINTS = "scan string, idx long, x float, y float, z float, intensity float"
LABELS = "scan string, idx long, label int, instance int"


def _scan(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+/)?[^/]+/([^/]+)\.[^./]+$", 2)


def sequence_of(path: Column) -> Column:
    """The folder above a scan's own folder: its sequence."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1)


def discover(spark: SparkSession, root: str, folder: str = "os1_cloud_node_kitti_bin", suffix: str = "bin") -> DataFrame:
    """(path, seq, scan) of the scans below root that lie in the given folder, and no others, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root)
    return files.select("path").where(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) == folder).select("path", sequence_of(F.col("path")).alias("seq"), _scan(F.col("path")).alias("scan")).orderBy("path")


#: Folders of labels beside a sequence's scans: the first that has a scan's file counts.
LABEL_FOLDERS = ("os1_cloud_node_semantickitti_label_id", "labels")


def with_labels(scans: DataFrame, labels: DataFrame, folders: tuple[str, ...] = LABEL_FOLDERS) -> DataFrame:
    """Scans (path, seq, scan) with label_path: of the label files (path) of the same sequence and scan the one in the
    first of the folders, else the place where it is expected."""
    found = labels.select(sequence_of(F.col("path")).alias("seq"), _scan(F.col("path")).alias("scan"), F.col("path").alias("label_path"), F.array_position(F.array(*map(F.lit, folders)), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("k"))
    best = found.where("k > 0").groupBy("seq", "scan").agg(F.min(F.struct("k", "label_path")).alias("m")).select("seq", "scan", F.col("m.label_path").alias("label_path"))
    expected = F.concat(F.regexp_extract("path", r"^(.*)/[^/]+/[^/]+$", 1), F.lit(f"/{folders[0]}/"), F.col("scan"), F.lit(".label"))
    return scans.join(best, ["seq", "scan"], "left").withColumn("label_path", F.coalesce("label_path", expected))


def first_scans(scans: DataFrame, n: int) -> DataFrame:
    """The first n files in order."""
    return scans.orderBy("path").limit(n)


def last_scans(scans: DataFrame, n: int) -> DataFrame:
    """The last n files in order."""
    return scans.orderBy(F.col("path").desc()).limit(n)


def layout(files: DataFrame) -> DataFrame:
    """Files by sequence, folder and suffix."""
    return files.groupBy(sequence_of(F.col("path")).alias("seq"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"\.([^./]+)$", 1).alias("suffix")).agg(F.count("*").alias("files"))


def split_layout(lines: DataFrame) -> DataFrame:
    """Lines of a split list (value) by their number of columns, comments left out."""
    text = F.trim(F.regexp_replace("value", "#.*", ""))
    return lines.where(text != "").groupBy(F.size(F.split(text, r"\s+")).alias("columns")).agg(F.count("*").alias("lines"))


def _decoded(kind: np.dtype, width: int, names: list[str], types: list[pa.DataType], split):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for scan, content in zip(b.column("scan").to_pylist(), b.column("content").to_pylist(), strict=True):
                if len(content) % (width * kind.itemsize):
                    raise ValueError(f"{scan}: {len(content)} bytes are not whole rows of {width} values")
                rows = np.frombuffer(content, kind).reshape(-1, width)
                for at in range(0, len(rows), 65536):
                    part = rows[at : at + 65536]
                    columns = [pa.array([scan] * len(part), pa.string()), pa.array(np.arange(at, at + len(part))), *(pa.array(c, t) for c, t in zip(split(part), types, strict=True))]
                    yield pa.RecordBatch.from_arrays(columns, names=["scan", "idx", *names])

    return run


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(path)
    return files.select(_scan(F.col("path")).alias("scan"), "content")


def read_clouds(spark: SparkSession, path: str) -> DataFrame:
    """Points of .bin files of little-endian single-precision x, y, z, intensity."""
    run = _decoded(np.dtype("<f4"), 4, ["x", "y", "z", "intensity"], [pa.float32()] * 4, lambda r: [np.ascontiguousarray(r[:, i]) for i in range(4)])
    return _files(spark, path, "bin").mapInArrow(run, POINTS)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of .label files: class in the low, instance in the high half of each 32-bit word."""
    run = _decoded(np.dtype("<u4"), 1, ["label", "instance"], [pa.int32()] * 2, lambda r: [(r[:, 0] & 0xFFFF).astype(np.int32), (r[:, 0] >> 16).astype(np.int32)])
    return _files(spark, path, "label").mapInArrow(run, LABELS)


def zip_labels(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Points with the label at the same place; a scan whose counts differ, or without labels, raises."""
    joined = points.join(labels, ["scan", "idx"], "full")
    whole = F.col("x").isNotNull() & F.col("label").isNotNull()
    return joined.withColumn("label", F.when(whole, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("points and labels differ in scan "), F.col("scan"))).cast("int")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A scene of points x, y, z, label."""
    return spark.read.csv(path, header=True, schema="x float, y float, z float, label smallint")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(cloud, label) of a split list: two columns a line, # starts a comment; a line of one column raises, and so does a
    list without lines."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("line")).where("line <> ''")
    if lines.isEmpty():
        raise ValueError(f"{path} names no scan")
    parts = F.split("line", r"\s+")
    return lines.select(F.when(F.size(parts) >= 2, parts[0]).otherwise(F.raise_error(F.concat(F.lit("one column only: "), F.col("line"))).cast("string")).alias("cloud"), F.try_element_at(parts, F.lit(2)).alias("label"))


def restrict(scans: DataFrame, split: DataFrame) -> DataFrame:
    """The scans that a split list names."""
    return scans.join(split.select(_scan(F.concat(F.lit("/"), "cloud")).alias("scan")).distinct(), "scan", "left_semi")


MESSAGE_KINDS = {2: "u1", 4: "<u2", 6: "<u4", 7: "<f4"}


def decode_messages(messages: DataFrame) -> DataFrame:
    """Points of packed messages (frame_ts, point_step, big_endian, fields array<struct<name, offset, datatype>>, data).

    A message that is big-endian, lacks a single-precision x, y or z, or whose size isn't whole points gives no rows.
    """
    ship(messages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.to_pylist():
                fields = {f["name"]: f for f in m["fields"] or ()}
                step, data = m["point_step"] or 0, m["data"] or b""
                sound = not m["big_endian"] and step >= 12 and len(data) % step == 0 and all(n in fields and fields[n]["datatype"] == 7 and fields[n]["offset"] + 4 <= step for n in "xyz")
                if not sound or not data:
                    continue
                raw = np.frombuffer(data, np.uint8).reshape(-1, step)
                at = lambda f: np.ascontiguousarray(raw[:, f["offset"] : f["offset"] + np.dtype(MESSAGE_KINDS[f["datatype"]]).itemsize]).view(MESSAGE_KINDS[f["datatype"]])[:, 0]
                label = np.zeros(len(raw), np.int32)
                if "label" in fields and fields["label"]["datatype"] in MESSAGE_KINDS:
                    label = np.minimum(at(fields["label"]).astype(np.float64), 255).astype(np.int32)
                columns = [pa.array(np.full(len(raw), m["frame_ts"], np.int32)), pa.array(np.arange(len(raw))), *(pa.array(at(fields[n])) for n in "xyz"), pa.array(label)]
                yield pa.RecordBatch.from_arrays(columns, names=["frame_ts", "seq", "x", "y", "z", "label"])

    return messages.select("frame_ts", "point_step", "big_endian", "fields", "data").mapInArrow(run, "frame_ts int, seq long, x float, y float, z float, label int")


def dataset(spark: SparkSession, root: str, space: str = "adl1", limit: int | None = None, folder: str = "os1_cloud_node_kitti_bin", label_folder: str = LABEL_FOLDERS[0]) -> DataFrame:
    """Labelled points of a dataset's scans in a label space; limit: of so many files, in order."""
    from ..operators import semantics

    scans = discover(spark, root, folder)
    points, labels = read_clouds(spark, root), read_labels(spark, root)
    if limit is not None:
        chosen = first_scans(scans, limit).select("scan")
        points, labels = (df.join(chosen, "scan", "left_semi") for df in (points, labels))
    return semantics.in_space(zip_labels(points, labels), space)


#: A labelled record: x, y, z, intensity, label, object class and confidence, 24 bytes.
RECORD = np.dtype({"names": ["x", "y", "z", "intensity", "label", "obj_class", "conf"], "formats": ["<f4", "<f4", "<f4", "<f4", "u1", "u1", "<f4"], "offsets": [0, 4, 8, 12, 16, 17, 20], "itemsize": 24})
_KIND_OF = {("f", 4): 7, ("u", 1): 2}
MESSAGE = "frame_ts int, point_step int, big_endian boolean, fields array<struct<name: string, offset: int, datatype: int>>, data binary"


def packed(points: DataFrame) -> DataFrame:
    """A message for each frame of points (frame_ts, seq, and the record's columns), in the order of seq."""
    ship(points.sparkSession)
    fields = [{"name": n, "offset": RECORD.fields[n][1], "datatype": _KIND_OF[RECORD.fields[n][0].kind, RECORD.fields[n][0].itemsize]} for n in RECORD.names]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        out = np.zeros(rows.num_rows, RECORD)
        for n in RECORD.names:
            out[n] = rows.column(n).to_numpy()
        kind = pa.list_(pa.struct([("name", pa.string()), ("offset", pa.int32()), ("datatype", pa.int32())]))
        return pa.table({"frame_ts": pa.array([key[0].as_py()], pa.int32()), "point_step": pa.array([RECORD.itemsize], pa.int32()), "big_endian": [False], "fields": pa.array([fields], kind), "data": pa.array([out.tobytes()], pa.binary())})

    return points.select("frame_ts", "seq", *RECORD.names).groupBy("frame_ts").applyInArrow(run, MESSAGE)


def without_points(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """The messages without the points (frame_ts, seq) that are gone; all bytes of the others stay as they are."""
    ship(messages.sparkSession)
    lists = gone.groupBy("frame_ts").agg(F.collect_set("seq").alias("_gone"))  # points of one scan
    columns = messages.columns
    schema = messages.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = []
            for raw, step, seqs in zip(b.column("data").to_pylist(), b.column("point_step").to_pylist(), b.column("_gone").to_pylist(), strict=True):
                rows = np.frombuffer(raw, np.uint8).reshape(-1, step)
                keep = np.ones(len(rows), bool)
                keep[[s for s in seqs or () if 0 <= s < len(rows)]] = False
                data.append(rows[keep].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()) if c == "data" else b.column(c) for c in columns], names=columns)

    return messages.join(lists, "frame_ts", "left").mapInArrow(run, schema)


def write_shards(pixels: DataFrame, path: str) -> int:
    """Range-image shards by split and sequence (split, seq, frame_ts, v, u, range_q, intensity_q, label); returns how
    many sequences were written.

    A sequence counts once its row is in the list of those done, so a run that broke off goes on with the others: what
    it left of an unfinished sequence is overwritten.
    """
    spark = pixels.sparkSession
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = f"{path}/done"
    listed = "split string, seq string"
    known = spark.read.schema(listed).parquet(done) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(done)) else spark.createDataFrame([], listed)
    left = pixels.join(known, ["split", "seq"], "left_anti")
    todo = [(r.split, r.seq) for r in left.select("split", "seq").distinct().collect()]  # sequences, a few dozen
    left.repartition("split", "seq", "frame_ts").sortWithinPartitions("split", "seq", "frame_ts", "v", "u").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "seq").parquet(f"{path}/shards")
    if todo:
        spark.createDataFrame(todo, listed).coalesce(1).write.mode("append").parquet(done)
    return len(todo)


def read_shards(spark: SparkSession, path: str, step: float = 0.002) -> DataFrame:
    """Pixels of the sequences that are done, with range in metres, intensity from 0 to 1, and whether there is a return."""
    rows = spark.read.option("inferSchema", "false").parquet(f"{path}/shards").withColumn("split", F.col("split").cast("string")).withColumn("seq", F.col("seq").cast("string"))
    rows = rows.join(spark.read.schema("split string, seq string").parquet(f"{path}/done"), ["split", "seq"], "left_semi")
    return rows.withColumn("range", F.col("range_q") * step).withColumn("intensity", F.col("intensity_q") / 255.0).withColumn("mask", F.col("range_q") > 0)


def read_config(path: str) -> dict:
    """A JSON file of settings, such as a network's geometry, norms or class weights, as the driver needs them."""
    import json

    with open(path, encoding="utf-8") as f:
        return json.load(f)


def geometry(meta: dict) -> dict:
    """Height, width and field of view of a network's side-car, with the usual ones where it is silent."""
    return {"height": int(meta.get("H", 64)), "width": int(meta.get("W", 1024)), "up": float(meta.get("fov_up", 22.5)), "down": float(meta.get("fov_down", -22.5))}


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON."""
    rows.write.mode("overwrite").json(path)


def write_cells(cells: DataFrame, path: str) -> None:
    """A snapshot of the map."""
    cells.write.mode("overwrite").parquet(path)


def markers(movers: DataFrame) -> DataFrame:
    """Box, arrow one second ahead and caption of each mover."""
    name = F.element_at(F.array(*map(F.lit, C.OBJECTS)), F.col("obj_class") + 1)
    said = F.when(F.col("obj_class") > 0, F.format_string("#%d %s %.1f m/s", "track_id", name, "speed")).otherwise(F.format_string("#%d %.1f m/s", "track_id", "speed"))
    height = F.greatest(F.col("z_hi") - F.col("z_lo"), F.lit(0.3))
    return movers.select("frame_ts", "track_id", "cx", "cy", (F.col("z_lo") + height / 2).alias("cz"), *(F.greatest(c, F.lit(0.3)).alias(f"size_{c[1]}") for c in ("dx", "dy")), height.alias("size_z"), (F.col("cx") + F.col("vx")).alias("ahead_x"), (F.col("cy") + F.col("vy")).alias("ahead_y"), "obj_class", said.alias("caption"))


def object_markers(points: DataFrame, most: int = 20_000, eps: float = 0.8, min_points: int = 5) -> DataFrame:
    """A box and a caption for each cluster of named points (frame_ts, seq, x, y, z, obj_class), class by class.

    Of a frame with more than most named points every k-th is taken, in order, so that about most are left.
    """
    from pyspark.sql import Window

    from ..operators import clusters

    frame = Window.partitionBy("frame_ts")
    named = points.where("obj_class > 0").withColumn("_n", F.count("*").over(frame)).withColumn("_k", F.row_number().over(frame.orderBy("seq")) - 1)
    thin = named.where((F.col("_n") <= most) | (F.col("_k") % F.greatest(F.floor(F.col("_n") / most), F.lit(1)) == 0))
    # a class of a frame is clustered as a frame of its own
    own = thin.select((F.col("frame_ts") * len(C.OBJECTS) + F.col("obj_class")).cast("int").alias("frame_ts"), "seq", "x", "y", "z")
    named = own.join(clusters.dbscan(own, eps, min_points).where("cluster is not null"), ["frame_ts", "seq"])
    found = clusters.boxes3(named, ["frame_ts", "cluster"])
    height = F.greatest(F.col("z_hi") - F.col("z_lo"), F.lit(0.3))
    kind = (F.col("frame_ts") % len(C.OBJECTS)).cast("int")
    name = F.element_at(F.array(*map(F.lit, C.OBJECTS)), kind + 1)
    return found.select(F.floor(F.col("frame_ts") / len(C.OBJECTS)).cast("int").alias("frame_ts"), kind.alias("obj_class"), "cluster", F.col("x_mean").alias("cx"), F.col("y_mean").alias("cy"), (F.col("z_lo") + height / 2).alias("cz"), F.greatest("dx", F.lit(0.3)).alias("size_x"), F.greatest("dy", F.lit(0.3)).alias("size_y"), height.alias("size_z"), (F.col("z_hi") + 0.6).alias("text_z"), F.format_string("%s (%d pts)", name, "n_points").alias("caption"))
