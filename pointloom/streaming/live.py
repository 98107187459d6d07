"""The live map: micro-batches of scans folded into a keyed table of cells, and read as a map of any frame.

The table holds sums, which merge, and never scores: scores, fading and eviction depend on the frame that the map is
read for, so a cell that no scan touches is never written again.  Cells lie in tiles; a batch rewrites the tiles it
touches, under its own number, and then the list of tiles that says which batch holds the newest of each.  A batch that
is run again after a failure reads the list before it and overwrites its own files, so it counts once, also when
another driver goes on from the same folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import age, classify, clusters, raster
from ..operators import fold as fold_ops

KEY = fold_ops.KEY
#: Cells along the side of a tile, as a power of two.
TILE_BITS = 8
SUMS = "level int, ix long, iy long, hit_count long, h_min double, h_max double, h_mean double, m2 double, last long, since int, carve_first int, carve_ts int"
TILES = "tile string, batch long"


def tile() -> Column:
    return F.concat_ws("_", "level", F.shiftright("ix", TILE_BITS), F.shiftright("iy", TILE_BITS))


class LiveMap:
    """The map kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        files, path = self._path(name)
        return files.exists(path)

    def batches(self) -> list[int]:
        """Numbers of the batches whose list of tiles is complete."""
        files, path = self._path("tiles")
        if not files.exists(path):
            return []
        found = [int(s.getPath().getName().removeprefix("batch-")) for s in files.listStatus(path)]
        return sorted(n for n in found if self._exists(f"tiles/batch-{n}/_SUCCESS"))

    def tiles(self, before: int | None = None) -> DataFrame:
        """(tile, batch) of the newest complete list, or of the newest before a batch."""
        known = [n for n in self.batches() if before is None or n < before]
        return self.spark.read.schema(TILES).parquet(f"{self.folder}/tiles/batch-{known[-1]}") if known else self.spark.createDataFrame([], TILES)

    def sums(self, tiles: DataFrame) -> DataFrame:
        """The cells of tiles as those batches wrote them."""
        if not self._exists("cells"):
            return self.spark.createDataFrame([], SUMS)
        rows = self.spark.read.schema(SUMS + ", batch long, tile string").parquet(f"{self.folder}/cells")
        return rows.join(tiles, ["tile", "batch"], "left_semi").drop("tile", "batch")  # prunes the folders

    def add(self, number: int, gated: DataFrame) -> None:
        """Folds the gated points of a batch in: all of a frame's points are in one batch, and frames come in order."""
        new, carved = fold_ops.last_island(gated), clusters.carve(gated).withColumnRenamed("carve_first", "first").withColumnRenamed("carve_ts", "latest")
        place = f"{self.folder}/batches/batch-{number}"
        new.join(carved, KEY, "full").withColumn("tile", tile()).write.mode("overwrite").parquet(place)
        batch = self.spark.read.parquet(place)
        touched = batch.select("tile").distinct()
        known = self.tiles(before=number)
        old = self.sums(known.join(touched, "tile", "left_semi"))
        hit = fold_ops.merged(old.where("hit_count > 0").select(*KEY, *fold_ops.SUMS), batch.where("hit_count is not null"))
        free = old.select(*KEY, "carve_first", "carve_ts").join(batch.where("latest is not null").select(*KEY, "first", "latest"), KEY, "full")
        earliest = F.when(F.coalesce("carve_first", F.lit(0)) > 0, F.col("carve_first")).otherwise(F.col("first"))
        free = free.select(*KEY, F.coalesce(earliest, F.lit(0)).alias("carve_first"), F.greatest(F.coalesce("carve_ts", F.lit(0)), F.coalesce("latest", F.lit(0))).alias("carve_ts"))
        cells = hit.join(free, KEY, "full").select(*KEY, F.coalesce("hit_count", F.lit(0)).alias("hit_count"), *(fold_ops.SUMS[1:]), F.coalesce("carve_first", F.lit(0)).alias("carve_first"), F.coalesce("carve_ts", F.lit(0)).alias("carve_ts"))
        cells.withColumn("tile", tile()).repartition("tile").write.mode("overwrite").partitionBy("tile").parquet(f"{self.folder}/cells/batch={number}")
        fresh = known.join(touched, "tile", "left_anti").unionByName(touched.withColumn("batch", F.lit(number).cast("long")))
        fresh.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/tiles/batch-{number}")  # a row for each tile of the map
        self._tidy(number)

    def _tidy(self, number: int) -> None:
        """Removes what neither this list of tiles nor the one before it names."""
        done = self.batches()[-2:]
        named = {r.batch for n in done for r in self.spark.read.schema(TILES).parquet(f"{self.folder}/tiles/batch-{n}").select("batch").distinct().collect()}
        for kind, prefix, keep in (("cells", "batch=", named), ("tiles", "batch-", set(done)), ("batches", "batch-", {number})):
            files, path = self._path(kind)
            for s in files.listStatus(path) if files.exists(path) else ():
                if s.getPath().getName().startswith(prefix) and int(s.getPath().getName().removeprefix(prefix)) not in keep:
                    files.delete(s.getPath(), True)

    def reset(self) -> None:
        """Forgets the map."""
        for name in ("cells", "tiles", "batches", "checkpoint"):
            files, path = self._path(name)
            files.delete(path, True)

    def cells(self) -> DataFrame:
        """The cells with their statistics, hit or carved."""
        rows = self.sums(self.tiles())
        hit = fold_ops.of_sums(rows.where("hit_count > 0"))
        return fold_ops.upsert(hit, rows.where("carve_ts > 0").select(*KEY, "carve_first", "carve_ts"))

    def at(self, frame: int, robot_x: float, robot_y: float, ground: float, margin: float = 20.0) -> DataFrame:
        """The map as a robot has it in a frame: judged, faded and without what is out of reach."""
        return age.evict(age.age(classify.classify(self.cells(), ground), frame), robot_x, robot_y, margin)

    def publish(self, frame: int, robot_x: float, robot_y: float, ground: float, size: float = 100.0, res: float = 0.2) -> DataFrame:
        """Writes the cost raster of a frame in the place of the last one, and returns it."""
        place = f"{self.folder}/published"
        raster.cost_raster(self.at(frame, robot_x, robot_y, ground), robot_x, robot_y, frame, size, res).withColumn("frame_ts", F.lit(frame)).write.mode("overwrite").parquet(place)
        return self.spark.read.parquet(place)


def run(spark: SparkSession, points: DataFrame, poses: DataFrame, folder: str, every: str | None = None, self_range: float = C.SELF_RANGE, publish=None) -> LiveMap:
    """Runs a stream of points into the map of a folder, to its end, or with every ("2 seconds") on a timer until it is
    stopped; publish(map, batch number) is called after each batch.  The folder keeps the checkpoint too."""
    live = LiveMap(spark, folder)

    def step(batch: DataFrame, number: int) -> None:
        live.add(number, fold_ops.gate_points(batch, poses, self_range))
        if publish is not None:
            publish(live, number)

    stream = points.writeStream.foreachBatch(step).option("checkpointLocation", f"{live.folder}/checkpoint")
    query = (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()
    query.awaitTermination()
    return live
