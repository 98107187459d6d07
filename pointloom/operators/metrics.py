"""Evaluation: confusion, overlap, recall, latencies, moments, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_bin(r: Column, edges: tuple[float, ...], right_closed: bool) -> Column:
    """Number of the bin: (lo, hi] if right_closed, else [lo, hi); null outside."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = (r > lo) & (r <= hi) if right_closed else (r >= lo) & (r < hi)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out.cast("int")


def confusion(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pairs.groupBy(*(by or []), "gt", "pred").agg(F.count("*").alias("n"))


def overlap(matrix: DataFrame) -> DataFrame:
    """IoU of each class that either side has, from (gt, pred, n); present: whether the truth has it."""
    rows = matrix.groupBy(F.col("gt").alias("class")).agg(F.sum("n").alias("in_gt"))
    columns = matrix.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("in_pred"))
    both = matrix.where("gt = pred").select(F.col("gt").alias("class"), F.col("n").alias("hit"))
    out = rows.join(columns, "class", "full").join(both, "class", "left")
    a, b, h = (F.coalesce(c, F.lit(0)) for c in ("in_gt", "in_pred", "hit"))
    return out.select("class", a.alias("in_gt"), b.alias("in_pred"), h.alias("hit"), (h / (a + b - h)).alias("iou"), (a > 0).alias("present"))


def accuracy(matrix: DataFrame) -> DataFrame:
    """Share of right predictions, of the commonest class, and the mean IoU over classes of the truth: one row."""
    total = F.sum("n")
    right = F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0))
    one = matrix.agg((right / total).alias("accuracy"), total.alias("n"))
    most = matrix.groupBy("gt").agg(F.sum("n").alias("k")).agg(F.max("k").alias("k"))
    mean = overlap(matrix).where("present").agg(F.avg("iou").alias("miou"))
    return one.join(F.broadcast(most), F.lit(True)).join(F.broadcast(mean), F.lit(True)).select("accuracy", (F.col("k") / F.col("n")).alias("majority"), "miou", "n")  # one row each


#: Steps of an error that are summed up apart; a class is so many sorted runs, not one.
STEPS = 1024


def lovasz(scores: DataFrame) -> DataFrame:
    """Lovász extension of the Jaccard loss by class, from (class, id, error, is_class): errors in falling order times
    the growth of the loss, ties by id.

    Errors are dealt out by class and step of their size; sums by step, a few rows for each class, tell what comes
    before a step, so only the rows of a step are sorted together.
    """
    placed = scores.withColumn("step", -F.floor(F.col("error") * STEPS))
    sums = placed.groupBy("class", "step").agg(F.sum("is_class").alias("hits"), F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("class", "step", F.coalesce(F.sum("hits").over(before), F.lit(0)).alias("hits_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.sum("hits").over(Window.partitionBy("class")).alias("total"))
    own = Window.partitionBy("class", "step").orderBy(F.col("error").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(offsets.where("total > 0"), ["class", "step"])
    hit = F.col("hits_before") + F.sum("is_class").over(own)
    n = F.col("n_before") + F.count("*").over(own)
    loss = lambda h, k: 1 - (F.col("total") - h) / (F.col("total") + k - h)
    was = F.when(n == 1, 0.0).otherwise(loss(hit - F.col("is_class"), n - 1))
    return rows.withColumn("term", F.col("error") * (loss(hit, n) - was)).groupBy("class").agg(F.sum("term").alias("loss"))


def percentiles(values: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles, between neighbours in proportion, of each group, whatever its size.

    Values are counted by step between the least and the greatest of the group; the steps that hold a percentile's two
    neighbours are found from these counts, and only their values are put in order.
    """
    v = F.col(value).cast("double")
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_by_{k}") for k in by]
    group = [f"_by_{k}" for k in by] or ["_all"]
    rows = values.where(F.col(value).isNotNull()).select(*(keys or [F.lit(0).alias("_all")]), *by, v.alias("_v"))
    ends = rows.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    step = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * STEPS), F.lit(STEPS - 1))).otherwise(0)
    placed = rows.join(ends, group).withColumn("_step", step)
    counts = placed.groupBy(*group, "_step").agg(F.count("*").alias("_k"), F.first("_n").alias("_n"))
    upto = F.sum("_k").over(Window.partitionBy(*group).orderBy("_step"))
    places = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(F.lit(p) * (F.col("_n") - 1)), F.ceil(F.lit(p) * (F.col("_n") - 1))) for p in shares.values()))))
    wanted = counts.withColumn("_before", upto - F.col("_k")).withColumn("_at", F.filter(places, lambda x: (x >= F.col("_before")) & (x < F.col("_before") + F.col("_k")))).where(F.size("_at") > 0)
    held = placed.drop("_n").join(wanted.select(*group, "_step", "_before", "_at", "_n"), [*group, "_step"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_step").orderBy("_v")) - 1
    found = held.withColumn("_place", place).where(F.array_contains("_at", F.col("_place")))
    whole = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_place", "_v"))).alias("_m"), F.first("_n").alias("_n"), *(F.first(k).alias(k) for k in by))  # two values a percentile
    out = []
    for name, p in shares.items():
        exact = F.lit(p) * (F.col("_n") - 1)
        low, high = F.element_at("_m", F.floor(exact)), F.element_at("_m", F.ceil(exact))
        out.append((low + (high - low) * (exact - F.floor(exact))).alias(name))
    return whole.select(*by, *out)


def latency(times: DataFrame, by: list[str], value: str = "ms") -> DataFrame:
    plain = times.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("most"), F.count("*").alias("n"))
    return plain.join(percentiles(times, by, value, {"p95": 0.95}), by).select(*by, "mean", "p95", "most", "n")


def object_scores(found: DataFrame, edges: tuple[float, ...] = (0.0, 10.0, 25.0, 40.0, 100.0)) -> DataFrame:
    """Share of right classes by range, from (true_class, found_class, range)."""
    binned = found.withColumn("range_bin", range_bin(F.col("range"), edges, right_closed=False))
    return binned.groupBy("range_bin").agg(F.count("*").alias("n"), F.avg((F.col("true_class") == F.col("found_class")).cast("double")).alias("accuracy"))


def moments(values: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of each column: one row, from sums that merge."""
    return values.agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.sqrt(F.greatest(F.var_pop(c), F.lit(0.0))).alias(f"{c}_std"))))


def width_of_scan(points: DataFrame, beams: int = 64, widths: tuple[int, ...] = (512, 1024, 2048)) -> DataFrame:
    """The commonest number of points a scan, the least of equals, and the image width that fits it best."""
    sizes = points.groupBy("frame_ts").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    mode = sizes.agg(F.max_by("n", F.struct("k", -F.col("n"))).alias("mode"))
    options = F.array(*(F.struct(F.abs(F.lit(beams * w) - F.col("mode")).alias("off"), F.lit(w).alias("w")) for w in widths))
    return mode.select("mode", F.array_min(options)["w"].alias("width"))


def voxels(points: DataFrame, edge: float = 0.05) -> DataFrame:
    """Distinct voxels with their points."""
    return points.groupBy(*(F.floor(F.col(c) / edge).alias(f"k{c}") for c in ("x", "y", "z"))).agg(F.count("*").alias("n"))


def voxel_maps(points: DataFrame, edge: float = 0.05) -> DataFrame:
    """Points (frame_ts, idx, x, y, z) with the number of their voxel in the scan, and whether they are its first: the
    inverse and the unique map of a scan's voxels, which are numbered by place."""
    k = [F.floor(F.col(c) / edge) for c in ("x", "y", "z")]
    scan = Window.partitionBy("frame_ts")
    numbered = points.withColumn("voxel", F.dense_rank().over(scan.orderBy(*k)) - 1)
    return numbered.withColumn("is_first", F.col("idx") == F.min("idx").over(Window.partitionBy("frame_ts", "voxel")))
