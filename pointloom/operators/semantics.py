"""Label spaces and network outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def fine_of_raw(raw: Column) -> Column:
    """Class of a raw id; ids that no class holds, and null, are ignored."""
    table = F.create_map(*(F.lit(x) for pair in C.RAW_TO_FINE.items() for x in pair))
    return F.coalesce(F.element_at(table, raw.cast("int")), F.lit(C.IGNORE))


def label_of_fine(fine: Column) -> Column:
    """Terrain label of a class; what is ignored is unknown, never dust."""
    return F.when(fine.between(0, len(C.FINE) - 1), F.element_at(F.array(*map(F.lit, C.LABEL_OF_FINE)), fine + 1)).otherwise(C.UNKNOWN).cast("int")


def object_of_fine(fine: Column) -> Column:
    return F.when(fine.between(0, len(C.FINE) - 1), F.element_at(F.array(*map(F.lit, C.OBJECT_OF_FINE)), fine + 1)).otherwise(0).cast("int")


def softmax(logits: Column) -> Column:
    """Stable softmax of an array."""
    shifted = F.transform(logits, lambda v: F.exp(v.cast("double") - F.array_max(logits).cast("double")))
    return F.transform(F.array(shifted), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def _first_best(values: list[Column]) -> Column:
    """The first index of the greatest value."""
    best = F.greatest(*values)
    out = F.when(values[0] == best, 0)
    for i, v in enumerate(values[1:], 1):
        out = out.when(v == best, i)
    return out


def collapse(frame: DataFrame, logits: str = "logits", min_conf: float = 0.0, obj_min_conf: float = 0.0) -> DataFrame:
    """Terrain label by the sum of class chances over each label's classes, with its confidence, and an object class
    where the label is an obstacle.  Below min_conf the label is unknown."""
    out = frame.withColumn("_p", softmax(F.col(logits)))
    p = lambda i: F.element_at("_p", i + 1)
    groups = [[i for i, label in enumerate(C.LABEL_OF_FINE) if label == k] for k in range(8)]
    sums = []
    for g in groups:
        total = F.lit(0.0)
        for i in g:
            total = total + p(i)
        sums.append(total)
    objects = [i for i, o in enumerate(C.OBJECT_OF_FINE) if o]
    pick = _first_best([p(i) for i in objects])
    best = F.greatest(*(p(i) for i in objects))
    out = out.withColumn("confidence", F.greatest(*sums)).withColumn("label", F.when(F.greatest(*sums) < min_conf, C.UNKNOWN).otherwise(_first_best(sums)).cast("int"))
    kind = F.element_at(F.array(*(F.lit(C.OBJECT_OF_FINE[i]) for i in objects)), pick + 1)
    return out.withColumn("obj_class", F.when((F.col("label") == 4) & (best >= obj_min_conf), kind).otherwise(0).cast("int")).withColumn("fine", _first_best([p(i) for i in range(len(C.FINE))]).cast("int")).drop("_p")


def class_weights(labels: DataFrame, column: str) -> DataFrame:
    """1 / ln(1.02 + share) of each class."""
    counts = labels.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total), F.lit(True)).select("class", "n", (1 / F.log(1.02 + F.col("n") / F.col("total"))).alias("weight"))


def height_labels(points: DataFrame) -> DataFrame:
    """The stand-in labeller for runs without a network: by height alone, dust outside the gate."""
    z = F.col("z")
    return points.withColumn("label", F.when(~z.between(-2.0, 15.0), C.DUST).when(z > 1.0, 4).otherwise(0).cast("int"))


def ladder_labels(points: DataFrame) -> DataFrame:
    """The stand-in labeller of the sparse network: by height, and above the ground by distance; dust outside the
    gate."""
    z, away = F.col("z"), F.hypot(F.col("x"), F.col("y"))
    # Heights of ground, gravel and what stands, and the distance from which that counts as growth.
    label = F.when(~z.between(-2.0, 15.0) | F.isnan(z), C.DUST).when(z < 0.10, 0).when(z < 0.30, 1).when(away < 10.0, C.OBSTACLE).otherwise(3)
    return points.withColumn("label", label.cast("int"))


def stub_logits(pixels: DataFrame) -> DataFrame:
    """Logits of the stand-in network: it is sure of a class that follows from height alone."""
    z = F.col("z")
    fine = F.when(z < -0.5, 0).when(z < 0.0, 2).when(z < 0.5, 3).when(z < 1.0, 5).when(z < 1.5, 6).otherwise(8)
    return pixels.withColumn("logits", F.array(*(F.when(fine == i, 4.0).otherwise(0.0) for i in range(len(C.FINE)))))


def in_space(points: DataFrame, space: str, raw: str = "label") -> DataFrame:
    """Points with their raw label put into a label space: raw, fine or adl1."""
    if space == "raw":
        return points
    fine = fine_of_raw(F.col(raw))
    return points.withColumn(raw, {"fine": fine, "adl1": label_of_fine(fine)}[space])
