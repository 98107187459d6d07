"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, kept, mark


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for each end of an edge (a, b), the least vertex that it reaches.

    Labels take the least label among neighbours and then the label of their label, round after round, until none
    changes.  Every round is an aggregation with map-side combining and joins on the vertex; nothing is collected.
    """
    since = mark()
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = kept(both.where("a <> b").distinct(), "edges")
    labels = kept(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")), "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("u")).agg(F.min("c").alias("m"))
        step = labels.join(near, labels.v == near.u).select("v", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        target = labels.select(F.col("v").alias("w"), F.col("c").alias("far"))
        new = kept(step.join(target, step.c == target.w, "left").select("v", F.least("c", F.coalesce("far", "c")).alias("c"), "was"), "labels")
        if new.where("c <> was").isEmpty():
            forget(edges.sparkSession, since, new)
            out = new.select("v", "c")
            out.kept_at = new.kept_at
            return out
        labels = new.select("v", "c")
