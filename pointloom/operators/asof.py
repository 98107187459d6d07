"""Joins in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_within(left: DataFrame, right: DataFrame, by: list[str], time: str, tolerance: float, keep: list[str]) -> DataFrame:
    """left with the columns keep of the last row of right at its time or at most tolerance before it, nulls if none.

    Both sides meet by key and time bucket of the tolerance's size, left in two buckets; so one key that holds most of
    the rows is spread over its buckets.  left needs no unique key: its rows are numbered by all their values.
    """
    bucket = lambda c: F.floor(F.col(c) / tolerance)
    r = right.select(*(F.col(c).alias(f"_r_{c}") for c in by), F.col(time).alias("_rt"), bucket(time).alias("_rb"), F.struct(*keep).alias("_keep"))
    times = left.select(*by, time).distinct().withColumn("_b", F.explode(F.array(bucket(time), bucket(time) - 1)))
    on = [times[c] == r[f"_r_{c}"] for c in by] + [times["_b"] == r["_rb"]]
    near = times.join(r, on).where((F.col("_rt") <= F.col(time)) & (F.col("_rt") >= F.col(time) - tolerance))
    best = near.groupBy(*by, time).agg(F.max(F.struct("_rt", "_keep")).alias("_m")).select(*by, time, *(F.col(f"_m._keep.{c}").alias(c) for c in keep))
    return left.join(best, [*by, time], "left")
