"""The named queries of the grid engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import classify
from .plans import chains, grid, labels, more, objects, registry, scans  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map folded from all scans, classified, and counted by level and flag."""
    judged = classify.classify(grid.wide_cells(registry.Tables(spark, sf_dir)), grid.GROUND)
    return judged.groupBy("level", "obstacle_flag").agg(F.count("*").alias("cells"), F.round(F.avg("traversability"), 6).alias("traversability"))


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
