"""Point lookups in the map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lattice as L


def query_world(cells: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (probe_id, x, y) the cell seen last over all levels, the finer of equals; nulls where there is none."""
    levels = probes.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    keyed = levels.withColumn("ix", L.cell_index(F.col("x"), F.col("level"))).withColumn("iy", L.cell_index(F.col("y"), F.col("level")))
    seen = F.greatest("last_update_ts", "carve_ts") if "carve_ts" in cells.columns else F.col("last_update_ts")
    found = keyed.join(cells.withColumn("seen", seen), ["level", "ix", "iy"], "left")
    rank = F.row_number().over(Window.partitionBy("probe_id").orderBy(F.col("seen").desc_nulls_last(), "level"))
    out = found.withColumn("_r", rank).where("_r = 1").drop("_r", "x", "y")
    return out.withColumn("level", F.when(F.col("seen").isNotNull(), F.col("level"))).withColumn("ix", F.when(F.col("seen").isNotNull(), F.col("ix"))).withColumn("iy", F.when(F.col("seen").isNotNull(), F.col("iy")))
