"""Sending this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_sent: set[str] = set()

#: Batches that go to Python: the setting, Spark's value, and ours where the session has left it at that.  Long texts
#: make batches of ten thousand rows large, and each is held several times over on its way.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000")}


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once for each application, wherever the driver runs."""
    context = spark.sparkContext
    for key, (given, ours) in BATCHES.items():
        if spark.conf.get(key, given) == given:
            spark.conf.set(key, ours)
    if context.applicationId in _sent:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "pointloom-modules.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(home.rglob("*.py")):
            z.write(file, file.relative_to(home.parent))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, worked out here: filters and steps that use a column several times would else repeat its whole
    expression, and theirs again, until the generated code is too long to compile."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.  Where it is unset, a local master gets a
    temporary folder, as driver and executors are one process there; a cluster has to name one."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        given = f"file://{tempfile.gettempdir()}/pointloom-{spark.sparkContext.applicationId}"
    return given.rstrip("/")
