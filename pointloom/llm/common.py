"""What the operators share: narrow views of input tables and places for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_dir, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text alone, as doc_id and text: other columns, whatever their names, never meet ours."""
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


_made: list[str] = []


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pointloom-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """What forget counts from."""
    return len(_made)


def forget(spark: SparkSession, since: int, *needed: DataFrame) -> None:
    """Removes the intermediate tables made since the mark, but for those that are still to be read."""
    left = {df.kept_at for df in needed}
    for path in _made[since:]:
        if path not in left:
            _deleted(spark, path)
    _made[since:] = [path for path in _made[since:] if path in left]


def in_release(spark: SparkSession, path: str) -> str:
    """A folder that release removes with the intermediate tables."""
    _made.append(path)
    return path


#: Ids that are sent to all executors beside documents, at most; with more, both sides are shuffled.
SENT = 400_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is among ids, a table of one column; rows without id stay."""
    ids = ids.toDF("_gone").where("_gone is not null").distinct()
    if ids.count() <= SENT:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[f"`{id_col}`"] == F.col("_gone"), "left_anti")


def release(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application; results that read them must have been used by then."""
    forget(spark, 0)
